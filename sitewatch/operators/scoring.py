"""Peer-group scores, ranks, flags and drivers over the long form."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch import constants as C
from sitewatch.config import ScoringSettings
from sitewatch.functions.numeric import null_if_nan, unit_or_std
from sitewatch.operators.checkpoints import cut
from sitewatch.operators.neighbours import geographic_neighbours
from sitewatch.operators.order_statistics import average_ranks, quantile

log = logging.getLogger(__name__)

GLOBAL = "global"


def _usable_type(label: Column) -> Column:
    return F.when((label != "") & (F.lower(label) != "nan"), label)


def score_reference(sites: DataFrame, min_group: int) -> DataFrame:
    """Per site the reference it is scored against and that reference's size.

    ``sites`` holds one row per scored site with ``wfd_type``.
    """
    typed = sites.select("site_id", _usable_type(F.col("wfd_type")).alias("_type"))
    sizes = (
        typed.where(F.col("_type").isNotNull())
        .groupBy("_type")
        .agg(F.count(F.lit(1)).alias("_size"))
        .where(F.col("_size") >= min_group)
    )
    everyone = typed.agg(F.count(F.lit(1)).alias("n")).scalar()
    return typed.join(sizes, "_type", "left").select(
        "site_id",
        F.when(F.col("_size").isNotNull(), F.col("_type")).alias("reference_type"),
        F.coalesce(F.when(F.col("_size").isNotNull(), F.col("_type")), F.lit(GLOBAL)).alias(
            "score_reference"
        ),
        F.coalesce("_size", everyone).alias("score_peer_group_size"),
    )


def peer_zscores(long: DataFrame, sites: DataFrame, min_group: int = 10) -> DataFrame:
    """z of each (site, feature) against its type group, else against all sites.

    One map-side combined aggregate gives count, mean and variance per type and feature,
    a table of types times features; rolled up it gives those over all sites. Both are
    joined back without a hint, so small ones are broadcast by their measured size and
    the site values are not shuffled by type.
    """
    values = long.select("site_id", "feature", null_if_nan(F.col("value")).alias("value"))
    placed = values.join(score_reference(sites, min_group), "site_id")
    by_type = cut(
        placed.groupBy("reference_type", "feature").agg(
            F.count("value").alias("_n"), F.avg("value").alias("_type_mean"), F.var_pop("value").alias("_type_var")
        ),
        "type_moments",
    )
    totals = by_type.groupBy("feature").agg(
        F.sum("_n").alias("_all_n"), (F.sum(F.col("_n") * F.col("_type_mean")) / F.nullif(F.sum("_n"), F.lit(0))).alias("_all_mean")
    )
    apart = F.col("_type_mean") - F.col("_all_mean")
    overall = (
        by_type.join(totals, "feature")
        .groupBy("feature", "_all_n", "_all_mean")
        .agg(F.sum(F.col("_n") * (F.col("_type_var") + apart * apart)).alias("_all_m2"))
        .select("feature", "_all_mean", F.sqrt(F.col("_all_m2") / F.nullif(F.col("_all_n"), F.lit(0))).alias("_all_std"))
    )
    overall = cut(overall, "overall_moments")
    by_type = by_type.where(F.col("reference_type").isNotNull()).select(
        "reference_type", "feature", "_type_mean", F.sqrt("_type_var").alias("_type_std")
    )
    own = F.col("reference_type").isNotNull()
    mean = F.when(own, F.col("_type_mean")).otherwise(F.col("_all_mean"))
    std = F.when(own, F.col("_type_std")).otherwise(F.col("_all_std"))
    return (
        placed.join(overall, "feature")
        .join(by_type, ["reference_type", "feature"], "left")
        .select(
            "site_id",
            "feature",
            "value",
            ((F.col("value") - mean) / unit_or_std(std)).alias("z"),
            "score_reference",
            "score_peer_group_size",
        )
    )


def rms(z: Column) -> Column:
    return F.coalesce(F.sqrt(F.avg(z * z)), F.lit(0.0))


def anomaly_score(z: DataFrame) -> DataFrame:
    """Root mean square of the known z-scores of each site; none gives 0."""
    return z.groupBy("site_id").agg(
        rms(F.col("z")).alias("anomaly_score"),
        F.min("score_reference").alias("score_reference"),
        F.min("score_peer_group_size").alias("score_peer_group_size"),
    )


def anomaly_rank(scores: DataFrame, score: str = "anomaly_score", rank: str = "anomaly_rank") -> DataFrame:
    return average_ranks(scores, score, rank)


def flag_anomalies(scores: DataFrame, percentile: float = 95.0) -> DataFrame:
    """Flag scores at or above the linear-interpolated percentile of all scores."""
    threshold = quantile(scores, "anomaly_score", percentile / 100.0).scalar()
    marked = scores.withColumn("flag_threshold", threshold)
    return marked.withColumn("is_flagged", F.col("anomaly_score") >= F.col("flag_threshold"))


def anomaly_drivers(z: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Strongest features per site (bounded by the feature count)."""
    known = F.when(
        F.col("z").isNotNull(),
        F.struct((-F.abs("z")).alias("key"), F.col("feature"), F.col("z")),
    )
    listed = z.groupBy("site_id").agg(F.array_sort(F.collect_list(known)).alias("_all"))
    strong = F.filter("_all", lambda e: e["key"] <= -threshold)
    top = F.get("_all", F.lit(0))
    return listed.select(
        "site_id",
        F.array_join(F.transform(strong, lambda e: e["feature"]), "|").alias("anomaly_drivers"),
        top["feature"].alias("top_anomaly_driver"),
        top["z"].alias("top_anomaly_driver_z"),
    )


def geo_anomaly(long: DataFrame, sites: DataFrame, k: int = 20) -> DataFrame:
    """RMS-z of each located site against its k nearest sites on the map."""
    edges = cut(geographic_neighbours(sites, k), "geo_edges")
    values = long.select("site_id", "feature", null_if_nan(F.col("value")).alias("value"))
    around = (
        edges.select("site_id", "peer_id")
        .join(values.withColumnRenamed("site_id", "peer_id"), "peer_id")
        .groupBy("site_id", "feature")
        .agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std"))
    )
    z = values.join(around, ["site_id", "feature"], "left").select(
        "site_id", ((F.col("value") - F.col("_mean")) / unit_or_std(F.col("_std"))).alias("z")
    )
    scores = z.groupBy("site_id").agg(rms(F.col("z")).alias("geo_anomaly_score"))
    reach = edges.groupBy("site_id").agg(
        (F.avg("distance_m") / C.EARTH_RADIUS_M * C.EARTH_RADIUS_PRECISE_KM).alias(
            "geo_peer_distance_km"
        )
    )
    located = reach.join(scores, "site_id", "left").withColumn(
        "geo_anomaly_score", F.coalesce("geo_anomaly_score", F.lit(0.0))
    )
    ranked = average_ranks(cut(located, "geo_scores"), "geo_anomaly_score", "geo_anomaly_rank")
    return sites.select("site_id").join(ranked, "site_id", "left")


def score_sites(
    long: DataFrame, sites: DataFrame, settings: ScoringSettings = ScoringSettings(), z: DataFrame | None = None
) -> DataFrame:
    """Scores, ranks, flags and drivers by the chosen method.

    ``sites`` needs ``site_id, lat, lon, wfd_type``. The geographic method replaces
    score and rank; drivers and labels stay those of the typology comparison. ``z`` may
    be passed where the z-scores are written already.
    """
    if z is None:
        z = cut(peer_zscores(long, sites, settings.min_group_size), "zscores")
    scores = anomaly_score(z)
    if settings.method == "geographic_neighbours":
        geo = geo_anomaly(long, sites, settings.geographic_k)
        replaced = scores.drop("anomaly_score").join(geo, "site_id", "left")
        scores = replaced.withColumn("anomaly_score", F.col("geo_anomaly_score"))
    elif settings.method == "typology_peers":
        scores = scores.join(geo_anomaly(long, sites, settings.geographic_k), "site_id", "left")
    else:
        log.warning("unknown scoring method %r: typology peers are used", settings.method)
    ranked = anomaly_rank(cut(scores, "scores"))
    flagged = flag_anomalies(ranked, settings.flag_percentile)
    return flagged.join(anomaly_drivers(z, settings.notable_z), "site_id", "left")
