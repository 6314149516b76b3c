"""The release as jobs: each reads written layers and writes the next one.

Every job can be run alone, so a release resumes at any layer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.config import Settings
from sitewatch.operators import cleaning, features, gates, narrative, peers, scoring, statistics
from sitewatch.operators import feed as feeds
from sitewatch.operators.checkpoints import run_folder
from sitewatch.plans.fingerprint import build_signatures
from sitewatch.plans.pressures import Pressures, enriched
from sitewatch.sources.feed import write_feed
from sitewatch.sources.layers import has_layer, latest_snapshot, read_layer, snapshot_run, write_layer
from sitewatch.sources.observations import read_observations

OBSERVATIONS, STATS, VALUES, SITES = "observations", "site_stats", "site_values", "sites"
MODEL, ZSCORES, SCORED, FEED, HEADER = "feature_model", "zscores", "scored_sites", "feed", "header"
ENRICHED, MEASURES = "feed_enriched", "gate_1_measures"


def ingest(spark: SparkSession, raw_dir: str, root: str, settings: Settings = Settings()) -> DataFrame:
    """Raw files to the observation layer, partitioned by year."""
    raw = cleaning.harmonise_columns(read_observations(spark, raw_dir))
    clean = cleaning.clean_observations(raw, settings.cleaning)
    for name in ("lat", "lon"):
        if name in clean.columns:
            clean = clean.withColumn(name, F.col(name).try_cast("double"))
    write_layer(clean, root, OBSERVATIONS, ("year",))
    return read_layer(spark, root, OBSERVATIONS)


def fingerprint(
    spark: SparkSession, root: str, lookup: DataFrame | None = None, settings: Settings = Settings()
) -> DataFrame:
    """Observations to imputed site values, the feature model, and site attributes."""
    obs = cleaning.harmonise_clean(read_layer(spark, root, OBSERVATIONS))
    write_layer(statistics.site_determinand_stats(obs, settings.features), root, STATS)
    built = build_signatures(read_layer(spark, root, STATS), settings.features)
    filled = features.impute_median(built.grid).select("site_id", "feature", "value")
    write_layer(filled, root, VALUES)
    write_layer(features.feature_model(built.grid), root, MODEL)
    values = read_layer(spark, root, VALUES)
    embedded = features.embed_2d(features.standard_scale(values))
    described = features.site_meta_join(
        statistics.site_metadata(obs, ("sample_dt",)), statistics.site_coverage(obs), built.sites.join(embedded, "site_id")
    )
    write_layer(features.typology_join(described, lookup), root, SITES)
    return read_layer(spark, root, SITES)


def score(spark: SparkSession, root: str, settings: Settings = Settings()) -> DataFrame:
    """Site values to scored sites with peers."""
    values, sites = read_layer(spark, root, VALUES), read_layer(spark, root, SITES)
    sites = sites.withColumn("lat", F.col("lat").cast("double")).withColumn("lon", F.col("lon").cast("double"))
    z = scoring.peer_zscores(values, sites, settings.scoring.min_group_size)
    write_layer(z, root, ZSCORES)
    z = read_layer(spark, root, ZSCORES)
    scores = scoring.score_sites(values, sites, settings.scoring, z)
    points = sites.select("site_id", F.col("umap_x").alias("x"), F.col("umap_y").alias("y"))
    z_vectors = features.to_vectors(z.select("site_id", "feature", F.coalesce("z", F.lit(0.0)).alias("value")))
    chemistry = features.to_vectors(features.standard_scale(values))
    diagnostics = peers.peer_diagnostics(chemistry, points, settings.peers)
    typology = peers.peer_typology(
        peers.final_peers(points, z_vectors, settings.peers), sites.select("site_id", "wfd_type"), settings.peers
    )
    joined = (
        sites.join(scores, "site_id")
        .join(diagnostics, "site_id", "left")
        .join(typology, "site_id", "left")
    )
    write_layer(peers.resolve_type(joined, settings.peers.resolve_threshold), root, SCORED)
    return read_layer(spark, root, SCORED)


def narrate(spark: SparkSession, root: str, settings: Settings = Settings()) -> DataFrame:
    """Scored sites to the feed layer and its published files."""
    scored, z = read_layer(spark, root, SCORED), read_layer(spark, root, ZSCORES)
    tiered = narrative.confidence_tier(scored, settings.confidence)
    told = narrative.narrate(narrative.driver_details(tiered, z, settings.features.panel))
    write_layer(narrative.site_record(told), root, FEED)
    publish(spark, root, settings)
    return read_layer(spark, root, FEED)


def publish(spark: SparkSession, root: str, settings: Settings = Settings(), layer: str = FEED) -> None:
    """Publish a feed layer; readers see the version before until this one is complete."""
    feed = read_layer(spark, root, layer)
    model = read_layer(spark, root, MODEL)
    names = [r["feature"] for r in model.orderBy("position").select("feature").collect()]
    period = statistics.data_period(read_layer(spark, root, OBSERVATIONS))
    header = feeds.feed_header(feed, period, settings.scoring.method, names, settings.features.panel)
    write_feed(feed, header, f"{root}/published")


def enrich(spark: SparkSession, root: str, tables: Pressures, settings: Settings = Settings()) -> DataFrame:
    """The feed with pressures, water-body status and permits, as its own layer, published."""
    # A table cannot be overwritten while it is read, so the result gets its own name.
    write_layer(enriched(read_layer(spark, root, FEED), tables), root, ENRICHED)
    publish(spark, root, settings, ENRICHED)
    return read_layer(spark, root, ENRICHED)


def run_release(
    spark: SparkSession,
    raw_dir: str,
    root: str,
    archive: str,
    run_id: str,
    as_of_year: int,
    lookup: DataFrame | None = None,
    settings: Settings = Settings(),
    first_layer: int = 1,
    halt: bool = True,
    tables: Pressures | None = None,
) -> DataFrame:
    """All layers with a gate after observations, scores and feed; archives the run.

    With ``tables`` the feed is enriched before it is checked, and the enriched one is what
    is published and archived. What gate 1 measured is kept when it passes and archived
    with the run, for the next release to compare with. Intermediate tables go below one
    folder, which is removed at the end.
    """
    with run_folder(spark):
        if first_layer <= 1:
            obs = ingest(spark, raw_dir, root, settings)
            before = latest_snapshot(spark, archive, MEASURES)
            rows = before.first()["row_count"] if before is not None else None
            measured = gates.measure_observations(obs, settings=settings.gates)
            checks = gates.checks_of_observations(measured, obs.columns, as_of_year, rows, settings.gates)
            results = gates.run_gates(checks, f"{root}/reports/gate_1", halt)
            if all(r["passed"] for r in results):
                write_layer(gates.gate_metadata(measured), root, MEASURES)
        if first_layer <= 2:
            fingerprint(spark, root, lookup, settings)
        if first_layer <= 3:
            scored = score(spark, root, settings)
            checks = gates.gate_2(scored, latest_snapshot(spark, archive, SCORED), settings.gates)
            gates.run_gates(checks, f"{root}/reports/gate_2", halt)
        feed = narrate(spark, root, settings)
        if tables is not None:
            feed = enrich(spark, root, tables, settings)
        readable = gates.gate_readable(spark, f"{root}/published")
        checks = readable.unionByName(gates.gate_3(feed, latest_snapshot(spark, archive, FEED), settings.gates))
        gates.run_gates(checks, f"{root}/reports/gate_3", halt)
        snapshot_run(read_layer(spark, root, SCORED), archive, SCORED, run_id)
        snapshot_run(feed, archive, FEED, run_id)
        if has_layer(spark, root, MEASURES):
            snapshot_run(read_layer(spark, root, MEASURES), archive, MEASURES, run_id)
    return feed
