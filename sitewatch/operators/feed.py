"""Queries over the published feed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewatch import constants as C
from sitewatch.functions import geo
from sitewatch.functions.numeric import is_finite
from sitewatch.functions.text import blank_to_null, literal_map, severity_band, title_case_site
from sitewatch.operators.narrative import top_driver_label
from sitewatch.operators.neighbours import nearest_targets

SEARCHED_FIELDS = (
    "site_label",
    "display_name",
    "site_id",
    "water_body_name",
    "region",
    "area",
    "sub_area",
)


def ranked_feed(records: DataFrame) -> DataFrame:
    return records.orderBy("anomaly_rank", "site_id")


def top_sites(sites: DataFrame, n: int = 10, by: str = "anomaly_rank", descending: bool = False) -> DataFrame:
    """The n first sites of an order; Spark keeps n rows per task, not a sort."""
    order = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    return sites.orderBy(order, "site_id").limit(n)


def flagged_summaries(feed: DataFrame) -> DataFrame:
    return feed.where(F.col("is_flagged") & blank_to_null(F.col("summary")).isNotNull())


# --- filtering ----------------------------------------------------------------------


@dataclass(frozen=True)
class FeedFilter:
    region: str | None = None
    severity: str | None = None
    driver: str | None = None
    confidence_tiers: tuple[str, ...] = ()
    query: str = ""
    incidents: str | None = None  # has_incidents | has_spills | high_count
    metric: str | None = None  # flagged | crossType
    limit: int | None = 250


def feed_filter(feed: DataFrame, wanted: FeedFilter = FeedFilter()) -> DataFrame:
    """Sites that meet every given condition, in rank order."""
    tests: list[Column] = []
    if wanted.metric == "flagged":
        tests.append(F.col("is_flagged"))
    elif wanted.metric == "crossType":
        tests.append(F.col("is_cross_type"))
    if wanted.region:
        tests.append(F.col("region") == wanted.region)
    if wanted.severity:
        tests.append(severity_band(F.col("anomaly_score")) == wanted.severity)
    if wanted.driver:
        tests.append(F.exists("drivers", lambda d: d["name"] == wanted.driver))
    if wanted.confidence_tiers:
        tests.append(_normal_tier(F.col("confidence_tier")).isin(
            *["well-monitored" if t == "well" else t for t in wanted.confidence_tiers]
        ))
    needle = wanted.query.strip().lower()
    if needle:
        fields = [blank_to_null(F.col(c)) for c in SEARCHED_FIELDS if c in feed.columns]
        tests.append(F.lower(F.concat_ws(" ", *fields)).contains(needle))
    if wanted.incidents == "has_incidents":
        tests.append(F.col("incidents.has_any_incidents"))
    elif wanted.incidents == "has_spills":
        tests.append(F.col("incidents.total_edm_spills") > 0)
    elif wanted.incidents == "high_count":
        tests.append(F.col("incidents.total_all_incidents") > 10)
    for test in tests:
        feed = feed.where(test)
    ordered = ranked_feed(feed)
    return ordered if wanted.limit is None else ordered.limit(wanted.limit)


def _normal_tier(tier: Column) -> Column:
    return F.when(tier == "well", F.lit("well-monitored")).otherwise(tier)


def find_site(feed: DataFrame, site_id: str) -> DataFrame:
    return feed.where(F.col("site_id") == site_id)


# --- nearest sites ---------------------------------------------------------------------


def nearest_sites(
    sites: DataFrame, lat: float, lon: float, limit: int = 10, max_km: float = 50.0
) -> DataFrame:
    """Sites nearest to one place, with ``distance_km``."""
    distance = geo.haversine(
        F.lit(float(lat)), F.lit(float(lon)), F.col("lat"), F.col("lon"), C.EARTH_RADIUS_KM
    )
    return (
        sites.where(is_finite(F.col("lat")) & is_finite(F.col("lon")))
        .withColumn("distance_km", distance)
        .where(F.col("distance_km") <= max_km)
        .orderBy("distance_km", "site_id")
        .limit(limit)
    )


def nearest_sites_batch(
    origins: DataFrame, sites: DataFrame, limit: int = 10, max_km: float = 50.0
) -> DataFrame:
    """The same for a table of ``origin_id, lat, lon``."""
    found = nearest_targets(
        origins.select(F.col("origin_id").alias("site_id"), "lat", "lon"),
        sites.select(F.col("site_id").alias("peer_id"), "lat", "lon"),
        limit,
    )
    return found.where(F.col("distance_m") <= max_km * 1000.0).select(
        F.col("site_id").alias("origin_id"),
        F.col("peer_id").alias("site_id"),
        F.col("rank").alias("nth"),
        (F.col("distance_m") / 1000).alias("distance_km"),
    )


# --- header, facets, bounds -----------------------------------------------------------------


def feed_header(
    feed: DataFrame, period: DataFrame, method: str, features: list[str], panel: dict[str, str]
) -> DataFrame:
    """The one-row envelope of a feed."""
    totals = feed.agg(
        F.count(F.lit(1)).alias("total_sites"),
        F.count_if(F.col("is_flagged")).alias("flagged_sites"),
        F.count_if(F.col("is_cross_type")).alias("cross_type_sites"),
    )
    one_row_period = period.select(
        F.struct(
            F.date_format("period_start", "yyyy-MM-dd").alias("start"),
            F.date_format("period_end", "yyyy-MM-dd").alias("end"),
        )
    ).scalar()
    return totals.withColumn("_period", one_row_period).select(
        F.col("_period.start").alias("data_period_start"),
        F.col("_period.end").alias("data_period_end"),
        "total_sites",
        "flagged_sites",
        "cross_type_sites",
        F.col("total_sites").alias("top_n_with_narratives"),
        F.lit(method).alias("scoring_method"),
        F.array(*[F.lit(f) for f in features]).cast("array<string>").alias("feature_cols"),
        literal_map(panel).alias("panel"),
    )


def feed_facets(feed: DataFrame) -> DataFrame:
    """``(facet, value, n)`` for regions, drivers and confidence tiers in one pass.

    ``n`` counts sites for regions and tiers, mentions for drivers.
    """
    tier = _normal_tier(F.col("confidence_tier"))
    facet = "struct<facet:string,value:string>"
    entries = F.concat(
        F.array(
            F.struct(F.lit("region").alias("facet"), blank_to_null(F.col("region")).alias("value")),
            F.struct(
                F.lit("confidence").alias("facet"),
                F.when(tier.isin("well-monitored", "moderate", "limited"), tier).alias("value"),
            ),
        ),
        F.coalesce(
            F.transform(
                "drivers", lambda d: F.struct(F.lit("driver").alias("facet"), d["name"].alias("value"))
            ),
            F.array().cast(f"array<{facet}>"),
        ),
    )
    return (
        feed.select(F.inline(entries))
        .where(F.col("value").isNotNull())
        .groupBy("facet", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("facet", "value")
    )


def region_bounds(feed: DataFrame, by_region: bool = True) -> DataFrame:
    """Bounding box of located sites, per region or of all."""
    located = feed.where(is_finite(F.col("lat")) & is_finite(F.col("lon")))
    box = [
        F.min("lon").alias("west"),
        F.min("lat").alias("south"),
        F.max("lon").alias("east"),
        F.max("lat").alias("north"),
    ]
    return located.groupBy("region").agg(*box) if by_region else located.agg(*box)


def geojson_features(feed: DataFrame) -> DataFrame:
    """One GeoJSON Feature text per located site."""
    band = severity_band(F.col("anomaly_score"))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias(
            "geometry"
        ),
        F.struct(
            F.col("site_id").alias("siteId"),
            title_case_site(F.col("site_label")).alias("name"),
            F.col("anomaly_rank").alias("rank"),
            band.alias("severity"),
            top_driver_label(F.col("drivers")).alias("driver"),
            F.col("is_flagged").alias("flagged"),
            F.element_at(literal_map(C.SEVERITY_COLOURS), band).alias("color"),
        ).alias("properties"),
    )
    return feed.where(is_finite(F.col("lat")) & is_finite(F.col("lon"))).select(
        "site_id", F.to_json(feature).alias("feature")
    )


# --- comparison with the previous release -----------------------------------------------------


def rank_history_join(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Sites in both releases with ``old_rank``, ``new_rank`` and ``rank_delta``."""
    old = previous.select("site_id", F.col("anomaly_rank").alias("old_rank"))
    new = current.select("site_id", F.col("anomaly_rank").alias("new_rank"))
    return new.join(old, "site_id").withColumn(
        "rank_delta", F.col("old_rank") - F.col("new_rank")
    )


def rank_movers(history: DataFrame, n: int = 10, within: int = 200) -> DataFrame:
    """Largest moves: overall by size, and up and down near the top."""
    near = history.where((F.col("new_rank") <= within) | (F.col("old_rank") <= within))
    choices = {
        "largest": (history, F.desc(F.abs("rank_delta"))),
        "up": (near, F.desc("rank_delta")),
        "down": (near, F.asc("rank_delta")),
    }
    parts = [
        df.orderBy(order, "site_id").limit(n).select(F.lit(name).alias("movement"), "*")
        for name, (df, order) in choices.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def top50_entered_exited(current: DataFrame, previous: DataFrame, n: int = 50) -> DataFrame:
    """Sites that joined or left the top of the ranking."""
    now = current.where(F.col("anomaly_rank") <= n).select("site_id")
    before = previous.where(F.col("anomaly_rank") <= n).select("site_id")

    def only(left: DataFrame, right: DataFrame, change: str) -> DataFrame:
        return left.join(right, "site_id", "left_anti").select(F.lit(change).alias("change"), "site_id")

    return only(now, before, "entered").unionByName(only(before, now, "exited"))


# --- set operations ----------------------------------------------------------------------------


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union of tables that differ in columns; clashing types meet as text."""
    frames = [first, *others]
    types: dict[str, set[str]] = {}
    for frame in frames:
        for name, dtype in frame.dtypes:
            types.setdefault(name, set()).add(dtype)
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")

    def common(found: set[str]) -> str | None:
        if len(found) == 1:
            return None
        return max(found, key=numeric.index) if found <= set(numeric) else "string"

    out = None
    for frame in frames:
        for name in frame.columns:
            target = common(types[name])
            if target:
                frame = frame.withColumn(name, F.col(f"`{name}`").cast(target))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def union_distinct(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union that keeps one row per key, the smallest of its rows."""
    both = first.unionByName(second)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*")
