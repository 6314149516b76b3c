"""Per-site statistics, metadata and sampling coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch import constants as C
from sitewatch.config import FeatureSettings
from sitewatch.operators.checkpoints import cut
from sitewatch.operators.order_statistics import (
    BROADCAST_BINS,
    LINEAR,
    NEAREST,
    combined,
    grouped_quantiles,
    in_order,
    picked,
)

GROUP = ["site_id", "determinand_code", "unit"]
RESULT = [*GROUP, "n", "mean", "median", "std", "min", "max", "q10", "q90", "determinant", "dt_min", "dt_max"]
#: Rows of one group that a task sorts at most.
SORTED_ROWS = 20_000


def site_determinand_stats(
    df: DataFrame,
    settings: FeatureSettings = FeatureSettings(),
    interpolation: str = NEAREST,
) -> DataFrame:
    """One row per (site, determinand, unit) within the analysed years.

    ``q10`` and ``q90`` take the nearest order statistic by default. The name is
    the alphabetically first one, so the result does not depend on row order.
    """
    inside = df.where(F.col("year").between(settings.year_start, settings.year_end))
    specs = {"median": (0.5, LINEAR), "q10": (0.1, interpolation), "q90": (0.9, interpolation)}
    sizes = inside.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_rows"))
    large = cut(sizes.where(F.col("_rows") > SORTED_ROWS).select(*GROUP), "large_groups")
    n_large = large.count()
    if not n_large:
        return _stats_of_small(inside, specs)
    on = _same_group(large := large.select(*[F.col(k).alias(f"_{k}") for k in GROUP]))
    large = F.broadcast(large) if n_large <= BROADCAST_BINS else large
    small = _stats_of_small(inside.join(large, on, "left_anti"), specs)
    return small.unionByName(_stats_of_large(inside.join(large, on, "left_semi"), specs))


def _same_group(renamed: DataFrame) -> Column:
    """Equal groups, nulls being equal; columns of ``renamed`` begin with an underscore."""
    on = F.lit(True)
    for k in GROUP:
        on = on & F.col(k).eqNullSafe(renamed[f"_{k}"])
    return on


def _stats_of_small(inside: DataFrame, specs: dict[str, tuple[float, str]]) -> DataFrame:
    """Groups that one task may sort: rows cross the network once, for all statistics."""
    needed = inside.select(*GROUP, "determinant", "value", "sample_dt")
    found = _moments(in_order(needed, GROUP, "value"), picked(specs) | {"_n": F.max("_n")})
    return found.select("*", *combined(specs)).select(*RESULT)


def _stats_of_large(inside: DataFrame, specs: dict[str, tuple[float, str]]) -> DataFrame:
    """Groups of any size: moments combine in the tasks, quantiles come by radix selection."""
    quantiles = grouped_quantiles(inside, GROUP, "value", specs)
    right = quantiles.select(*[F.col(k).alias(f"_{k}") for k in GROUP], *specs)
    return _moments(inside).join(right, _same_group(right), "left").select(*RESULT)


def _moments(inside: DataFrame, further: dict[str, Column] | None = None) -> DataFrame:
    """Counts, moments and ranges per group, and ``further`` maxima.

    The name is a grouping key at first, which keeps the pass over all rows a hash
    aggregate; a minimum over text would sort them. Names per group are then
    merged, in nearly all cases one row each.
    """
    named = inside.groupBy(*GROUP, "determinant").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("value").alias("_k"),
        F.avg("value").alias("_mean"),
        (F.var_pop("value") * F.count("value")).alias("_m2"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.min("sample_dt").alias("dt_min"),
        F.max("sample_dt").alias("dt_max"),
        *[largest.alias(name) for name, largest in (further or {}).items()],
    )
    one = F.count(F.lit(1)) == 1
    k = F.sum("_k")
    total = F.sum(F.col("_mean") * F.col("_k"))
    between = F.sum(F.col("_k") * F.col("_mean") * F.col("_mean")) - total * total / F.nullif(k, F.lit(0))
    m2 = F.when(one, F.max("_m2")).otherwise(F.sum("_m2") + F.greatest(between, F.lit(0.0)))
    return named.groupBy(*GROUP).agg(
        F.sum("n").alias("n"),
        F.when(one, F.max("_mean")).otherwise(total / F.nullif(k, F.lit(0))).alias("mean"),
        F.when(k > 1, F.sqrt(m2 / (k - 1))).alias("std"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.min("determinant").alias("determinant"),
        F.min("dt_min").alias("dt_min"),
        F.max("dt_max").alias("dt_max"),
        *[F.max(f"`{name}`").alias(name) for name in further or {}],
    )


def site_metadata(df: DataFrame, order_by: tuple[str, ...] = ()) -> DataFrame:
    """First known value of each site attribute; an absent attribute is null.

    "First" means lowest by ``order_by`` among rows that have the attribute, then
    lowest value, so it does not depend on how rows arrive. Latitude and longitude come
    from one row that has both, so a site that moved keeps a place where it has been.
    """
    place = ("lat", "lon")
    placed = all(c in df.columns for c in place)

    def first_known(name: str) -> Column:
        if name not in df.columns:
            return F.max(F.lit(None).cast("string")).alias(name)
        keyed = F.when(
            F.col(name).isNotNull(), F.struct(*[F.col(o) for o in order_by], F.col(name).alias("_v"))
        )
        return F.min(keyed)["_v"].alias(name)

    alone = [c for c in C.SITE_ATTRIBUTES if not (placed and c in place)]
    both = []
    if placed:
        known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
        both = [F.min(F.when(known, F.struct(*[F.col(o) for o in order_by], *place))).alias("_place")]
    found = df.groupBy("site_id").agg(*[first_known(c) for c in alone], *both)
    return found.select(
        "site_id", *[F.col(f"_place.{c}").alias(c) if placed and c in place else c for c in C.SITE_ATTRIBUTES]
    )


def whole_days(start: Column, end: Column) -> Column:
    """Full 24-hour days between two moments (not calendar days)."""
    return F.floor(F.timestamp_diff("SECOND", start, end) / F.lit(86_400))


def site_coverage(df: DataFrame, time_column: str | None = "sample_dt") -> DataFrame:
    """First and last sample, counts, and mean days between sampling moments."""
    if time_column is None or time_column not in df.columns:
        return df.groupBy("site_id").agg(
            F.max(F.lit(None).cast("timestamp_ntz")).alias("first_sample"),
            F.max(F.lit(None).cast("timestamp_ntz")).alias("last_sample"),
            F.count("value").alias("total_observations"),
            F.max(F.lit(None).cast("long")).alias("distinct_sample_dates"),
            F.max(F.lit(None).cast("double")).alias("avg_days_between_visits"),
        )
    # Two steps: moments are counted once each, and a null moment counts as one.
    moments = df.groupBy("site_id", time_column).agg(F.count("value").alias("_values"))
    sites = moments.groupBy("site_id").agg(
        F.min(time_column).alias("first_sample"),
        F.max(time_column).alias("last_sample"),
        F.sum("_values").alias("total_observations"),
        F.count(F.lit(1)).alias("distinct_sample_dates"),
    )
    gap = F.when(
        F.col("distinct_sample_dates") > 1,
        whole_days(F.col("first_sample"), F.col("last_sample")) / F.col("distinct_sample_dates"),
    )
    return sites.withColumn("avg_days_between_visits", gap)


def data_period(df: DataFrame) -> DataFrame:
    return df.agg(
        F.min("sample_dt").cast("date").alias("period_start"),
        F.max("sample_dt").cast("date").alias("period_end"),
    )
