"""Joins whose key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch.operators.checkpoints import cut

MAX_HOT_KEYS = 100_000  # proven bound of the broadcast list, some megabytes


def hot_keys(df: DataFrame, keys: list[str], rows_per_split: int) -> DataFrame:
    """The largest keys above ``rows_per_split`` rows, at most ``MAX_HOT_KEYS``.

    Any key left out of the list is smaller than the kept ones, so it holds under
    1/100,000 of the rows. The list only steers placement, never the result.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > rows_per_split)
        .orderBy(F.desc("_rows"), *keys)
        .limit(MAX_HOT_KEYS)
        .select(
            *keys,
            F.ceil(F.col("_rows") / rows_per_split).cast("int").alias("_splits"),
        )
    )


def _own_split(key: str, splits: str) -> Column:
    return F.pmod(F.xxhash64(key), F.coalesce(splits, F.lit(1))).cast("int")


def _every_split(splits: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce(splits, F.lit(1)) - 1))


def split_hot_join(
    probe: DataFrame,
    build: DataFrame,
    keys: list[str],
    build_id: str,
    rows_per_split: int = 200_000,
    hot: DataFrame | None = None,
    probe_id: str | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Inner join on ``keys`` in which hot keys of ``build`` are split.

    A hot key's build rows are spread over numbered splits by a hash of
    ``build_id``; a probe row with that key visits every split once. ``hot`` may be
    passed where several joins share one build side. With ``probe_id`` the hot keys of
    ``probe`` are spread as well: the splits of both sides make a grid, and every pair of
    rows meets in one field of it. ``tasks`` is for joins that return far more rows than
    they read: that many tasks share them, where the planner would count the bytes read.
    """
    # Written once: both sides must see the same list, also after a retried stage.
    hot = F.broadcast(cut(hot_keys(build, keys, rows_per_split), "hot_keys") if hot is None else hot)
    placed = build.join(hot, keys, "left").withColumn("_split", _own_split(build_id, "_splits"))
    visiting = probe.join(hot, keys, "left").withColumn("_split", _every_split("_splits"))
    on = [*keys, "_split"]
    if probe_id is not None:
        hot_probe = hot_keys(probe, keys, rows_per_split).withColumnRenamed("_splits", "_parts")
        hot_probe = F.broadcast(cut(hot_probe, "hot_keys"))
        placed = placed.join(hot_probe, keys, "left").withColumn("_part", _every_split("_parts")).drop("_parts")
        visiting = visiting.join(hot_probe, keys, "left").withColumn("_part", _own_split(probe_id, "_parts")).drop("_parts")
        on.append("_part")
    placed, visiting = placed.drop("_splits"), visiting.drop("_splits")
    if tasks is not None:
        placed, visiting = placed.repartition(tasks, *on), visiting.repartition(tasks, *on)
    return visiting.join(placed, on).drop("_split", "_part")
