"""Exact quantiles and ranks that never sort one group in one task.

Rows are first counted per distinct value, so repeated values cross the network once per
task. Quantiles are found by radix selection: distinct values fall into order-preserving
bins, running totals over the few bins tell which bin holds a wanted rank, and only that
bin is sorted if it holds at most ``SORTED_VALUES`` of them; a fuller one is split by the
next digits of the values' bits, until it is small enough or holds one value. Ranks are
found by splitters: distinct values are dealt over ranges of about ``RANGE_VALUES`` whose
borders come from a sample, equal values on one side, and each range starts at the total
of the ranges before it. One group, or the whole table, may hold any share of the rows
and its values may lie as close together as doubles can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewatch.functions.numeric import order_bin, order_bits
from sitewatch.operators.checkpoints import cut

LINEAR = "linear"
NEAREST = "nearest"
#: Distinct values of one bin that a task sorts at most.
SORTED_VALUES = 20_000
#: Distinct values of one range of ranks, on average.
RANGE_VALUES = 500_000
#: Bits that are left out of the bins of each further round; a bin of the last is one value.
SHIFTS = (31, 15, 0)
#: Full bins are sent to all executors up to this number.
BROADCAST_BINS = 100_000
#: Rows of one score, or without a score, that one task gives their rank.
SPLIT_ROWS = 200_000
NULL_SPLITS = 1024


def _histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return (
        df.where(v.isNotNull() & ~F.isnan(v))
        .select(*keys, (v + F.lit(0.0)).alias("_value"))
        .groupBy(*keys, "_value")
        .agg(F.count(F.lit(1)).alias("_count"))
    )


def _ranks(n: Column, q: float, method: str) -> list[tuple[str, Column]]:
    position = F.lit(q) * (n - 1)
    if method == NEAREST:
        return [("at", F.round(position).cast("long"))]
    return [("lo", F.floor(position).cast("long")), ("hi", F.ceil(position).cast("long"))]


def _marked(rows: DataFrame, keys: list[str], slots: dict[str, Column], given: list[str], name: str) -> DataFrame:
    """Bins that hold a wanted rank or are full: ``keys, _bin, _n, slots, _full``.

    ``slots`` says which rank each slot wants within the parts of ``keys`` (an expression of
    the group's total ``_n`` or a column of ``given``); the result has its place inside the bin.
    """
    bins = rows.groupBy(*keys, "_bin").agg(
        F.sum("_count").alias("_in_bin"), F.count(F.lit(1)).alias("_values"), *[F.max(f"`{c}`").alias(c) for c in given]
    )
    whole = Window.partitionBy(*keys)
    running = whole.orderBy("_bin")
    bins = bins.withColumn("_before", F.sum("_in_bin").over(running) - F.col("_in_bin"))
    if "_n" not in given:
        bins = bins.withColumn("_n", F.sum("_in_bin").over(whole))

    def place(rank: Column) -> Column:
        here = (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_in_bin"))
        return F.when(here, rank - F.col("_before"))

    placed = bins.select(
        *keys, "_bin", "_n", (F.col("_values") > SORTED_VALUES).alias("_full"), *[place(rank).alias(slot) for slot, rank in slots.items()]
    )
    return cut(placed.where(F.col("_full") | _wanted(slots)), name)


def _wanted(slots: dict[str, Column]) -> Column:
    return F.coalesce(*[F.col(f"`{slot}`") for slot in slots]).isNotNull()


def _to_bins(rows: DataFrame, bins: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows with what is known of their bins; keys may be null."""
    renamed, on = bins, F.lit(True)
    for k in [*keys, "_bin"]:
        renamed = renamed.withColumnRenamed(k, f"_t_{k}")
        on = on & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    return rows.join(renamed, on, how).drop(*[f"_t_{k}" for k in [*keys, "_bin"]])


def _sorted_bins(rows: DataFrame, bins: DataFrame, keys: list[str], slots: dict[str, Column]) -> DataFrame:
    """``keys`` and per slot its value, found by sorting bins that are not full."""
    upto = F.sum("_count").over(Window.partitionBy(*keys, "_bin").orderBy("_value"))
    hits = _to_bins(rows.select(*keys, "_bin", "_value", "_count"), bins, keys).withColumn("_upto", upto)

    def at(slot: str) -> Column:
        rank = F.col(f"`{slot}`")
        return F.max(F.when((rank >= F.col("_upto") - F.col("_count")) & (rank < F.col("_upto")), F.col("_value")))

    return hits.groupBy(*keys).agg(F.max("_n").alias("_n"), *[at(slot).alias(slot) for slot in slots])


def grouped_quantiles(
    df: DataFrame, keys: list[str], value: str, specs: dict[str, tuple[float, str]]
) -> DataFrame:
    """Exact quantiles of ``value`` per group: ``name -> (q, LINEAR | NEAREST)``.

    Missing values and NaN do not count; an all-missing group has no row.
    """
    slots = {
        f"{name}.{side}": rank
        for name, (q, method) in specs.items()
        for side, rank in _ranks(F.col("_n"), q, method)
    }
    held = ["_value", "_count"]
    rows = cut(_histogram(df, keys, value), "values").withColumn("_bin", order_bin(F.col("_value")))
    parts, given, found = list(keys), [], []
    for round_no in range(len(SHIFTS) + 1):
        bins = _marked(rows, parts, slots, given, f"value_bins_{round_no}")
        n_full = bins.where("_full").count()
        if not n_full:
            found.append(_sorted_bins(rows, bins, parts, slots))
            break
        full = bins.where("_full")
        full = F.broadcast(full) if n_full <= BROADCAST_BINS else full
        light = _to_bins(rows, full, parts, "left_anti")
        found.append(_sorted_bins(light, bins.where("not _full"), parts, slots))
        # The full bins that hold a wanted rank are the parts of the next round.
        rows = _to_bins(rows.select(*parts, "_bin", *held), full.where(_wanted(slots)), parts)
        given, slots = ["_n", *slots], {slot: F.col(f"`{slot}`") for slot in slots}
        rows = rows.select(*parts, F.col("_bin").alias(f"_part_{round_no}"), *held, *[f"`{c}`" for c in given])
        parts = [*parts, f"_part_{round_no}"]
        rows = rows.withColumn("_bin", F.shiftright(order_bits(F.col("_value")), SHIFTS[min(round_no, len(SHIFTS) - 1)]))
    pieces = found[0].select(*keys, "_n", *[f"`{s}`" for s in slots])
    for more in found[1:]:
        pieces = pieces.unionByName(more.select(*keys, "_n", *[f"`{s}`" for s in slots]))
    pieces = pieces.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.max(f"`{s}`").alias(s) for s in slots])
    return pieces.select(*keys, *combined(specs))


def in_order(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add ``_value, _at, _n``: the value's place among the ``_n`` known ones of its group.

    For groups that one task may sort; rows come together by ``keys``, so a following
    aggregate by them needs no further exchange. Places of unknown values come last.
    """
    v = F.col(value).cast("double")
    known = df.withColumn("_value", F.when(~F.isnan(v), v + F.lit(0.0)))
    ordered = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("_value"))
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return known.withColumns({"_at": F.row_number().over(ordered) - 1, "_n": F.count("_value").over(whole)})


def picked(specs: dict[str, tuple[float, str]]) -> dict[str, Column]:
    """Per slot of ``specs`` the aggregate that picks its value from rows of :func:`in_order`."""
    return {
        f"{name}.{side}": F.max(F.when(F.col("_at") == rank, F.col("_value")))
        for name, (q, method) in specs.items()
        for side, rank in _ranks(F.col("_n"), q, method)
    }


def combined(specs: dict[str, tuple[float, str]]) -> list[Column]:
    """The quantiles from ``_n`` and the slots that :func:`picked` names."""
    return [_combine(name, q, m).alias(name) for name, (q, m) in specs.items()]


def _combine(name: str, q: float, method: str) -> Column:
    if method == NEAREST:
        return F.col(f"`{name}.at`")
    lo, hi = F.col(f"`{name}.lo`"), F.col(f"`{name}.hi`")
    position = F.lit(q) * (F.col("_n") - 1)
    return lo + (hi - lo) * (position - F.floor(position))


def quantile(df: DataFrame, value: str, q: float, method: str = LINEAR) -> DataFrame:
    """Exact quantile of one column as a one-row table with column ``quantile``."""
    return grouped_quantiles(df, [], value, {"quantile": (q, method)})


def value_ranges(df: DataFrame, value: str, descending: bool) -> DataFrame:
    """Distinct values with counts and the number of their range, ``_value, _count, _range``.

    Ranges follow each other in the order asked for; their borders are Spark's sampled
    splitters. The table is written, so that later steps see one and the same dealing.
    """
    order = F.desc("_value") if descending else F.asc("_value")
    values = cut(_histogram(df, [], value), "score_values")
    ranges = max(1, -(-values.count() // RANGE_VALUES))
    return cut(values.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id()), "score_ranges")


def fractional_ranks(df: DataFrame, score: str, rank: str, descending: bool = True) -> DataFrame:
    """Add the average rank of ``score``; null scores get null.

    Ties share the mean of their positions. Each range of distinct scores is ordered in
    a task of its own; only the totals of the ranges go through one task. Rows of a very
    frequent score are split where ranks are joined to them.
    """
    order = F.desc("_value") if descending else F.asc("_value")
    ranges = value_ranges(df, score, descending)
    totals = ranges.groupBy("_range").agg(F.sum("_count").alias("_in_range"))
    ahead = totals.select(
        "_range", (F.sum("_in_range").over(Window.orderBy("_range")) - F.col("_in_range")).alias("_ahead")
    )
    inside = Window.partitionBy("_range").orderBy(order)
    position = F.col("_ahead") + F.sum("_count").over(inside) - F.col("_count") + (F.col("_count") + 1) / F.lit(2)
    # One row per range of half a million values: far below any limit for broadcasts.
    ranked = ranges.join(F.broadcast(ahead), "_range").select("_value", "_count", position.alias(rank))
    # A score of more rows is split; there is at most one such score per SPLIT_ROWS rows.
    splits = F.ceil(F.col("_count") / SPLIT_ROWS).cast("int")
    ranked = ranked.select("_value", rank, splits.alias("_splits"))
    frequent = F.broadcast(ranked.where("_splits > 1").select("_value", "_splits"))
    visiting = ranked.withColumn("_split", F.explode(F.sequence(F.lit(0), F.col("_splits") - 1))).drop("_splits")
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])
    among = F.when(F.col("_value").isNull(), F.lit(NULL_SPLITS)).otherwise(F.coalesce("_splits", F.lit(1)))
    key = F.col(score).cast("double") + F.lit(0.0)
    rows = df.withColumn("_value", F.when(~F.isnan(key), key)).join(frequent, "_value", "left")
    rows = rows.withColumn("_split", F.pmod(hashed, among).cast("int"))
    return rows.join(visiting, ["_value", "_split"], "left").select(*[F.col(f"`{c}`") for c in df.columns], rank)


def average_ranks(df: DataFrame, score: str, rank: str, descending: bool = True) -> DataFrame:
    """Average rank cut to an integer, as published."""
    ranked = fractional_ranks(df, score, rank, descending)
    return ranked.withColumn(rank, F.floor(rank).cast("int"))
