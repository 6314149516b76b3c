"""Hard negatives by angular triangle filtering.

Every row stores its norm and its angles to a few reference directions. For two rows with
angles ``s`` and ``t`` to one direction, the angle between them lies between ``|s - t|`` and
``min(s + t, 2 pi - s - t)``; over all directions the narrowest interval counts. Its cosines
times the norms, widened by more than the rounding errors, bound the score. Only pairs
whose bounds overlap a window that is still open get their integer score: for positives
the scores from the worst kept one up, for negatives the scores between two shares of a
positive's. Bounds of a whole tile of rows are tried before those of single rows.

Anchors and rows meet in blocks: every block of anchors (a hash of the id) is paired with
every block of rows, and each pair of blocks is one group of a grouped join. Blocks have
about ``BLOCK`` members, so a task holds two of them, whatever the tables and labels hold.
A pair of blocks returns the best few of each anchor; those are ranked by a window.

Defined results: rows with a null id, a null label, a null vector or a null, NaN or
infinite component take no part. Shorter vectors count as filled with zeros. Of several
rows with one id, the one with the smallest (label, vector) takes part, once. Scores are
exact; one beyond 64 bits becomes the nearest 64-bit integer. Higher scores come first,
ties by smaller id. An anchor without positives, and a positive whose window is empty (any
negative score), have no rows in the result. Empty tables give empty results. Further columns, whatever
their names, do not matter. Ids must be integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewatch.llm.common import own_names
from sitewatch.operators.checkpoints import cut

SCALE = 256
#: Rows, and anchors, that a block has on average.
BLOCK = 8192
TILE_ROWS, TILE_ANCHORS = 1024, 512
#: Reference directions, found on so many rows with the smallest hashes. They only steer.
DIRECTIONS, FITTED_ROWS = 8, 512
#: More than the rounding errors of stored angles (radians), cosines and products.
ANGLE_SLACK, COSINE_SLACK = 4e-6, 4e-6
#: Above this share of open pairs a tile is scored as one matrix product.
DENSE = 0.05
LIMIT = 2**63 - 1
#: Components beyond this count as this; all scores with them are beyond 64 bits or zero.
WIDEST = 1e150

STORED = "vec_id long, label string, x array<double>, norm double, angles array<float>"


def every_seventh_shifted(labels: int = 10) -> Column:
    """The label noise of the registered query."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))


def scaled_rows(df: DataFrame, label: Column | None = None) -> DataFrame:
    """``vec_id, label, x``: rows that take part, components as whole numbers, one row per id."""
    own = own_names(df, "vec_id", "label", "embedding")
    own = own.where("vec_id is not null and label is not null and embedding is not null")
    finite = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    # Large doubles are whole already, and beyond the 64-bit integers that F.floor returns.
    wide = lambda c: F.greatest(F.least(c, F.lit(WIDEST)), F.lit(-WIDEST)) * SCALE
    whole = F.transform("c", lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c * SCALE).cast("double")).otherwise(wide(c)) + F.lit(0.0))
    rows = (
        own.select(
            F.col("vec_id").cast("long"),
            (F.col("label") if label is None else label).cast("string").alias("label"),
            F.col("embedding").cast("array<double>").alias("c"),
        )
        .where(finite)
        .select("vec_id", "label", whole.alias("x"))
    )
    # Vectors are shuffled for the repeated ids only.
    repeated = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id")
    repeated = cut(repeated, "negatives_repeated")
    once = rows.join(repeated, "vec_id", "left_anti")
    first = rows.join(repeated, "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("s"))
    return once.unionByName(first.select("vec_id", "s.label", "s.x"))


def _stack(vectors: list | np.ndarray, dimension: int) -> np.ndarray:
    out = np.zeros((len(vectors), dimension))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1.0)


def _reference_directions(rows: DataFrame, dimension: int) -> np.ndarray:
    """Means of the directions of a bounded sample, by a few rounds of assignment."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FITTED_ROWS).select("x").collect()
    if not sample or not dimension:
        return np.zeros((1, dimension))
    units = _unit(_stack([row["x"] for row in sample], dimension))
    directions = units[:DIRECTIONS]
    for _ in range(5):
        nearest = (units @ directions.T).argmax(axis=1)
        means = [units[nearest == k].mean(axis=0) if (nearest == k).any() else directions[k] for k in range(len(directions))]
        directions = _unit(np.array(means))
    return directions


def with_angles(rows: DataFrame) -> DataFrame:
    """Written rows with their norms and angles to the reference directions."""
    dimension = rows.agg(F.max(F.size("x"))).first()[0] or 0
    directions = _reference_directions(rows, dimension)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column("x"), dimension)
            norms = np.linalg.norm(x, axis=1)
            cosines = np.clip(_unit(x) @ directions.T, -1.0, 1.0)
            angles = np.arccos(cosines).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), _lists(x), pa.array(norms), _lists(angles)],
                names=["vec_id", "label", "x", "norm", "angles"],
            )

    return cut(rows.mapInArrow(store, STORED), "negatives_rows")


def _lists(values: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, values.size + 1, max(values.shape[1], 1), dtype=np.int32)[: len(values) + 1]
    if values.shape[1] == 0:
        offsets = np.zeros(len(values) + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def _vectors(column: pa.Array, dimension: int) -> np.ndarray:
    """A list column as a matrix; short lists are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dimension).all():
        return flat.reshape(len(lengths), dimension)
    out = np.zeros((len(lengths), dimension), dtype=flat.dtype)
    out[np.arange(dimension) < lengths[:, None]] = flat
    return out


class _Side:
    """Rows of one block as arrays."""

    def __init__(self, table: pa.Table, id_column: str) -> None:
        self.ids = table.column(id_column).to_numpy()
        self.labels = np.array(table.column("label").to_pylist(), dtype=object)
        self.norms = table.column("norm").to_numpy()
        width = max(map(len, table.column("x").to_pylist()), default=0) if table.num_rows else 0
        self.x = _vectors(table.column("x"), width)
        self.angles = _vectors(table.column("angles"), len(table.column("angles")[0]) if table.num_rows else 0)

    def part(self, where: np.ndarray) -> _Side:
        out = object.__new__(_Side)
        for name in ("ids", "labels", "norms", "x", "angles"):
            setattr(out, name, getattr(self, name)[where])
        return out

    def ordered(self) -> _Side:
        """Rows with like angles beside each other, so that tiles have narrow intervals."""
        nearest = self.angles.argmin(axis=1)
        return self.part(np.lexsort((self.angles.min(axis=1), nearest)))


def _score_bounds(angles: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray):
    """Lowest and highest possible score of every anchor with every row (or tile of rows).

    A row has equal ``low`` and ``high`` angles and ``least`` and ``most`` norms; a tile
    has the ends of its rows.
    """
    near = np.zeros((len(angles), len(low)), dtype=np.float32)
    far = np.full_like(near, np.pi)
    for k in range(angles.shape[1]):
        a = angles[:, k : k + 1]
        np.maximum(near, np.maximum(a - high[:, k], low[:, k] - a), out=near)
        np.minimum(far, np.minimum(a + high[:, k], np.float32(2 * np.pi) - a - low[:, k]), out=far)
    top = np.cos(np.maximum(near - ANGLE_SLACK, 0)) + COSINE_SLACK
    bottom = np.cos(np.minimum(far + ANGLE_SLACK, np.pi)) - COSINE_SLACK
    norms = norms[:, None]
    upper = norms * np.where(top > 0, most, least) * top
    lower = norms * np.where(bottom > 0, least, most) * bottom
    return lower - 1 - 1e-9 * np.abs(lower), upper + 1 + 1e-9 * np.abs(upper)


def _scores(a: _Side, rows: _Side, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact integer products of the given pairs."""
    if a.norms.max(initial=0) * rows.norms.max(initial=0) < 2.0**52:
        if len(one) > DENSE * len(a.ids) * len(rows.ids):
            return (a.x @ rows.x.T)[one, other].astype(np.int64)
        return np.einsum("ij,ij->i", a.x[one], rows.x[other]).astype(np.int64)
    exact = [sum(int(u) * int(v) for u, v in zip(a.x[i], rows.x[j])) for i, j in zip(one, other)]
    return np.array([max(-LIMIT - 1, min(LIMIT, s)) for s in exact], dtype=np.int64)


def _same_width(a: _Side, b: _Side) -> None:
    width = max(a.x.shape[1], b.x.shape[1])
    for side in (a, b):
        if side.x.shape[1] < width:
            side.x = np.pad(side.x, ((0, 0), (0, width - side.x.shape[1])))


def _tiles(a: _Side, rows: _Side, window) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor places, row places and scores of the pairs whose bounds overlap ``window()``.

    ``window()`` gives the lowest and highest score that each anchor still needs; it is asked
    again before every tile.
    """
    for start in range(0, len(rows.ids), TILE_ROWS):
        tile = rows.part(np.arange(start, min(start + TILE_ROWS, len(rows.ids))))
        low, high = window()
        ends = (tile.angles.min(axis=0)[None], tile.angles.max(axis=0)[None], tile.norms.min(keepdims=True), tile.norms.max(keepdims=True))
        below, above = _score_bounds(a.angles, a.norms, *ends)
        open_ones = np.flatnonzero((above[:, 0] >= low) & (below[:, 0] <= high))
        for begin in range(0, len(open_ones), TILE_ANCHORS):
            places = open_ones[begin : begin + TILE_ANCHORS]
            some = a.part(places)
            below, above = _score_bounds(some.angles, some.norms, tile.angles, tile.angles, tile.norms, tile.norms)
            one, other = np.nonzero((above >= low[places, None]) & (below <= high[places, None]))
            yield places[one], start + other, _scores(some, tile, one, other)


class _Best:
    """The best ``k`` (score, id) per group; ``worst`` is what a newcomer must reach."""

    def __init__(self, groups: int, k: int, floor: np.ndarray) -> None:
        self.k, self.groups = k, groups
        self.group = np.empty(0, dtype=np.int64)
        self.score, self.id = self.group, self.group
        self.worst = floor.astype(np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        kept = place < self.k
        self.group, self.score, self.id = group[kept], score[kept], ids[kept]
        last = place == self.k - 1
        self.worst[group[last]] = np.maximum(self.worst[group[last]], score[last])


def _positives_of_blocks(k: int):
    def best(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if anchors.num_rows and rows.num_rows:
            a_all, r_all = _Side(anchors, "vec_id"), _Side(rows, "vec_id")
            _same_width(a_all, r_all)
            for label in set(a_all.labels) & set(r_all.labels):
                a, r = a_all.part(a_all.labels == label), r_all.part(r_all.labels == label).ordered()
                found = _Best(len(a.ids), k, np.full(len(a.ids), -LIMIT))
                highest = np.full(len(a.ids), np.inf)
                for one, other, scores in _tiles(a, r, lambda: (found.worst.astype(np.float64), highest)):
                    kept = (a.ids[one] != r.ids[other]) & (scores >= found.worst[one])
                    found.add(one[kept], scores[kept], r.ids[other[kept]])
                out.append((a.ids[found.group], found.id, found.score))
        joined = [np.concatenate(x) if out else np.empty(0, dtype=np.int64) for x in (zip(*out) if out else [(), (), ()])]
        return pa.table(dict(zip(("anchor_id", "other_id", "score"), map(pa.array, joined))))

    return best


def _negatives_of_blocks(k: int, low: int, high: int):
    def best(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        empty = np.empty(0, dtype=np.int64)
        group_anchor = group_positive = group_score = empty
        found = _Best(0, k, empty)
        if anchors.num_rows and rows.num_rows:
            a, r = _Side(anchors, "vec_id"), _Side(rows, "vec_id").ordered()
            _same_width(a, r)
            codes = {label: i for i, label in enumerate(set(a.labels) | set(r.labels))}
            a_code, r_code = (np.array([codes[x] for x in side.labels]) for side in (a, r))
            lists = anchors.column("positives").to_pylist()
            # One group per anchor and positive, in columns: group j * anchors + place.
            width = max(map(len, lists))
            n = len(lists)
            lower, upper = np.full(n * width, LIMIT), np.full(n * width, -LIMIT)
            group_anchor, group_positive, group_score = (np.zeros(n * width, dtype=np.int64) for _ in range(3))
            for place, positives in enumerate(lists):
                for j, p in enumerate(positives):
                    g = j * n + place
                    group_anchor[g], group_positive[g], group_score[g] = a.ids[place], p["other_id"], p["score"]
                    lower[g], upper[g] = -(-low * p["score"] // 100), high * p["score"] // 100
            found = _Best(n * width, k, lower)
            open_group = lower <= upper
            highest = np.where(open_group, upper, -LIMIT).reshape(width, n).max(axis=0).astype(np.float64)

            def window() -> tuple[np.ndarray, np.ndarray]:
                lowest = np.where(open_group, found.worst, LIMIT).reshape(width, n).min(axis=0)
                return lowest.astype(np.float64), highest

            for one, other, scores in _tiles(a, r, window):
                kept = a_code[one] != r_code[other]
                one, other, scores = one[kept], other[kept], scores[kept]
                for j in range(width):
                    g = j * n + one
                    fits = (scores >= found.worst[g]) & (scores <= upper[g])
                    found.add(g[fits], scores[fits], r.ids[other[fits]])
        g = found.group
        columns = (group_anchor[g], group_positive[g], group_score[g], found.id, found.score)
        names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        return pa.table(dict(zip(names, map(pa.array, columns))))

    return best


def _blocks_joined(anchors: DataFrame, rows: DataFrame, function, schema: str) -> DataFrame:
    """``function`` on every block of anchors with every block of rows."""
    n_anchor_blocks, n_row_blocks = (max(1, -(-side.count() // BLOCK)) for side in (anchors, rows))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(n_anchor_blocks)).cast("int")
    each_row_block = F.explode(F.sequence(F.lit(0), F.lit(n_row_blocks - 1)))
    a = anchors.withColumn("block_a", own).withColumn("block_r", each_row_block)
    each_anchor_block = F.explode(F.sequence(F.lit(0), F.lit(n_anchor_blocks - 1)))
    r = rows.withColumn("block_r", F.pmod(F.xxhash64("vec_id"), F.lit(n_row_blocks)).cast("int"))
    r = r.withColumn("block_a", each_anchor_block)
    keys = ["block_a", "block_r"]
    return a.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(function, schema)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` are those of :func:`scaled_rows`. The positives of an anchor are the best
    other rows of its label, the negatives of an anchor and a positive the best rows of
    other labels that score between ``low`` and ``high`` percent of what the positive scores.
    """
    stored = with_angles(rows)
    anchors = stored.where(is_anchor)
    near = _blocks_joined(anchors, stored, _positives_of_blocks(positives), "anchor_id long, other_id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    best = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    lists = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "other_id", "score"))).alias("positives"))
    known = cut(anchors.join(lists.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "negatives_anchors")
    found = _blocks_joined(
        known,
        stored,
        _negatives_of_blocks(negatives, low, high),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
