"""Exact k-nearest-neighbour joins that avoid all-pairs work.

Results are edge tables ``(site_id, peer_id, rank, distance)``; a site is never
its own neighbour and ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewatch import constants as C
from sitewatch.functions import geo
from sitewatch.functions.numeric import is_finite
from sitewatch.operators.checkpoints import cut
from sitewatch.operators.skew import hot_keys, split_hot_join

DEEPEST = 50  # cell numbers beyond this are finer than doubles of the size of the root square
LEVELS_A_ROUND = 4
SPLIT_ROWS = 200_000
SPREAD = 16  # tasks that a crowded cell's positions are dealt over while cells are split


def top_k(pairs: DataFrame, k: int, distance: str) -> DataFrame:
    """The k smallest distances per site (Spark cuts each task's part to k first)."""
    order = Window.partitionBy("site_id").orderBy(distance, "peer_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# --- points in the plane or on the sphere -------------------------------------


class _Plane:
    """Cells and distances of one metric over columns ``px, py``.

    ``side`` is the edge of the root square and ``x0, y0`` its lower corner.
    """

    def __init__(self, x0: float, y0: float, side: float):
        self.x0, self.y0, self.side = x0, y0, side

    def cell(self, level: Column) -> tuple[Column, Column]:
        width = F.lit(self.side) / F.pow(F.lit(2.0), level)
        return (
            F.floor((F.col("px") - self.x0) / width),
            F.floor((F.col("py") - self.y0) / width),
        )

    def distance(self) -> Column:
        return F.sqrt(
            F.pow(F.col("px") - F.col("qx"), F.lit(2.0))
            + F.pow(F.col("py") - F.col("qy"), F.lit(2.0))
        )

    def half_box(self, reach: Column) -> tuple[Column, Column]:
        return reach, reach

    def wrap(self, span: Column, level: Column) -> Column:
        return span


class _Sphere(_Plane):
    """Longitude and latitude in degrees; distance in metres; the x axis wraps."""

    def __init__(self):
        super().__init__(-180.0, -180.0, 360.0)

    def distance(self) -> Column:
        return geo.haversine(
            F.col("py"), F.col("px"), F.col("qy"), F.col("qx"), C.EARTH_RADIUS_M
        )

    def half_box(self, reach: Column) -> tuple[Column, Column]:
        return geo.lon_window(F.col("py"), reach), geo.lat_window(reach)

    def wrap(self, span: Column, level: Column) -> Column:
        cells = F.pow(F.lit(2.0), level).cast("long")
        return F.array_distinct(F.transform(span, lambda c: F.pmod(c, cells)))


def _positions(points: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """Points at one place collapse to a position that keeps its ``keep`` smallest ids.

    Returns the kept members (``site_id, px, py``) and the positions (``pid, px, py, _kept``).
    """
    by_id = Window.partitionBy("px", "py").orderBy("site_id")
    members = points.select("site_id", "px", "py").withColumn("_nth", F.row_number().over(by_id))
    members = cut(members.where(F.col("_nth") <= keep).drop("_nth"), "members")
    positions = members.groupBy("px", "py").agg(F.count(F.lit(1)).alias("_kept"), F.min("site_id").alias("pid"))
    return members, cut(positions, "positions")


class _Index:
    """The positions of one table in the nested cells of a quadtree.

    Which levels there are is read off the data, a few levels at a time: as long as some cell
    holds more than ``need`` positions, the positions of such cells are split further. A level
    at which no such cell falls apart is left out, so an outlier far away costs one level.
    """

    KEYS = ("level", "cx", "cy")

    def __init__(self, positions: DataFrame, space: _Plane, need: int):
        self.space, self.need = space, need
        self.levels = self._split(positions)
        cx, cy = space.cell(F.col("level"))
        nested = positions.withColumn("level", F.explode(F.array(*[F.lit(x) for x in self.levels])))
        nested = nested.select("pid", "px", "py", "_kept", "level", cx.alias("cx"), cy.alias("cy"))
        self.hot = cut(hot_keys(nested, list(self.KEYS), SPLIT_ROWS), "hot")
        held = nested.groupBy(*self.KEYS).agg(F.sum("_kept").alias("_held"))
        self.full = held.where(F.col("_held") >= need).select(*self.KEYS)
        self.stored = nested.select(
            *self.KEYS, F.col("pid").alias("qid"), F.col("px").alias("qx"), F.col("py").alias("qy"), "_kept"
        )

    def _split(self, positions: DataFrame) -> list[int]:
        levels, deepest, crowded, parts = [0], 0, positions.select("px", "py"), 1
        while deepest < DEEPEST:
            steps = list(range(deepest + 1, min(deepest + LEVELS_A_ROUND, DEEPEST) + 1))
            cx, cy = self.space.cell(F.col("level"))
            celled = crowded.withColumn("level", F.explode(F.array(*[F.lit(x) for x in steps])))
            cells = celled.groupBy("level", cx.alias("cx"), cy.alias("cy")).agg(F.count(F.lit(1)).alias("_n"))
            cells = cut(cells, "cells")
            found = {
                r["level"]: r
                for r in cells.groupBy("level")
                .agg(F.count(F.lit(1)).alias("cells"), F.max("_n").alias("most"), F.count_if(F.col("_n") > self.need).alias("full"))
                .collect()
            }
            for level in steps:
                if level in found and found[level]["cells"] > parts:
                    levels.append(level)
                    parts = found[level]["cells"]
                if level in found and found[level]["most"] <= self.need:
                    return levels
            deepest = steps[-1]
            if deepest not in found:
                return levels
            parts = found[deepest]["full"]
            over = cells.where((F.col("level") == deepest) & (F.col("_n") > self.need)).select("cx", "cy")
            cx, cy = self.space.cell(F.lit(deepest))
            placed = crowded.withColumns({"cx": cx, "cy": cy})
            spread = F.pmod(F.xxhash64("px", "py"), F.lit(SPREAD)).cast("int")
            over = over.withColumn("_split", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
            crowded = placed.withColumn("_split", spread).join(over, ["cx", "cy", "_split"], "left_semi").select("px", "py")
            crowded = cut(crowded, "crowded")
        return levels

    def near(self, queries: DataFrame) -> DataFrame:
        """``pid, qid, _d, _kept``: per query all positions that can be among the nearest.

        1. The *home* of a query is its deepest cell that holds ``need`` points, so few
           queries share a home level in any one cell however dense the cell is.
        2. The distance that offers ``need`` points inside the home cell bounds the search.
        3. The box around that circle names the cells that can hold a neighbour.
        """
        keys, cx, cy = list(self.KEYS), *self.space.cell(F.col("level"))
        nested = queries.withColumn("level", F.explode(F.array(*[F.lit(x) for x in self.levels])))
        nested = nested.select("pid", "level", cx.alias("cx"), cy.alias("cy"))
        homes = split_hot_join(self.full, nested, keys, "pid", SPLIT_ROWS).groupBy("pid").agg(F.max("level").alias("level"))
        # Too few points anywhere for a full cell: the root square holds them all.
        queries = queries.join(homes, "pid", "left").select("pid", "px", "py", F.coalesce("level", F.lit(0)).alias("level"))
        queries = cut(queries, "queries")
        at_home = queries.select("*", cx.alias("cx"), cy.alias("cy"))
        inside = split_hot_join(at_home, self.stored, keys, "qid", SPLIT_ROWS, self.hot)
        reach = _kth_distance(inside.withColumn("_d", self.space.distance()), self.need)
        cover = _cover(queries.join(reach, "pid", "left"), self.space, self.levels)
        return (
            split_hot_join(cover, self.stored, keys, "qid", SPLIT_ROWS, self.hot)
            .withColumn("_d", self.space.distance())
            .where(F.col("_d") <= F.col("_reach"))
            .select("pid", "qid", "_d", "_kept")
        )


def _offers(links: DataFrame, members: DataFrame, positions: DataFrame) -> DataFrame:
    """``pid, _peers``: the members of the positions that a position is linked with, nearest first.

    A position has a bounded number of links and members, so the lists are bounded.
    """
    named = members.join(positions.select("px", "py", F.col("pid").alias("qid")), ["px", "py"])
    return (
        links.join(named.select("qid", F.col("site_id").alias("peer_id")), "qid")
        .groupBy("pid")
        .agg(F.array_sort(F.collect_list(F.struct("distance", "peer_id"))).alias("_peers"))
    )


def _listed(offers: DataFrame, positions: DataFrame, points: DataFrame, peers: Column) -> DataFrame:
    """Back from positions to points, of which very many may share a place."""
    own = split_hot_join(
        positions.select("px", "py", "pid"), points.select("site_id", "px", "py"), ["px", "py"], "site_id", SPLIT_ROWS
    ).select("site_id", "pid")
    listed = split_hot_join(offers, own, ["pid"], "site_id", SPLIT_ROWS).select("site_id", peers.alias("_peers"))
    return listed.select("site_id", F.posexplode("_peers").alias("_at", "_peer")).select(
        "site_id",
        F.col("_peer.peer_id").alias("peer_id"),
        (F.col("_at") + 1).alias("rank"),
        F.col("_peer.distance").alias("distance"),
    )


def _nearest_positions(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("pid").orderBy("_d", "qid")
    near = near.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k)
    return near.select("pid", "qid", F.col("_d").alias("distance"))


def _knn_points(points: DataFrame, k: int, space: _Plane) -> DataFrame:
    """k nearest other points for ``points(site_id, px, py)``, all finite.

    A position keeps k+1 ids, as more could never be anybody's neighbour; it links to the
    nearest other positions and to itself. Work is linear in the number of points; no step
    pairs a whole group with itself.
    """
    members, positions = _positions(points, k + 1)
    near = _Index(positions, space, k + 1).near(positions.select("pid", "px", "py"))
    itself = positions.select("pid", F.col("pid").alias("qid"), F.lit(0.0).alias("distance"))
    links = _nearest_positions(near.where(F.col("pid") != F.col("qid")), k).unionByName(itself)
    others = F.filter("_peers", lambda p: p["peer_id"] != F.col("site_id"))
    return _listed(_offers(links, members, positions), positions, points, F.slice(others, 1, k))


def nearest_targets(origins: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of another table on the map: ``(site_id, peer_id, rank, distance_m)``.

    ``origins`` has ``site_id, lat, lon`` and ``targets`` ``peer_id, lat, lon``; rows without
    finite coordinates take no part, ties go to the smaller ``peer_id``. A limit on the
    distance is for the caller to apply: it plays no part in the search, so a crowded
    neighbourhood costs no more than a sparse one.
    """
    here = _on_map(origins, "site_id")
    there = _on_map(targets, "peer_id")
    members, positions = _positions(there, k)
    spots = here.groupBy("px", "py").agg(F.min("site_id").alias("pid"))
    spots = cut(spots, "spots")
    near = _Index(positions, _Sphere(), k).near(spots.select("pid", "px", "py"))
    offers = _offers(_nearest_positions(near, k), members, positions)
    found = _listed(offers, spots, here, F.slice("_peers", 1, k))
    return found.withColumnRenamed("distance", "distance_m")


def _on_map(df: DataFrame, id_column: str) -> DataFrame:
    return df.where(is_finite(F.col("lat")) & is_finite(F.col("lon"))).select(
        F.col(id_column).alias("site_id"), F.col("lon").cast("double").alias("px"), F.col("lat").cast("double").alias("py")
    )


def _kth_distance(inside: DataFrame, need: int) -> DataFrame:
    """Distance within which a query's home cell already offers ``need`` points."""
    order = Window.partitionBy("pid").orderBy("_d", "qid")
    return (
        inside.withColumn("_nth", F.row_number().over(order))
        .where(F.col("_nth") <= need)
        .groupBy("pid")
        .agg(F.max("_d").alias("_far"), F.sum("_kept").alias("_seen"))
        .select("pid", F.when(F.col("_seen") >= need, F.col("_far")).alias("_reach"))
    )


def _cover(queries: DataFrame, space: _Plane, levels: list[int]) -> DataFrame:
    """Cells that the search box of each query touches, at most ten along an axis.

    They are cells of the deepest level there is that is coarse enough.
    """
    unlimited = F.lit(space.side * 1e6)
    reach = F.coalesce(F.col("_reach") * (1 + 1e-9) + 1e-9, unlimited)
    dx, dy = space.half_box(F.col("_reach"))
    boxed = (
        queries.withColumn("_reach", reach)
        .withColumn("_dx", F.least(dx, F.lit(space.side)))
        .withColumn("_dy", F.least(dy, F.lit(space.side)))
    )
    widest = F.greatest("_dx", "_dy", F.lit(space.side * 1e-12))
    coarse = F.least(F.col("level"), F.floor(F.log2(F.lit(4 * space.side) / widest))).cast("int")
    fitting = F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x <= coarse)
    boxed = boxed.withColumn("level", F.coalesce(F.array_max(fitting), F.lit(0)))
    cells = F.pow(F.lit(2.0), F.col("level"))
    width = F.lit(space.side) / cells

    def span(centre: str, half: str, origin: float) -> Column:
        low = F.floor((F.col(centre) - F.col(half) - origin) / width)
        high = F.floor((F.col(centre) + F.col(half) - origin) / width)
        return F.sequence(low, F.least(high, low + cells.cast("long")))

    return (
        boxed.withColumn("cy", F.explode(span("py", "_dy", space.y0)))
        .withColumn("cx", F.explode(space.wrap(span("px", "_dx", space.x0), F.col("level"))))
        .select("pid", "px", "py", "level", "cx", "cy", "_reach")
    )


def _measure(points: DataFrame) -> tuple[float, float, float]:
    """Lower corner and extent: three numbers on the driver."""
    row = points.agg(
        F.min("px").alias("x0"),
        F.max("px").alias("x1"),
        F.min("py").alias("y0"),
        F.max("py").alias("y1"),
    ).first()
    if row["x0"] is None:
        return 0.0, 0.0, 1.0
    return row["x0"], row["y0"], max(row["x1"] - row["x0"], row["y1"] - row["y0"])


def geographic_neighbours(sites: DataFrame, k: int = 20) -> DataFrame:
    """k nearest sites on the map: ``(site_id, peer_id, rank, distance_m)``.

    Sites without finite coordinates take no part; fewer than three located sites
    give no edges at all.
    """
    located = _on_map(sites, "site_id")
    n = located.count()
    edges = _knn_points(located, k, _Sphere()).withColumnRenamed("distance", "distance_m")
    return edges if n >= 3 else edges.limit(0)


def planar_neighbours(points: DataFrame, k: int, x: str = "x", y: str = "y") -> DataFrame:
    """k nearest points by Euclidean distance in the plane."""
    usable = points.where(is_finite(F.col(x)) & is_finite(F.col(y))).select(
        "site_id", F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")
    )
    x0, y0, extent = _measure(usable)
    return _knn_points(usable, k, _Plane(x0, y0, extent * 1.0001 or 1.0))


# --- vectors of any length ------------------------------------------------------

LEAST_MOST_PIVOTS = 512  # more than this many pivots only as the root of the row count
TILE_ROWS = 2_000
BLOCK_ROWS = 20_000
#: Members of pivots that lie together and meet the offered rows in one tile, at most.
PACK_ROWS = 20_000


def _packs(pivots: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per pivot its first pack and its number of packs.

    Pivots are strung together, each followed by the nearest one left, and cut into packs of
    ``PACK_ROWS`` members at most. A pivot of more members has packs of its own.
    """
    first, parts = np.zeros(len(pivots), dtype=int), np.ones(len(pivots), dtype=int)
    left, at, pack, held = np.ones(len(pivots), dtype=bool), 0, 0, 0
    for _ in range(len(pivots)):
        left[at] = False
        if held and held + members[at] > PACK_ROWS:
            pack, held = pack + 1, 0
        first[at], parts[at] = pack, max(1, -(-members[at] // PACK_ROWS))
        held += members[at]
        if parts[at] > 1:
            pack, held = pack + parts[at], 0
        if left.any():
            at = int(np.where(left, ((pivots - pivots[at]) ** 2).sum(axis=1), np.inf).argmin())
    return first, parts


def vector_neighbours(vectors: DataFrame, k: int, column: str = "vector") -> DataFrame:
    """k nearest vectors by Euclidean distance: ``(site_id, peer_id, rank, distance)``.

    Each row belongs to its nearest pivot. For a pivot, the farthest member and the
    distance to the (k+1)-th nearest row bound how far any neighbour of a member can
    lie, and the triangle inequality then names the rows that may be neighbours.
    Members of neighbouring pivots meet those rows in tiles of limited size, cut by hash, so
    that a crowded pivot is many tiles and a row is sent once per tile, not once per pivot;
    numpy keeps k rows per member and tile and one window merges them. The result is exact; only the work depends on how well pivots separate. Rows
    with a missing or non-finite component have no neighbours and are none.
    """
    whole = F.forall(column, lambda v: F.coalesce(is_finite(v.cast("double")), F.lit(False)))
    rows = vectors.where(F.col(column).isNotNull() & whole).select(
        F.col("site_id").cast("string").alias("site_id"),
        F.transform(column, lambda v: v.cast("double")).alias("vector"),
    )
    n = rows.count()
    # Pivots grow as the root of n, so tables of pivots stay small and tiles do not grow as n.
    wanted = max(1, min(n // TILE_ROWS, max(LEAST_MOST_PIVOTS, math.isqrt(n))))
    chosen = rows.orderBy(F.xxhash64("site_id"), "site_id").limit(wanted).collect()
    if not chosen:
        return rows.select(
            "site_id",
            F.col("site_id").alias("peer_id"),
            F.lit(0.0).alias("distance"),
            F.lit(0).alias("rank"),
        ).where(F.lit(False))
    pivots = np.array([r["vector"] for r in chosen], dtype=float)

    placed = rows.mapInPandas(
        _nearest_pivot(pivots), "site_id string, vector array<double>, pivot int, pivot_distance double"
    )
    placed = cut(placed, "placed")
    close = Window.partitionBy("pivot").orderBy("pivot_distance", "site_id")
    nearest = (
        placed.select("pivot", "pivot_distance", "site_id")
        .withColumn("_nth", F.row_number().over(close))
        .where(F.col("_nth") <= k + 1)
        .groupBy("pivot")
        .agg(F.count(F.lit(1)).alias("_held"), F.max("pivot_distance").alias("_kth"))
    )
    extent = placed.groupBy("pivot").agg(
        F.count(F.lit(1)).alias("members"), F.max("pivot_distance").alias("radius")
    )
    bounds = extent.join(nearest, "pivot").select(
        "pivot",
        "members",
        F.when(F.col("_held") >= k + 1, 2 * F.col("radius") + F.col("_kth")).alias("limit"),
    )
    table = bounds.collect()  # one row of three numbers per pivot
    limits = np.full(len(pivots), -1.0)
    held = np.zeros(len(pivots), dtype=int)
    for r in table:
        limits[r["pivot"]] = np.inf if r["limit"] is None else r["limit"] * (1 + 1e-9) + 1e-12
        held[r["pivot"]] = r["members"]
    first, parts = _packs(pivots, held)
    blocks = -(-n // BLOCK_ROWS)

    def of_pivot(numbers: np.ndarray) -> Column:
        return F.element_at(F.array(*[F.lit(int(x)) for x in numbers]), F.col("pivot") + 1)

    members = placed.select(
        (of_pivot(first) + F.pmod(F.xxhash64("site_id"), of_pivot(parts))).cast("int").alias("pack"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        "pivot",
        "site_id",
        "vector",
    )
    offered = (
        placed.select("site_id", "vector")
        .mapInPandas(_reachable_packs(pivots, limits, first, parts), "site_id string, vector array<double>, pack int")
        .withColumn("block", F.pmod(F.xxhash64("site_id", F.lit(1)), F.lit(blocks)).cast("int"))
        .select("pack", "block", "site_id", "vector")
    )
    pairs = (
        members.groupBy("pack", "block")
        .cogroup(offered.groupBy("pack", "block"))
        .applyInPandas(_pack_top_k(k, pivots, limits), "site_id string, peer_id string, distance double")
    )
    return top_k(pairs, k, "distance")


def _nearest_pivot(pivots: np.ndarray):
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            best, at = None, None
            data = np.stack(batch["vector"].to_numpy())
            for index, pivot in enumerate(pivots):
                d = np.linalg.norm(data - pivot, axis=1)
                if best is None:
                    best, at = d, np.zeros(len(d), dtype=np.int32)
                else:
                    closer = d < best
                    best[closer], at[closer] = d[closer], index
            yield batch.assign(pivot=at.astype("int32"), pivot_distance=best)

    return assign


def _reachable_packs(pivots: np.ndarray, limits: np.ndarray, first: np.ndarray, parts: np.ndarray):
    def offer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            data = np.stack(batch["vector"].to_numpy())
            for start in np.unique(first):
                hit = np.zeros(len(data), dtype=bool)
                for index in np.flatnonzero(first == start):
                    hit |= np.linalg.norm(data - pivots[index], axis=1) <= limits[index]
                if hit.any():
                    for pack in range(start, start + parts[first == start].max()):
                        yield batch[hit].assign(pack=np.int32(pack))

    return offer


def _pack_top_k(k: int, pivots: np.ndarray, limits: np.ndarray):
    """Per pivot of a tile its members and those of the offered rows that it can reach."""
    tile = _tile_top_k(k)

    def nearest(members: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        if members.empty or offered.empty:
            return tile(members, offered)
        data = np.stack(offered["vector"].to_numpy())
        found = []
        for index, own in members.groupby("pivot"):
            near = np.linalg.norm(data - pivots[index], axis=1) <= limits[index]
            found.append(tile(own, offered[near]))
        return pd.concat(found, ignore_index=True)

    return nearest


def _tile_top_k(k: int, strip: int = 64):
    def nearest(members: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(
            {
                "site_id": pd.Series([], dtype=object),
                "peer_id": pd.Series([], dtype=object),
                "distance": pd.Series([], dtype="float64"),
            }
        )
        if members.empty or offered.empty:
            return empty
        offered = offered.sort_values("site_id", kind="stable")
        peer_ids = offered["site_id"].to_numpy()
        peers = np.stack(offered["vector"].to_numpy())
        ids = members["site_id"].to_numpy()
        data = np.stack(members["vector"].to_numpy())
        square = (peers * peers).sum(axis=1)
        owners, found, lengths = [], [], []
        for start in range(0, len(ids), strip):
            rows = data[start : start + strip]
            # Expanded squares only shortlist; kept distances are computed directly.
            rough = square - 2.0 * rows @ peers.T + (rows * rows).sum(axis=1)[:, None]
            for offset, line in enumerate(rough):
                site = ids[start + offset]
                if len(line) > k + 1:
                    cut = np.partition(line, k)[k]
                    slack = 1e-7 * (1.0 + abs(cut) + square.max(initial=0.0))
                    near = np.flatnonzero(line <= cut + slack)
                else:
                    near = np.arange(len(line))
                near = near[peer_ids[near] != site]
                exact = np.sqrt(((peers[near] - rows[offset]) ** 2).sum(axis=1))
                order = np.argsort(exact, kind="stable")[:k]
                owners.append(np.full(len(order), site, dtype=object))
                found.append(peer_ids[near][order])
                lengths.append(exact[order])
        return pd.DataFrame(
            {
                "site_id": np.concatenate(owners),
                "peer_id": np.concatenate(found),
                "distance": np.concatenate(lengths),
            }
        )

    return nearest


# --- shortlist in the plane, refined in chemistry --------------------------------


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, s: acc + s))


def pair_distances(edges: DataFrame, vectors: DataFrame, name: str = "distance") -> DataFrame:
    """Vector distance for given pairs; missing components count as 0."""
    filled = vectors.select(
        "site_id",
        F.transform(
            "vector", lambda v: F.coalesce(F.when(is_finite(v), v.cast("double")), F.lit(0.0))
        ).alias("vector"),
    )
    left = filled.withColumnRenamed("vector", "_a")
    right = filled.select(F.col("site_id").alias("peer_id"), F.col("vector").alias("_b"))
    return (
        edges.join(left, "site_id")
        .join(right, "peer_id")
        .select("site_id", "peer_id", euclidean(F.col("_a"), F.col("_b")).alias(name))
    )


def refine_shortlist(shortlist: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    return top_k(pair_distances(shortlist.select("site_id", "peer_id"), vectors), k, "distance")


def shortlist_refine(
    points: DataFrame, vectors: DataFrame, shortlist_k: int = 50, k: int = 5, x: str = "x", y: str = "y"
) -> DataFrame:
    """Shortlist by plane distance, then the k nearest of it by vector distance."""
    shortlist = planar_neighbours(points, shortlist_k, x, y)
    return refine_shortlist(shortlist, vectors, min(k, shortlist_k))
