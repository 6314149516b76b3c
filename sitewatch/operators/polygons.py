"""Points in polygons by an index of edges, with holes and several parts.

A polygon is cut into its edges, listed under the grid cells that they touch, and into one
flag per cell: whether the cell's lower left corner lies inside. A point walks from there
to its own place, up the left border of the cell and then to the right, and every edge that
it crosses turns inside to outside. So only edges of the point's own cell are looked at,
however long the ring is, and holes and parts need no treatment of their own.

All tests ask on which side of an edge a place lies. They use one and the same sign for
both legs of the walk, and a place on an edge counts as shifted a hair to the right (and,
along a horizontal edge, up), so that the crossings of a closed ring always add up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewatch.functions import geo
from sitewatch.functions.numeric import is_finite
from sitewatch.operators.checkpoints import cut
from sitewatch.operators.skew import hot_keys, split_hot_join

ROWS_PER_SPLIT = 200_000
KEY = ["water_body_id", "_shape"]


def with_parts(polygons: DataFrame) -> DataFrame:
    """Polygons with ``parts``: an array of parts, each an outer ring and its holes.

    A table with ``ring`` instead has one part without holes. Rings are arrays of
    ``struct<x,y>``; the last vertex may repeat the first one.
    """
    if "parts" in polygons.columns:
        return polygons.drop("ring")
    return polygons.withColumn("parts", F.array(F.array("ring"))).drop("ring")


def edges(polygons: DataFrame) -> DataFrame:
    """``water_body_id, _shape, ax, ay, bx, by``: one row per edge of a distinct polygon."""
    shapes = with_parts(polygons).where("water_body_id is not null").select("water_body_id", "parts")
    shapes = shapes.withColumn("_shape", F.xxhash64("parts")).dropDuplicates(KEY)
    rings = shapes.select(*KEY, F.explode(F.flatten("parts")).alias("ring"))
    ring, size = F.col("ring"), F.size("ring")
    following = F.concat(F.slice(ring, 2, F.greatest(size - 1, F.lit(0))), F.slice(ring, 1, 1))
    pairs = F.zip_with(
        ring,
        following,
        lambda a, b: F.struct(*[p[c].cast("double").alias(f"{n}{c}") for n, p in (("a", a), ("b", b)) for c in ("x", "y")]),
    )
    listed = rings.where(size > 0).select(*KEY, F.inline(pairs))
    return listed.where(is_finite(F.col("ax")) & is_finite(F.col("ay")) & is_finite(F.col("bx")) & is_finite(F.col("by")))


def _side(x: Column, y: Column) -> Column:
    """1 if a place lies left of the edge as seen from its start, else -1."""
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    area = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    on_line = F.when(by != ay, F.signum(ay - by)).otherwise(F.signum(bx - ax))
    return F.when(area == 0, on_line).otherwise(F.signum(area))


def _right_of(x: Column, y: Column) -> Column:
    """The edge crosses the height of a place to the right of it."""
    spans = (F.col("ay") > y) != (F.col("by") > y)
    return spans & ((_side(x, y) > 0) == (F.col("by") > F.col("ay")))


def _above(x: Column, y: Column) -> Column:
    """The edge crosses the vertical through a place above it."""
    spans = (F.col("ax") > x) != (F.col("bx") > x)
    return spans & ((_side(x, y) < 0) == (F.col("bx") > F.col("ax")))


def _touched_cells(lines: DataFrame, cell: float) -> DataFrame:
    """Edges under every cell they touch; a hair of slack, as a cell too many does no harm."""
    slack = cell * 1e-6
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = lines.withColumn("cy", F.explode(F.sequence(F.floor((low - slack) / cell), F.floor((high + slack) / cell))))

    def x_at(y: Column) -> Column:
        slope = (F.col("bx") - F.col("ax")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0))
        return F.col("ax") + (y - F.col("ay")) * slope

    bottom, top = F.greatest(low, F.col("cy") * cell), F.least(high, (F.col("cy") + 1) * cell)
    one, other = F.coalesce(x_at(bottom), F.col("ax")), F.coalesce(x_at(top), F.col("bx"))
    left, right = F.least("ax", "bx"), F.greatest("ax", "bx")

    def inside(x: Column) -> Column:
        return F.least(F.greatest(x, left), right)

    first = F.floor((F.least(inside(one), inside(other)) - slack) / cell)
    last = F.floor((F.greatest(inside(one), inside(other)) + slack) / cell)
    return rows.withColumn("cx", F.explode(F.sequence(first, last)))


def _inside_corners(lines: DataFrame, cell: float) -> DataFrame:
    """``water_body_id, _shape, cx, cy`` of cells whose lower left corner lies inside.

    An edge lies right of the corners up to its crossing with the lower border of a row.
    Crossings that end at the same corner cancel in pairs, so at most one per cell is left;
    between every other two of them the corners are inside.
    """
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    spanned = F.sequence(F.ceil(low / cell), F.ceil(high / cell) - 1)
    rows = lines.where(F.ceil(high / cell) > F.ceil(low / cell)).withColumn("cy", F.explode(spanned))
    y = F.col("cy") * F.lit(cell)
    crossing = F.col("ax") + (y - F.col("ay")) * ((F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")))
    rows = rows.withColumn("_near", F.floor(crossing / cell))

    def passes(offset: int) -> Column:
        return _right_of((F.col("_near") + offset) * F.lit(cell), y)

    last = F.when(passes(1), F.col("_near") + 1).when(passes(0), F.col("_near")).otherwise(F.col("_near") - 1)
    odd = (
        rows.select(*KEY, "cy", last.alias("_last"))
        .groupBy(*KEY, "cy", "_last")
        .agg((F.count(F.lit(1)) % 2).alias("_odd"))
        .where("_odd = 1")
    )
    along = Window.partitionBy(*KEY, "cy").orderBy("_last")
    runs = odd.select(*KEY, "cy", "_last", F.lead("_last").over(along).alias("_next"), F.row_number().over(along).alias("_nth"))
    runs = runs.where("_nth % 2 = 1 and _next is not null")
    return runs.select(*KEY, F.explode(F.sequence(F.col("_last") + 1, F.col("_next"))).alias("cx"), "cy")


def point_in_polygon_join(sites: DataFrame, polygons: DataFrame, cell: float = 0.125) -> DataFrame:
    """Left join of sites to the polygon that holds them, lowest id first.

    ``polygons`` has ``water_body_id`` and ``parts`` or ``ring`` (see :func:`with_parts`). A
    point on an edge is not inside. The cell is rounded to a power of two, which makes
    borders of cells exact numbers. Crowded cells are split among tasks.
    """
    cell = 2.0 ** round(math.log2(cell))
    lines = cut(edges(polygons), "polygon_edges")
    placed = sites.where(is_finite(F.col("lat")) & is_finite(F.col("lon"))).select(
        "site_id",
        F.col("lon").cast("double").alias("x"),
        F.col("lat").cast("double").alias("y"),
        F.floor(F.col("lon") / cell).alias("cx"),
        F.floor(F.col("lat") / cell).alias("cy"),
    )
    cells = ["cx", "cy"]
    hot = cut(hot_keys(placed, cells, ROWS_PER_SPLIT), "crowded_cells")
    x, y, x0, y0 = F.col("x"), F.col("y"), F.col("cx") * F.lit(cell), F.col("cy") * F.lit(cell)
    walked = (
        (_above(x0, y0) != _above(x0, y)).cast("int") + (_right_of(x0, y) != _right_of(x, y)).cast("int")
    )  # up the border, then to the right
    near = split_hot_join(_touched_cells(lines, cell), placed, cells, "site_id", ROWS_PER_SPLIT, hot).select(
        "site_id", *KEY, walked.alias("_turns"), geo.on_segment(x, y).alias("_on_edge")
    )
    corners = split_hot_join(_inside_corners(lines, cell), placed, cells, "site_id", ROWS_PER_SPLIT, hot).select(
        "site_id", *KEY, F.lit(1).alias("_turns"), F.lit(False).alias("_on_edge")
    )
    hits = (
        near.unionByName(corners)
        .groupBy("site_id", *KEY)
        .agg(F.sum("_turns").alias("_turns"), F.max("_on_edge").alias("_on_edge"))
        .where("_turns % 2 = 1 and not _on_edge")
        .groupBy("site_id")
        .agg(F.min("water_body_id").alias("water_body_id"))
    )
    attributes = polygons.drop("ring", "parts")
    return sites.join(hits.join(attributes, "water_body_id"), "site_id", "left")


def centroids(polygons: DataFrame) -> DataFrame:
    """``water_body_id, lon, lat``: area centroids; holes count against the area.

    Polygons whose area vanishes have the mean of the vertices of their outer rings.
    """
    size = F.abs(F.col("_ring.w"))
    signed = F.when(F.col("_hole"), -size).otherwise(size)
    outer = F.when(~F.col("_hole"), F.lit(1.0)).otherwise(F.lit(0.0))

    def weighed(axis: str, weight: Column) -> Column:
        return F.sum(F.col(f"_ring.{axis}") * weight)

    parts = with_parts(polygons).select("water_body_id", F.explode("parts").alias("_part"))
    rings = parts.select("water_body_id", F.posexplode("_part").alias("_at", "_vertices"))
    rings = rings.select(
        "water_body_id", (F.col("_at") > 0).alias("_hole"), geo.ring_centroid(F.col("_vertices")).alias("_ring")
    )
    sums = rings.groupBy("water_body_id").agg(
        F.sum(signed).alias("_w"),
        weighed("x", signed).alias("_x"),
        weighed("y", signed).alias("_y"),
        F.sum(outer).alias("_n"),
        weighed("x", outer).alias("_px"),
        weighed("y", outer).alias("_py"),
    )
    area = F.col("_w") > 0
    return sums.select(
        "water_body_id",
        F.when(area, F.col("_x") / F.col("_w")).otherwise(F.col("_px") / F.col("_n")).alias("lon"),
        F.when(area, F.col("_y") / F.col("_w")).otherwise(F.col("_py") / F.col("_n")).alias("lat"),
    )
