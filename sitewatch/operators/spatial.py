"""Distance and containment joins as equi-joins on grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch import constants as C
from sitewatch.functions import geo
from sitewatch.functions.numeric import is_finite
from sitewatch.operators.checkpoints import cut
from sitewatch.operators.neighbours import nearest_targets
from sitewatch.operators.polygons import centroids, point_in_polygon_join  # noqa: F401
from sitewatch.operators.skew import split_hot_join


ROWS_PER_SPLIT = 200_000
ROWS_PER_FIELD = 20_000  # of each side; a task compares all pairs of a field of the grid


def _band_cells(band: Column, height: float, angle: float) -> Column:
    """Number of cells around the globe in a latitude band.

    A cell is at least as wide as half a circle anywhere in the band, so a circle never
    spans more than three cells of it; all cells of a band are equally wide, so that they
    go on across the date line.
    """
    farthest = F.greatest(F.abs(band * height), F.abs((band + 1) * height))
    cosine = F.cos(F.radians(F.least(farthest, F.lit(89.0))))
    width = F.degrees(F.asin(F.least(F.lit(math.sin(angle)) / cosine, F.lit(1.0))))
    return F.greatest(F.floor(F.lit(360.0) / width), F.lit(1))


def _located(df: DataFrame) -> DataFrame:
    return df.where(is_finite(F.col("lat")) & is_finite(F.col("lon")))


def radius_join(
    sites: DataFrame, points: DataFrame, radius_m: float = 2000.0, point_id: str = "point_id"
) -> DataFrame:
    """All (site, point) pairs at most ``radius_m`` apart, with ``distance_m``.

    Every point lies in one cell; a site visits the cells its circle touches. Only
    points of those cells are compared; a cell crowded with points, sites or both is split
    into a grid of both. Chords rule pairs in or out, so that only pairs returned and those
    at the very edge are measured. Cells go on across the date line. The site's
    ``site_id`` and all columns of ``points`` are kept, but for the coordinates.
    """
    angle = radius_m / C.EARTH_RADIUS_M
    height = math.degrees(angle)
    band = F.floor(F.col("lat") / height)
    kept = [c for c in points.columns if c not in ("lat", "lon")]
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    cells = _located(points).select(
        *[F.col(c) for c in kept],
        lat.alias("_plat"),
        lon.alias("_plon"),
        F.cos(F.radians(lat)).alias("_pcos"),
        *[c.alias(f"_p{n}") for n, c in zip("xyz", geo.unit_vector(lat, lon), strict=True)],
        band.alias("cy"),
        F.pmod(F.floor(F.col("lon") * _band_cells(band, height, angle) / 360.0), _band_cells(band, height, angle)).alias("cx"),
    )
    # A hair of slack keeps circles that end exactly on a cell border whole.
    half_lat = F.lit(height * (1 + 1e-9))
    half_lon = F.least(geo.lon_window(F.col("lat"), radius_m) * (1 + 1e-9), F.lit(180.0))
    visits = (
        _located(sites)
        .select(
            "site_id",
            lat.alias("lat"),
            lon.alias("lon"),
            F.cos(F.radians(lat)).alias("_cos"),
            *[c.alias(f"_{n}") for n, c in zip("xyz", geo.unit_vector(lat, lon), strict=True)],
        )
        .withColumn(
            "cy",
            F.explode(
                F.sequence(
                    F.floor((F.col("lat") - half_lat) / height),
                    F.floor((F.col("lat") + half_lat) / height),
                )
            ),
        )
        .withColumn("_cells", _band_cells(F.col("cy"), height, angle))
        .withColumn("_first", F.floor((F.col("lon") - half_lon) * F.col("_cells") / 360.0))
        .withColumn("_last", F.floor((F.col("lon") + half_lon) * F.col("_cells") / 360.0))
        .withColumn("cx", F.explode(F.sequence("_first", F.least("_last", F.col("_first") + F.col("_cells") - 1))))
        .withColumn("cx", F.pmod("cx", "_cells"))
        .drop("_cells", "_first", "_last")
    )
    distance = geo.haversine(
        *[F.col(c) for c in ("lat", "lon", "_plat", "_plon")], C.EARTH_RADIUS_M, (F.col("_cos"), F.col("_pcos"))
    )
    apart = [F.col(f"_{n}") - F.col(f"_p{n}") for n in "xyz"]
    chord2 = apart[0] * apart[0] + apart[1] * apart[1] + apart[2] * apart[2]
    inside, reach = geo.squared_chords(radius_m)
    tasks = int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(ROWS_PER_SPLIT, ROWS_PER_FIELD)
    return (
        split_hot_join(visits, cells, ["cx", "cy"], point_id, most, probe_id="site_id", tasks=tasks)
        .where((chord2 <= inside) | ((chord2 <= reach) & (distance <= radius_m)))
        .select("site_id", *kept, distance.alias("distance_m"))
    )


def radius_totals(
    sites: DataFrame,
    points: DataFrame,
    radius_m: float,
    at_place: dict[str, Column],
    around: dict[str, Column],
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """What lies within ``radius_m`` of each site, summed up per value of ``keys``.

    ``at_place`` sums up the points of one place, ``around`` those totals (and their
    ``distance_m``) about one spot. Only distinct spots and places are paired, so neither a
    crowded place nor a crowded spot multiplies rows. There is one row per row of ``sites``
    and value of ``keys``; sites with nothing around have none.
    """
    place = ["lat", "lon"]
    known = _located(points).withColumns({c: F.col(c).cast("double") + F.lit(0.0) for c in place})
    places = known.groupBy(*place, *keys).agg(*[total.alias(name) for name, total in at_place.items()])
    places = cut(places.withColumn("_place", F.xxhash64(*place, *keys)), "places")
    located = _located(sites).select("site_id", *[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in place])
    spots = cut(located.select(*place).distinct().withColumn("site_id", F.struct(*place)), "spots")
    near = radius_join(spots, places, radius_m, "_place")
    totals = near.groupBy("site_id", *keys).agg(*[total.alias(name) for name, total in around.items()])
    totals = totals.select("site_id.*", *keys, *around)
    return split_hot_join(totals, located, place, "site_id", ROWS_PER_SPLIT).drop(*place)


def pair_distance(pairs: DataFrame) -> DataFrame:
    """Add great-circle metres to a table of ``lat1, lon1, lat2, lon2``."""
    return pairs.withColumn(
        "distance_m",
        geo.haversine(
            F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), C.EARTH_RADIUS_M
        ),
    )


def rivers(polygons: DataFrame) -> DataFrame:
    return polygons.where(F.col("water_body_type") == "River")


def nearest_centroid_join(
    joined: DataFrame, polygons: DataFrame, max_distance_m: float = 10_000.0
) -> DataFrame:
    """Give unmatched sites the polygon with the nearest centroid in reach.

    ``joined`` is the result of :func:`point_in_polygon_join`. The nearest centroid is found
    whatever its distance; beyond the limit the columns stay null.
    """
    attributes = [c for c in polygons.columns if c not in ("ring", "parts")]
    joined = cut(joined, "in_polygons")
    centres = centroids(polygons).withColumnRenamed("water_body_id", "peer_id")
    unmatched = joined.where(F.col("water_body_id").isNull()).select("site_id", "lat", "lon")
    nearest = (
        nearest_targets(unmatched, centres, 1)
        .where(F.col("distance_m") <= max_distance_m)
        .select("site_id", F.col("peer_id").alias("water_body_id"))
        .join(polygons.select(*attributes), "water_body_id")
    )
    renamed = nearest.select("site_id", *[F.col(a).alias(f"_near_{a}") for a in attributes])
    filled = joined.join(renamed, "site_id", "left")
    rest = [c for c in joined.columns if c not in attributes]
    return filled.select(
        *rest,
        *[F.coalesce(a, f"_near_{a}").alias(a) for a in attributes],
        F.col("_near_water_body_id").isNotNull().alias("by_centroid"),
    )


def clean_status(joined: DataFrame) -> DataFrame:
    """``wfd_status`` struct per site; without an ecological class it is null."""
    ecological = F.nullif(F.col("ecological_class"), F.lit("Not assessed"))
    status = F.struct(
        F.nullif(F.col("overall_water_body_class"), F.lit("Not assessed")).alias("overall_status"),
        ecological.alias("ecological_status"),
        F.nullif(F.col("chemical_class"), F.lit("Does not require assessment")).alias(
            "chemical_status"
        ),
    )
    return joined.select("site_id", F.when(ecological.isNotNull(), status).alias("wfd_status"))
