"""Geodesy as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewatch import constants as C


def haversine(
    lat1: Column,
    lon1: Column,
    lat2: Column,
    lon2: Column,
    radius: float,
    cosines: tuple[Column, Column] | None = None,
) -> Column:
    """Great-circle distance in the unit of ``radius``.

    ``cosines`` are those of both latitudes, where a place meets many others.
    """
    cos1, cos2 = cosines or (F.cos(F.radians(lat1)), F.cos(F.radians(lat2)))
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_dlat), F.lit(2.0)) + cos1 * cos2 * F.pow(F.sin(half_dlon), F.lit(2.0))
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """The place on a sphere of radius 1; whole turns are taken off before, without error."""
    phi, angle = F.radians(lat % 360.0), F.radians(lon % 360.0)
    return F.cos(phi) * F.cos(angle), F.cos(phi) * F.sin(angle), F.sin(phi)


CHORD_SLACK = 1e-9  # far above the rounding of a chord and of a haversine, in radii


def squared_chords(radius_m: float) -> tuple[float, float]:
    """Squared chords of unit vectors below which a place surely lies within the radius,
    and above which it surely does not; between them only the distance tells."""
    chord = 2.0 * math.sin(min(radius_m / C.EARTH_RADIUS_M, math.pi) / 2)
    return (chord - CHORD_SLACK) ** 2 if chord > CHORD_SLACK else -1.0, (chord + CHORD_SLACK) ** 2


def lat_window(radius_m: Column | float) -> Column:
    """Half height in degrees of the box around a circle."""
    radius_m = radius_m if isinstance(radius_m, Column) else F.lit(float(radius_m))
    return F.degrees(radius_m / F.lit(C.EARTH_RADIUS_M))


def lon_window(lat: Column, radius_m: Column | float) -> Column:
    """Half width in degrees of the box around a circle; 180 where it holds a pole."""
    radius_m = radius_m if isinstance(radius_m, Column) else F.lit(float(radius_m))
    angle = radius_m / F.lit(C.EARTH_RADIUS_M)
    ratio = F.sin(F.least(angle, F.lit(math.pi / 2))) / F.greatest(
        F.cos(F.radians(lat)), F.lit(1e-12)
    )
    return F.when(
        (ratio >= 1) | (angle >= math.pi / 2) | (F.abs(lat) + F.degrees(angle) >= 90), F.lit(180.0)
    ).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))


# Airy 1830 ellipsoid and the national grid projection.
AIRY_A = 6_377_563.396
AIRY_B = 6_356_256.909
GRID_SCALE = 0.9996012717
GRID_LAT0 = math.radians(49.0)
GRID_LON0 = math.radians(-2.0)
GRID_E0 = 400_000.0
GRID_N0 = -100_000.0
LATITUDE_ITERATIONS = 10


def _meridional_arc(phi: Column) -> Column:
    """Developed arc of the meridian from the true origin to ``phi``."""
    n = (AIRY_A - AIRY_B) / (AIRY_A + AIRY_B)
    terms = (
        1 + n + 1.25 * n**2 + 1.25 * n**3,
        3 * n + 3 * n**2 + 2.625 * n**3,
        1.875 * n**2 + 1.875 * n**3,
        35.0 / 24.0 * n**3,
    )
    delta, total = phi - GRID_LAT0, phi + GRID_LAT0
    arc = F.lit(terms[0]) * delta
    for order, weight in enumerate(terms[1:], start=1):
        signed = -weight if order % 2 else weight
        arc = arc + F.lit(signed) * F.sin(delta * order) * F.cos(total * order)
    return F.lit(AIRY_B * GRID_SCALE) * arc


def grid_to_latlon(easting: Column, northing: Column) -> tuple[Column, Column]:
    """Inverse transverse Mercator on the Airy ellipsoid, without datum shift.

    The latitude iteration is a fold over a short literal array: unrolling it
    would square the size of the expression at every step.
    """
    steps = F.array(*[F.lit(i) for i in range(LATITUDE_ITERATIONS)])
    phi = F.aggregate(
        steps,
        F.lit(GRID_LAT0),
        lambda p, _: p + (northing - GRID_N0 - _meridional_arc(p)) / (AIRY_A * GRID_SCALE),
    )
    # A one-element array binds phi, so that the fold runs once per row.
    solved = F.transform(F.array(phi), lambda p: _series(p, easting))
    point = F.element_at(solved, 1)
    return point["lat"], point["lon"]


def _series(phi: Column, easting: Column) -> Column:
    e2 = 1 - (AIRY_B / AIRY_A) ** 2
    shrink = 1 - F.lit(e2) * F.pow(F.sin(phi), F.lit(2.0))
    nu = F.lit(AIRY_A * GRID_SCALE) / F.sqrt(shrink)
    rho = F.lit(AIRY_A * GRID_SCALE * (1 - e2)) / F.pow(shrink, F.lit(1.5))
    ratio = nu / rho
    eta2 = ratio - 1
    t = F.tan(phi)
    t2 = t * t
    u = (easting - GRID_E0) / nu  # easting offset as a fraction of the radius
    u2 = u * u
    lat = phi - t * ratio * u2 / 2 * (
        1
        - u2 / 12 * (5 + 3 * t2 + eta2 - 9 * t2 * eta2)
        + u2 * u2 / 360 * (61 + 90 * t2 + 45 * t2 * t2)
    )
    lon = F.lit(GRID_LON0) + u / F.cos(phi) * (
        1 - u2 / 6 * (ratio + 2 * t2) + u2 * u2 / 120 * (5 + 28 * t2 + 24 * t2 * t2)
    )
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(lon).alias("lon"))


def linear_grid_to_latlon(easting: Column, northing: Column) -> tuple[Column, Column]:
    """Straight-line approximation, five decimals; kept for parity runs only."""
    lat = F.lit(C.LINEAR_ORIGIN_LAT) + northing / F.lit(C.LINEAR_METRES_PER_DEGREE)
    lon = F.lit(C.LINEAR_ORIGIN_LON) + easting / F.lit(
        C.LINEAR_METRES_PER_DEGREE * C.LINEAR_LON_FACTOR
    )
    return F.round(lat, 5), F.round(lon, 5)


def on_segment(x: Column, y: Column) -> Column:
    """Whether a place lies on the edge from ``ax, ay`` to ``bx, by``, ends included."""
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    return (
        ((bx - ax) * (y - ay) == (by - ay) * (x - ax))
        & x.between(F.least(ax, bx), F.greatest(ax, bx))
        & y.between(F.least(ay, by), F.greatest(ay, by))
    )


def ring_centroid(ring: Column) -> Column:
    """Area centroid by the shoelace sum, as ``struct<x,y,w>``; ``w`` is twice the signed area.

    Coordinates are taken relative to the first vertex, which keeps the sums
    well conditioned. A ring without area falls back to the vertex mean.
    """
    first = F.element_at(ring, 1)
    size = F.size(ring)
    local = F.transform(
        ring, lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y"))
    )
    shifted = F.concat(F.slice(local, 2, F.greatest(size - 1, F.lit(0))), F.slice(local, 1, 1))
    parts = F.zip_with(
        local,
        shifted,
        lambda a, b: F.struct(
            (a["x"] * b["y"] - b["x"] * a["y"]).alias("w"),
            (a["x"] + b["x"]).alias("sx"),
            (a["y"] + b["y"]).alias("sy"),
        ),
    )
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"))
    total = F.aggregate(
        parts,
        zero,
        lambda acc, p: F.struct(
            (acc["w"] + p["w"]).alias("w"),
            (acc["sx"] + p["sx"] * p["w"]).alias("sx"),
            (acc["sy"] + p["sy"] * p["w"]).alias("sy"),
        ),
    )
    mean_x = F.aggregate(local, F.lit(0.0), lambda acc, p: acc + p["x"]) / size
    mean_y = F.aggregate(local, F.lit(0.0), lambda acc, p: acc + p["y"]) / size
    divisor = F.nullif(total["w"] * 3, F.lit(0.0))
    return F.struct(
        (first["x"] + F.coalesce(total["sx"] / divisor, mean_x)).alias("x"),
        (first["y"] + F.coalesce(total["sy"] / divisor, mean_y)).alias("y"),
        total["w"].alias("w"),
    )
