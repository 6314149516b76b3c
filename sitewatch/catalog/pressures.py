"""Incident, overflow, permit and water-body queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewatch.catalog.base import r, sql, sql_number
from sitewatch.catalog.scoring import haversine_sql
from sitewatch.constants import GRID_SQUARES, LINEAR_SQUARES
from sitewatch.fixtures import view
from sitewatch.functions import geo
from sitewatch.functions.numeric import rounded
from sitewatch.operators import feed, pressures, spatial
from sitewatch.operators.checkpoints import cut
from sitewatch.plans import pressures as chains
from sitewatch.sources.overflow_returns import harmonise_overflow_returns

TYPES = ("STANDARD", "PROMO")
NAMES = ("red bolt", "hot gear", "old bolt")
OUTSIDE = ("cold ring", "blue plate")


def _sites(spark, sf):
    return view(spark, sf, "fx_sites").select("site_id", "lat", "lon")


def _incidents(spark, sf):
    return view(spark, sf, "fx_incidents")


def _overflows(spark, sf):
    return view(spark, sf, "fx_overflows")


# --- joins -----------------------------------------------------------------------


def _incident_pairs(spark, sf):
    points = _incidents(spark, sf).select(
        "incident_id", "incident_date", "pollutant_type", "lat", "lon"
    )
    return spatial.radius_join(_sites(spark, sf), points, 2000.0, "incident_id")


def radius_join(spark, sf):
    distance = rounded(F.col("distance_m"), 3).alias("distance_m")
    return _incident_pairs(spark, sf).select("site_id", "incident_id", distance)


def pair_distance(spark, sf):
    sites = view(spark, sf, "fx_sites").select(
        "site_id", "region", F.col("lat").alias("lat1"), F.col("lon").alias("lon1")
    )
    tiles = view(spark, sf, "fx_tiles").select(
        F.col("water_body_name").alias("region"), F.col("lat0").alias("lat2"), F.col("lon0").alias("lon2")
    )
    return spatial.pair_distance(sites.join(tiles, "region")).select("site_id", r("distance_m", 3))


def _polygons(spark, sf):
    def corner(x, y):
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))

    ring = F.array(
        corner("lon0", "lat0"), corner("lon1", "lat0"), corner("lon1", "lat1"), corner("lon0", "lat1")
    )
    return view(spark, sf, "fx_tiles").withColumn("ring", ring).drop("lat0", "lat1", "lon0", "lon1")


def _in_polygons(spark, sf):
    return spatial.point_in_polygon_join(_sites(spark, sf), _polygons(spark, sf))


def point_in_polygon_join(spark, sf):
    return _in_polygons(spark, sf).select("site_id", "water_body_id", "ecological_class")


def _polygons_with_parts(spark, sf):
    """Every tile with a hole, an island inside the hole and a second part beside it."""

    def square(x0, y0, x1, y1, turn=False):
        corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
        ring = [F.struct((F.col("lon0") + x).alias("x"), (F.col("lat0") + y).alias("y")) for x, y in corners]
        return F.array(*(ring[::-1] if turn else ring))

    parts = F.array(
        F.array(square(0, 0, 0.5, 0.875), square(0.125, 0.125, 0.375, 0.75, turn=True)),
        F.array(square(0.1875, 0.25, 0.3125, 0.5)),
        F.array(square(0.625, 0, 0.875, 0.875, turn=True)),
    )
    return view(spark, sf, "fx_tiles").withColumn("parts", parts).drop("lat0", "lat1", "lon0", "lon1")


def point_in_polygon_parts(spark, sf):
    joined = spatial.point_in_polygon_join(_sites(spark, sf), _polygons_with_parts(spark, sf))
    return joined.select("site_id", "water_body_id", "ecological_class")


def nearest_centroid_parts(spark, sf):
    polygons = _polygons_with_parts(spark, sf)
    joined = spatial.point_in_polygon_join(_sites(spark, sf), polygons)
    filled = spatial.nearest_centroid_join(joined, polygons, 40_000.0)
    return filled.select("site_id", "water_body_id", "by_centroid")


def _with_fallback(spark, sf):
    return spatial.nearest_centroid_join(_in_polygons(spark, sf), _polygons(spark, sf), 60_000.0)


def nearest_centroid_join(spark, sf):
    return _with_fallback(spark, sf).select("site_id", "water_body_id", "by_centroid")


def clean_status(spark, sf):
    status = spatial.clean_status(_with_fallback(spark, sf))
    return status.select("site_id", "wfd_status.*")


# --- incidents ----------------------------------------------------------------------


def filter_water_impact(spark, sf):
    return pressures.filter_water_impact(_incidents(spark, sf)).select("incident_id", "water_impact")


def _scoped(spark, sf):
    return pressures.scope_incidents(
        pressures.filter_water_impact(_incidents(spark, sf)),
        view(spark, sf, "fx_pollutants"), TYPES, NAMES, OUTSIDE,
    )


def scope_incidents(spark, sf):
    return _scoped(spark, sf).select("incident_id", "incident_date", "water_impact")


def attach_pollutants(spark, sf):
    attached = pressures.attach_pollutants(_incidents(spark, sf), view(spark, sf, "fx_pollutants"))
    return attached.select(
        "incident_id", "poll_type", "pollutant", "all_pollutants_text",
        F.size("all_pollutants").alias("n_pollutants"),
    )


def union_distinct(spark, sf):
    incidents = _incidents(spark, sf).select("incident_id", "water_impact", "pollutant_type")
    major = incidents.where(F.col("water_impact") == "Category 1 (Major)")
    low = incidents.where(F.col("pollutant_type") == "5-LOW")
    return feed.union_distinct(major, low, "incident_id")


def incident_dates(spark, sf):
    text = F.when(F.col("incident_id") % 7 == 0, F.lit("2020-13-45")).otherwise(
        F.date_format("incident_date", "dd/MM/yyyy '13:45:10'")
    )
    table = _incidents(spark, sf).select("incident_id", text.alias("incident_time"))
    return pressures.incident_dates(table)


def dedupe_incidents(spark, sf):
    coarse = _incidents(spark, sf).select(
        "incident_id", "incident_date", "pollutant_type", "water_impact",
        F.when(F.col("incident_id") % 10 != 0, F.floor(F.col("easting") / 100_000) * 100_000).alias("easting"),
        F.when(F.col("incident_id") % 10 != 0, F.floor(F.col("northing") / 100_000) * 100_000 + 50).alias("northing"),
    )
    return pressures.dedupe_incidents(coarse).select(
        "incident_id", "incident_date", "pollutant_type", "water_impact", "raw_report_count"
    )


def sort_incidents(spark, sf):
    return pressures.sort_incidents(_incidents(spark, sf)).select("incident_id", "incident_date")


def incident_summary(spark, sf):
    sites, points = _sites(spark, sf), _incidents(spark, sf).select("incident_date", "pollutant_type", "lat", "lon")
    return pressures.incident_summary(sites, pressures.incidents_around(sites, points, 2000.0))


# --- overflows ------------------------------------------------------------------------


def overflow_durations(spark, sf):
    return pressures.overflow_durations(_overflows(spark, sf)).select(
        "permit_ref", "total_duration", r("duration_hours")
    )


def _clean_overflows(spark, sf):
    return pressures.overflow_durations(
        pressures.filter_zero_spills(
            pressures.dedupe_overflows(_overflows(spark, sf), ("total_duration", "lat", "lon"))
        )
    )


_OVERFLOW_COLUMNS = (
    "unique_id", "permit_ref", "outlet_ngr", "reporting_year", "spill_count", "total_duration",
)


def dedupe_overflows(spark, sf):
    return pressures.dedupe_overflows(
        _overflows(spark, sf), ("total_duration", "lat", "lon")
    ).select(*_OVERFLOW_COLUMNS, r("lat"), r("lon"))


def filter_zero_spills(spark, sf):
    counted = pressures.numeric_spills(_overflows(spark, sf))
    return pressures.filter_zero_spills(counted).select("permit_ref", "reporting_year", "spill_count")


def sort_overflows(spark, sf):
    return pressures.sort_overflows(_overflows(spark, sf)).select("reporting_year", "water_company", "permit_ref")


def harmonise_overflow_returns_query(spark, sf):
    table = _overflows(spark, sf)
    first = table.where("reporting_year <= 1998").select(
        F.col("unique_id").alias("Unique ID"),
        F.col("water_company").alias("Water Company Name"),
        F.col("outlet_ngr").alias("Outlet Discharge NGR (EA)"),
        F.col("spill_count").alias("Counted spills using 12-24h"),
    )
    second = table.where("reporting_year > 1998").select(
        F.col("permit_ref").alias("EA Permit Ref."),
        F.col("outlet_ngr").alias("outlet NGR"),
        F.col("total_duration").alias("Total Duration (hrs)"),
    )
    no_place = table.select(F.col("permit_ref").alias("Permit ref"))
    return harmonise_overflow_returns(
        [(first, 1998, "North 1998"), (second, 1999, "South 1999"), (no_place, 2000, "West")]
    ).select("unique_id", "water_company", "permit_ref", "outlet_ngr", "spill_count", "total_duration", "reporting_year")


def overflow_summary(spark, sf):
    sites = _sites(spark, sf)
    points = _clean_overflows(spark, sf).select("reporting_year", "spill_count", "duration_hours", "lat", "lon")
    return pressures.overflow_summary(sites, pressures.overflows_around(sites, points, 2000.0))


def _pressure(spark, sf):
    joined = pressures.site_pressure_join(incident_summary(spark, sf), overflow_summary(spark, sf))
    return pressures.pressure_summary(joined)


def site_pressure_join(spark, sf):
    return pressures.site_pressure_join(incident_summary(spark, sf), overflow_summary(spark, sf)).select(
        "site_id", "total_pollution_incidents", "total_edm_spills", "total_spill_hours"
    )


def pressure_summary(spark, sf):
    return _pressure(spark, sf).select("site_id", "has_any_incidents", "total_all_incidents")


def pressure_totals(spark, sf):
    return pressures.pressure_totals(_pressure(spark, sf))


def top_sites_by_pressure(spark, sf):
    return feed.top_sites(_pressure(spark, sf), 10, "total_all_incidents", descending=True).select(
        "site_id", "total_all_incidents"
    )


def merge_incidents(spark, sf):
    sites = view(spark, sf, "fx_sites").select("site_id", "region")
    return pressures.merge_incidents(sites, _pressure(spark, sf)).select("site_id", "region", "incidents.*")


# --- permits -----------------------------------------------------------------------------


def _permits(spark, sf):
    return view(spark, sf, "fx_discharges")


def georeference_grid(spark, sf):
    return pressures.georeference_grid(_permits(spark, sf), "effluent_grid_ref", "discharge_ngr").select(
        "permit_number", "easting", "northing"
    )


def georeference_linear(spark, sf):
    return pressures.georeference_linear(_permits(spark, sf), "effluent_grid_ref").select(
        "permit_number", "lat_approx", "lon_approx"
    )


def georeference_linear_table(spark, sf):
    """With the table of letters that goes with the formula."""
    return pressures.georeference_linear(_permits(spark, sf), "effluent_grid_ref", LINEAR_SQUARES).select(
        "permit_number", "lat_approx", "lon_approx"
    )


def easting_northing_to_latlon(spark, sf):
    return pressures.easting_northing_to_latlon(_incidents(spark, sf).drop("lat", "lon")).select(
        "incident_id", r("lat"), r("lon")
    )


def fill_coordinates(spark, sf):
    gappy = _incidents(spark, sf).select(
        "incident_id",
        F.when(F.col("incident_id") % 3 != 0, F.col("lat")).alias("lat"),
        F.when(F.col("incident_id") % 3 != 0, F.col("lon")).alias("lon"),
        F.when(F.col("incident_id") % 2 == 0, F.lit("unknown")).otherwise(F.col("easting").cast("string")).alias("easting"),
        "northing",
    )
    return pressures.fill_coordinates(gappy).select("incident_id", r("lat"), r("lon"))


def classify_discharges(spark, sf):
    return pressures.classify_discharges(_permits(spark, sf)).select(
        "permit_number", "effluent_type", "discharge_category"
    )


def dedupe_discharges(spark, sf):
    # Permits repeat once the number is cut to its last three digits.
    short = _permits(spark, sf).select(
        F.concat(F.lit("D"), F.substring("permit_number", -2, 2)).alias("permit_number"),
        "effluent_type", F.substring("discharge_ngr", 1, 4).alias("discharge_ngr"), "discharge_site_name",
    )
    return pressures.dedupe_discharges(short)


def category_counts(spark, sf):
    return pressures.category_counts(
        pressures.classify_discharges(_permits(spark, sf)), "discharge_category"
    )


def status_counts(spark, sf):
    status = spatial.clean_status(_with_fallback(spark, sf))
    return pressures.category_counts(
        status.select(F.col("wfd_status.ecological_status").alias("status")), "status"
    )


def _discharge_points(spark, sf):
    located = pressures.georeference_grid(
        pressures.classify_discharges(_permits(spark, sf)), "effluent_grid_ref", "discharge_ngr"
    ).where("easting IS NOT NULL")
    # Places are converted after the exchange: one large file of permits is one task before it.
    points = pressures.easting_northing_to_latlon(pressures.dedupe_discharges(located)).select(
        F.col("permit_number").alias("point_id"), "discharge_category", "discharge_site_name", "lat", "lon"
    )
    sites = _sites(spark, sf)
    return pressures.discharge_summary(sites, pressures.permits_around(sites, points, 5000.0))


def discharge_summary(spark, sf):
    p = F.col("discharge_points")
    return _discharge_points(spark, sf).select(
        "site_id",
        *[p[c].alias(c) for c in (
            "sewage_works_count", "storm_overflows_count", "industrial_discharges_count", "total_discharge_points",
        )],
        p["nearest_sewage_work"]["name"].alias("sewage_name"),
        p["nearest_sewage_work"]["distance_m"].alias("sewage_m"),
        p["nearest_industrial"]["name"].alias("industrial_name"),
        p["nearest_industrial"]["distance_m"].alias("industrial_m"),
    )


def merge_site_layers(spark, sf):
    sites = view(spark, sf, "fx_sites").select("site_id", "region")
    status = spatial.clean_status(_with_fallback(spark, sf))
    merged = pressures.merge_site_layers(sites, status, _discharge_points(spark, sf))
    return merged.select(
        "site_id", "region", F.col("wfd_status.ecological_status").alias("ecological_status"),
        F.col("discharge_points.total_discharge_points").alias("total_discharge_points"),
    )


def region_bounds(spark, sf):
    return feed.region_bounds(view(spark, sf, "fx_sites"))


def nearest_sites(spark, sf):
    return feed.nearest_sites(_sites(spark, sf), 52.5, -1.5, 10, 50.0).select(
        "site_id", r("distance_km", 4)
    )


def nearest_sites_batch(spark, sf):
    origins = view(spark, sf, "fx_tiles").select(
        F.col("water_body_id").alias("origin_id"), F.col("lat0").alias("lat"), F.col("lon0").alias("lon")
    )
    return feed.nearest_sites_batch(origins, _sites(spark, sf), 5, 40.0).select(
        "origin_id", "site_id", "nth", r("distance_km", 4)
    )


# --- raw tables to cleaned ones -----------------------------------------------------------


def clean_incidents(spark, sf):
    """Reports with unreadable times, references and places among them."""
    reports = view(spark, sf, "fx_incident_reports")
    cleaned = chains.clean_incidents(reports, view(spark, sf, "fx_pollutants"), TYPES, NAMES, OUTSIDE)
    return cleaned.select(
        "incident_id", "incident_date", "water_impact", "pollutant_type", "primary_pollutant",
        F.size("all_pollutants").alias("n_pollutants"), r("lat"), r("lon"), "raw_report_count",
    )


def clean_overflows(spark, sf):
    """Returns of which some have no readable outlet."""
    lost = F.when(F.col("total_duration") != "unknown", F.col("outlet_ngr")).otherwise(F.lit("none"))
    returns = _overflows(spark, sf).drop("lat", "lon").withColumn("outlet_ngr", lost)
    return chains.clean_overflows(returns, ("total_duration",)).select(
        "point_id", "unique_id", "permit_ref", "reporting_year", "spill_count", r("duration_hours"), r("lat"), r("lon")
    )


def locate_permits(spark, sf):
    return chains.locate_permits(_permits(spark, sf)).select(
        "point_id", "discharge_category", "discharge_site_name", r("lat"), r("lon")
    )


def enriched_feed(spark, sf):
    """Sites with all three structs, from the raw tables on."""
    tables = chains.Pressures(
        chains.clean_incidents(view(spark, sf, "fx_incident_reports"), view(spark, sf, "fx_pollutants"), TYPES, NAMES, OUTSIDE),
        chains.clean_overflows(_overflows(spark, sf).drop("lat", "lon")),
        chains.locate_permits(_permits(spark, sf)),
        _polygons(spark, sf),
    )
    found = chains.enriched(view(spark, sf, "fx_sites").select("site_id", "region", "lat", "lon"), tables, 12_000.0)
    nearest = F.col("discharge_points.nearest_sewage_work")
    return found.select(
        "site_id", "region", "incidents.total_pollution_incidents", "incidents.primary_pollution_cause",
        "incidents.total_edm_spills", F.col("wfd_status.ecological_status").alias("ecological_status"),
        "discharge_points.total_discharge_points", nearest["distance_m"].alias("sewage_m"),
    )


QUERIES = {
    "clean_incidents": clean_incidents,
    "clean_overflows": clean_overflows,
    "locate_permits": locate_permits,
    "enriched_feed": enriched_feed,
    "radius_join": radius_join,
    "pair_distance": pair_distance,
    "point_in_polygon_join": point_in_polygon_join,
    "point_in_polygon_parts": point_in_polygon_parts,
    "nearest_centroid_join": nearest_centroid_join,
    "nearest_centroid_parts": nearest_centroid_parts,
    "clean_status": clean_status,
    "filter_water_impact": filter_water_impact,
    "scope_incidents": scope_incidents,
    "attach_pollutants": attach_pollutants,
    "union_distinct": union_distinct,
    "incident_dates": incident_dates,
    "dedupe_incidents": dedupe_incidents,
    "sort_incidents": sort_incidents,
    "incident_summary": incident_summary,
    "overflow_durations": overflow_durations,
    "dedupe_overflows": dedupe_overflows,
    "filter_zero_spills": filter_zero_spills,
    "sort_overflows": sort_overflows,
    "harmonise_overflow_returns": harmonise_overflow_returns_query,
    "overflow_summary": overflow_summary,
    "site_pressure_join": site_pressure_join,
    "pressure_summary": pressure_summary,
    "pressure_totals": pressure_totals,
    "top_sites_by_pressure": top_sites_by_pressure,
    "merge_incidents": merge_incidents,
    "georeference_grid": georeference_grid,
    "georeference_linear": georeference_linear,
    "georeference_linear_table": georeference_linear_table,
    "easting_northing_to_latlon": easting_northing_to_latlon,
    "fill_coordinates": fill_coordinates,
    "classify_discharges": classify_discharges,
    "dedupe_discharges": dedupe_discharges,
    "category_counts": category_counts,
    "status_counts": status_counts,
    "discharge_summary": discharge_summary,
    "merge_site_layers": merge_site_layers,
    "region_bounds": region_bounds,
    "nearest_sites": nearest_sites,
    "nearest_sites_batch": nearest_sites_batch,
}

# --- SQL -----------------------------------------------------------------------------------

def _square_rows(squares: dict[str, tuple[int, int]]) -> str:
    rows = ", ".join(f"('{k}', {c}, {row})" for k, (c, row) in squares.items())
    return f"SELECT * FROM (VALUES {rows}) AS t(letters, cx, cy)"


def _double(value: float) -> str:
    """A literal that DuckDB reads as double, not decimal."""
    return f"CAST('{value!r}' AS DOUBLE)"


def _projection_ctes(source: str, prefix: str) -> dict[str, str]:
    """Inverse projection as SQL: the latitude iteration is one expression per step."""
    a, b, f0 = _double(geo.AIRY_A), _double(geo.AIRY_B), _double(geo.GRID_SCALE)
    n = (geo.AIRY_A - geo.AIRY_B) / (geo.AIRY_A + geo.AIRY_B)
    p0 = _double(geo.GRID_LAT0)
    w0, w1, w2, w3 = (
        _double(w)
        for w in (
            1 + n + 1.25 * n**2 + 1.25 * n**3,
            3 * n + 3 * n**2 + 2.625 * n**3,
            1.875 * n**2 + 1.875 * n**3,
            35 / 24 * n**3,
        )
    )
    arc = (
        f"{b} * {f0} * ({w0} * (phi - {p0}) "
        f"- {w1} * sin(phi - {p0}) * cos(phi + {p0}) "
        f"+ {w2} * sin(2 * (phi - {p0})) * cos(2 * (phi + {p0})) "
        f"- {w3} * sin(3 * (phi - {p0})) * cos(3 * (phi + {p0})))"
    )
    ctes = {f"{prefix}_0": f"SELECT *, CAST({p0} AS DOUBLE) AS phi FROM {source}"}
    for i in range(1, 11):
        ctes[f"{prefix}_{i}"] = (
            f"SELECT * EXCLUDE (phi), phi + (northing + 100000.0 - {arc}) / ({a} * {f0}) AS phi "
            f"FROM {prefix}_{i - 1}"
        )
    e2 = _double(1 - (geo.AIRY_B / geo.AIRY_A) ** 2)
    ctes[f"{prefix}_radii"] = (
        f"SELECT *, {a} * {f0} / sqrt(1 - {e2} * pow(sin(phi), 2)) AS nu, "
        f"{a} * {f0} * (1 - {e2}) / pow(1 - {e2} * pow(sin(phi), 2), 1.5) AS rho, "
        f"tan(phi) AS t, easting - 400000.0 AS de FROM {prefix}_10"
    )
    ctes[f"{prefix}_done"] = f"""
SELECT * EXCLUDE (phi, nu, rho, t, de),
  degrees(phi - t / (2 * rho * nu) * pow(de, 2)
    + t / (24 * rho * pow(nu, 3)) * (5 + 3 * t * t + (nu / rho - 1) - 9 * t * t * (nu / rho - 1)) * pow(de, 4)
    - t / (720 * rho * pow(nu, 5)) * (61 + 90 * t * t + 45 * pow(t, 4)) * pow(de, 6)) AS plat,
  degrees({_double(geo.GRID_LON0)} + de / (cos(phi) * nu)
    - pow(de, 3) / (6 * cos(phi) * pow(nu, 3)) * (nu / rho + 2 * t * t)
    + pow(de, 5) / (120 * cos(phi) * pow(nu, 5)) * (5 + 28 * t * t + 24 * pow(t, 4))) AS plon
FROM {prefix}_radii"""
    return ctes


def _grid_sql(reference: str, source: str, squares: str = "squares") -> str:
    return f"""
SELECT s.*, CASE WHEN sq.letters IS NOT NULL THEN sq.cx * 100000.0 +
         TRY_CAST(substr(digits, 1, half) AS DOUBLE) * pow(10, 5 - half) END AS easting,
       CASE WHEN sq.letters IS NOT NULL THEN sq.cy * 100000.0 +
         TRY_CAST(substr(digits, half + 1) AS DOUBLE) * pow(10, 5 - half) END AS northing
FROM (SELECT *, substr(upper(replace(trim({reference}), ' ', '')), 3) AS digits,
             CAST(length(substr(upper(replace(trim({reference}), ' ', '')), 3)) // 2 AS BIGINT) AS half,
             upper(substr(replace(trim({reference}), ' ', ''), 1, 2)) AS square
      FROM {source}) s LEFT JOIN {squares} sq ON sq.letters = s.square"""


def _box_pairs(points: str, radius: float, dlat: float, dlon: float, columns: str) -> str:
    return f"""
SELECT * FROM (SELECT a.site_id, {columns}, {haversine_sql("a", "b")} AS distance_m
FROM fx_sites a JOIN {points} b ON b.lat BETWEEN a.lat - {dlat} AND a.lat + {dlat}
 AND b.lon BETWEEN a.lon - {dlon} AND a.lon + {dlon}) WHERE distance_m <= {radius}"""


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_IMPACT = "water_impact IN ('Category 1 (Major)', 'Category 2 (Significant)', 'Category 3 (Minor)')"
_NUM_SPILLS = sql_number("spill_count")

CTES = {
    "squares": _square_rows(GRID_SQUARES),
    "table_squares": _square_rows(LINEAR_SQUARES),
    "inc_pairs": _box_pairs(
        "fx_incidents", 2000, 0.02, 0.04, "b.incident_id, b.incident_date, b.pollutant_type"
    ),
    "in_tiles": """
SELECT s.site_id, s.lat, s.lon, min(t.water_body_id) AS tile FROM fx_sites s LEFT JOIN fx_tiles t
ON s.lat > t.lat0 AND s.lat < t.lat1 AND s.lon > t.lon0 AND s.lon < t.lon1 GROUP BY ALL""",
    "in_parts": """
SELECT s.site_id, s.lat, s.lon, min(t.water_body_id) AS tile FROM fx_sites s LEFT JOIN fx_tiles t
ON s.lat > t.lat0 AND s.lat < t.lat0 + 0.875 AND (
  s.lon > t.lon0 + 0.625 AND s.lon < t.lon0 + 0.875
  OR s.lon > t.lon0 AND s.lon < t.lon0 + 0.5 AND NOT (s.lon >= t.lon0 + 0.125 AND s.lon <= t.lon0 + 0.375
                                                      AND s.lat >= t.lat0 + 0.125 AND s.lat <= t.lat0 + 0.75)
  OR s.lon > t.lon0 + 0.1875 AND s.lon < t.lon0 + 0.3125 AND s.lat > t.lat0 + 0.25 AND s.lat < t.lat0 + 0.5)
GROUP BY ALL""",
    # Areas in units of 1/512: outer 224, hole 80, island 16, second part 112.
    "part_centres": """
SELECT water_body_id, lon0 + (224 * 0.25 - 80 * 0.25 + 16 * 0.25 + 112 * 0.75) / 272.0 AS lon,
       lat0 + (224 * 0.4375 - 80 * 0.4375 + 16 * 0.375 + 112 * 0.4375) / 272.0 AS lat
FROM fx_tiles""",
    "centres": "SELECT water_body_id, (lat0 + lat1) / 2 AS lat, (lon0 + lon1) / 2 AS lon FROM fx_tiles",
    "nearest_tile": f"""
SELECT site_id, first(water_body_id ORDER BY d, water_body_id) AS near_id FROM (
  SELECT a.site_id, b.water_body_id, {haversine_sql("a", "b")} AS d
  FROM in_tiles a JOIN centres b ON true WHERE a.tile IS NULL) WHERE d <= 60000 GROUP BY site_id""",
    "tiled": """
SELECT i.site_id, t.*, n.near_id IS NOT NULL AS by_centroid
FROM in_tiles i LEFT JOIN nearest_tile n USING (site_id)
LEFT JOIN fx_tiles t ON t.water_body_id = coalesce(i.tile, n.near_id)""",
    "status": """
SELECT site_id, CASE WHEN ok THEN nullif(overall_water_body_class, 'Not assessed') END AS overall_status,
       CASE WHEN ok THEN ecological_class END AS ecological_status,
       CASE WHEN ok THEN nullif(chemical_class, 'Does not require assessment') END AS chemical_status
FROM (SELECT *, ecological_class IS NOT NULL AND ecological_class <> 'Not assessed' AS ok FROM tiled)""",
    "inc_sum": """
SELECT s.site_id, coalesce(p.n, 0) AS total_pollution_incidents, strftime(p.latest, '%Y-%m-%d') AS most_recent_pollution_date,
       c.pollutant_type AS primary_pollution_cause
FROM fx_sites s
LEFT JOIN (SELECT site_id, count(*) AS n, max(incident_date) AS latest FROM inc_pairs GROUP BY 1) p USING (site_id)
LEFT JOIN (SELECT site_id, first(pollutant_type ORDER BY n DESC, pollutant_type) AS pollutant_type
           FROM (SELECT site_id, pollutant_type, count(*) AS n FROM inc_pairs WHERE pollutant_type IS NOT NULL GROUP BY ALL)
           GROUP BY 1) c USING (site_id)""",
    "ovf_clean": f"""
SELECT * EXCLUDE (spill_count, nth, unknown), spills AS spill_count FROM (
  SELECT *, row_number() OVER (PARTITION BY unique_id, reporting_year,
              CASE WHEN unique_id IS NULL THEN permit_ref END, CASE WHEN unique_id IS NULL THEN outlet_ngr END
            ORDER BY unknown, spills DESC, total_duration, lat, lon, permit_ref, outlet_ngr, water_company) AS nth
  FROM (SELECT *, {_NUM_SPILLS} AS spills, ({_NUM_SPILLS}) IS NULL AS unknown FROM fx_overflows)) WHERE nth = 1""",
    "ovf_hours": f"""
SELECT *, CASE WHEN contains(total_duration, '1899') THEN hour(TRY_CAST(total_duration AS TIMESTAMP)) +
                 minute(TRY_CAST(total_duration AS TIMESTAMP)) / 60 + second(TRY_CAST(total_duration AS TIMESTAMP)) / 3600
               WHEN regexp_full_match(total_duration, '[0-9]+:[0-9]{{2}}:[0-9]{{2}}')
                 THEN CAST(split_part(total_duration, ':', 1) AS DOUBLE) + CAST(split_part(total_duration, ':', 2) AS DOUBLE) / 60
                      + CAST(split_part(total_duration, ':', 3) AS DOUBLE) / 3600
               ELSE {sql_number("total_duration")} END AS duration_hours
FROM ovf_source""",
    "ovf_source": "SELECT * FROM ovf_clean WHERE spill_count > 0 OR spill_count IS NULL",
    "ovf_pairs": _box_pairs("ovf_hours", 2000, 0.02, 0.04, "b.reporting_year, b.spill_count, b.duration_hours"),
    "ovf_sum": """
SELECT s.site_id, count(p.site_id) AS total_edm_spills, CAST(floor(coalesce(sum(p.spill_count), 0)) AS BIGINT) AS total_edm_spill_events,
       round(coalesce(sum(p.duration_hours), 0), 2) AS total_spill_hours, CAST(max(p.reporting_year) AS VARCHAR) AS most_recent_spill_date
FROM fx_sites s LEFT JOIN ovf_pairs p USING (site_id) GROUP BY s.site_id""",
    "pressure": """
SELECT *, total_pollution_incidents > 0 OR total_edm_spills > 0 AS has_any_incidents,
       total_pollution_incidents + total_edm_spills AS total_all_incidents
FROM inc_sum JOIN ovf_sum USING (site_id)""",
    "classed": """
SELECT *, CASE WHEN effluent_type IN ('SB', 'SC', 'UB', 'UC') THEN 'storm_overflow'
               WHEN effluent_type IN ('SA', 'SB', 'SC', 'SD', 'SE', 'UA', 'UB', 'UC', 'UD', 'UE') THEN 'sewage_works'
               ELSE 'industrial' END AS discharge_category
FROM fx_discharges WHERE effluent_type IN ('SA', 'SB', 'SC', 'SD', 'SE', 'UA', 'UB', 'UC', 'UD', 'UE',
                                           'TA', 'TB', 'TC', 'TD', 'TE', 'TF', 'TG')""",
    "gridded": _grid_sql("coalesce(effluent_grid_ref, discharge_ngr)", "fx_discharges"),
    "gridded_effluent": _grid_sql("effluent_grid_ref", "fx_discharges"),
    "gridded_by_table": _grid_sql("effluent_grid_ref", "fx_discharges", "table_squares"),
    "classed_grid": _grid_sql("coalesce(effluent_grid_ref, discharge_ngr)", "classed"),
    "classed_located": "SELECT * FROM classed_grid WHERE easting IS NOT NULL",
    **_projection_ctes("classed_located", "dis_phi"),
    "dis_points": "SELECT *, plat AS lat, plon AS lon FROM dis_phi_done",
    "dis_pairs": _box_pairs(
        "dis_points", 5000, 0.05, 0.09, "b.permit_number AS point_id, b.discharge_category, b.discharge_site_name"
    ),
    **_projection_ctes("(SELECT * EXCLUDE (lat, lon) FROM fx_incidents)", "inc_phi"),
    "rep_named": f"""
SELECT i.incident_id, i.water_impact, i.grid_ref, f.poll_type AS pollutant_type, f.pollutant AS primary_pollutant, f.n_pollutants,
       TRY_CAST(i.easting AS DOUBLE) AS e_said, i.northing AS n_said,
       CAST(try_strptime(i.incident_time, '%d/%m/%Y %H:%M:%S') AS DATE) AS incident_date
FROM fx_incident_reports i LEFT JOIN (
  SELECT incident_id, first(poll_type ORDER BY ord, poll_type, pollutant) AS poll_type,
         first(pollutant ORDER BY ord, poll_type, pollutant) AS pollutant, CAST(count(*) AS INTEGER) AS n_pollutants
  FROM fx_pollutants GROUP BY incident_id) f USING (incident_id)
WHERE i.{_IMPACT} AND (i.water_impact = 'Category 1 (Major)' OR incident_id IN (
  SELECT incident_id FROM fx_pollutants WHERE (poll_type IN {_in(TYPES)} OR pollutant IN {_in(NAMES)})
  AND pollutant NOT IN {_in(OUTSIDE)}))""",
    "rep_grid": _grid_sql("grid_ref", "rep_named"),
    "rep_place": """
SELECT * EXCLUDE (easting, northing), coalesce(easting, CASE WHEN n_said IS NOT NULL THEN e_said END) AS easting,
       CASE WHEN easting IS NOT NULL THEN northing ELSE n_said END AS northing FROM rep_grid""",
    **_projection_ctes("rep_place", "rep_phi"),
    "reports": """
SELECT incident_date, pollutant_type, min(incident_id) AS incident_id, arg_min(water_impact, incident_id) AS water_impact,
       arg_min(primary_pollutant, incident_id) AS primary_pollutant, arg_min(n_pollutants, incident_id) AS n_pollutants,
       arg_min(plat, incident_id) AS lat, arg_min(plon, incident_id) AS lon, count(*) AS raw_report_count
FROM rep_phi_done WHERE plat IS NOT NULL
GROUP BY incident_date, pollutant_type, round(e_said / 100), round(n_said / 100)""",
    "ret_grid": _grid_sql("outlet_ngr", "(SELECT * EXCLUDE (lat, lon) FROM fx_overflows)"),
    **_projection_ctes("ret_grid", "ret_phi"),
    "returned": f"""
SELECT *, concat_ws('/', CAST(reporting_year AS VARCHAR), unique_id, permit_ref, outlet_ngr) AS point_id,
       CASE WHEN contains(total_duration, '1899') THEN hour(TRY_CAST(total_duration AS TIMESTAMP)) +
              minute(TRY_CAST(total_duration AS TIMESTAMP)) / 60 + second(TRY_CAST(total_duration AS TIMESTAMP)) / 3600
            WHEN regexp_full_match(total_duration, '[0-9]+:[0-9]{{2}}:[0-9]{{2}}')
              THEN CAST(split_part(total_duration, ':', 1) AS DOUBLE) + CAST(split_part(total_duration, ':', 2) AS DOUBLE) / 60
                   + CAST(split_part(total_duration, ':', 3) AS DOUBLE) / 3600
            ELSE {sql_number("total_duration")} END AS duration_hours
FROM (
  SELECT *, ({_NUM_SPILLS}) AS spills, row_number() OVER (PARTITION BY kind, unique_id, reporting_year,
           CASE WHEN unique_id IS NULL THEN permit_ref END, CASE WHEN unique_id IS NULL THEN outlet_ngr END
         ORDER BY ({_NUM_SPILLS}) IS NULL, ({_NUM_SPILLS}) DESC, {{order}}) AS nth
  FROM (SELECT *, unnest([0, 1]) AS kind FROM ret_phi_done) WHERE kind = 0 OR total_duration <> 'unknown')
WHERE nth = 1 AND (spills > 0 OR spills IS NULL)""".replace("{order}", "CASE kind WHEN 1 THEN total_duration END, permit_ref, outlet_ngr, water_company, total_duration"),
    "permit_points": """
SELECT concat_ws('/', permit_number, effluent_type, discharge_ngr) AS point_id, discharge_category, discharge_site_name,
       plat AS lat, plon AS lon FROM dis_phi_done""",
    "enr_incidents": f"""
SELECT s.site_id, count(p.incident_id) AS n, mode_of.pollutant_type AS cause FROM fx_sites s
LEFT JOIN (SELECT a.site_id, b.incident_id FROM fx_sites a JOIN reports b ON {haversine_sql("a", "b")} <= 12000) p USING (site_id)
LEFT JOIN (SELECT site_id, first(pollutant_type ORDER BY k DESC, pollutant_type) AS pollutant_type FROM (
  SELECT a.site_id, b.pollutant_type, count(*) AS k FROM fx_sites a JOIN reports b ON {haversine_sql("a", "b")} <= 12000
  WHERE b.pollutant_type IS NOT NULL GROUP BY ALL) GROUP BY site_id) mode_of USING (site_id)
GROUP BY ALL""",
    "enr_spills": f"""
SELECT s.site_id, count(b.point_id) AS n FROM fx_sites s LEFT JOIN (
  SELECT a.site_id, p.point_id FROM fx_sites a JOIN (SELECT point_id, plat AS lat, plon AS lon FROM returned WHERE kind = 0) p
  ON {haversine_sql("a", "p")} <= 12000) b USING (site_id) GROUP BY s.site_id""",
    "enr_permits": f"""
SELECT a.site_id, count(*) AS n,
       CAST(round_even(min(d) FILTER (discharge_category IN ('sewage_works', 'storm_overflow')), 0) AS INTEGER) AS sewage_m
FROM (SELECT a.site_id, b.discharge_category, {haversine_sql("a", "b")} AS d FROM fx_sites a JOIN permit_points b ON true) a
WHERE d <= 12000 GROUP BY a.site_id""",
    "enr_tiles": f"""
SELECT i.site_id, t.ecological_class FROM in_tiles i LEFT JOIN (
  SELECT site_id, first(water_body_id ORDER BY d, water_body_id) AS near_id FROM (
    SELECT a.site_id, b.water_body_id, {haversine_sql("a", "b")} AS d FROM in_tiles a JOIN centres b ON true WHERE a.tile IS NULL)
  WHERE d <= 10000 GROUP BY site_id) n USING (site_id)
LEFT JOIN fx_tiles t ON t.water_body_id = coalesce(i.tile, n.near_id)""",
    "gappy": """
SELECT incident_id, CASE WHEN incident_id % 3 <> 0 THEN lat END AS lat0, CASE WHEN incident_id % 3 <> 0 THEN lon END AS lon0,
       CASE WHEN incident_id % 2 = 0 THEN NULL ELSE easting END AS easting, northing FROM fx_incidents""",
    **_projection_ctes("gappy", "gap_phi"),
    "dis_sum": """
SELECT s.site_id,
  count(*) FILTER (discharge_category = 'sewage_works') AS sewage_works_count,
  count(*) FILTER (discharge_category = 'storm_overflow') AS storm_overflows_count,
  count(*) FILTER (discharge_category = 'industrial') AS industrial_discharges_count,
  count(point_id) AS total_discharge_points,
  first(discharge_site_name ORDER BY distance_m, point_id) FILTER (discharge_category IN ('sewage_works', 'storm_overflow')) AS sewage_name,
  CAST(round_even(min(distance_m) FILTER (discharge_category IN ('sewage_works', 'storm_overflow')), 0) AS INTEGER) AS sewage_m,
  first(discharge_site_name ORDER BY distance_m, point_id) FILTER (discharge_category = 'industrial') AS industrial_name,
  CAST(round_even(min(distance_m) FILTER (discharge_category = 'industrial'), 0) AS INTEGER) AS industrial_m
FROM fx_sites s LEFT JOIN dis_pairs USING (site_id) GROUP BY s.site_id""",
}


def _sql(body: str) -> str:
    return sql(body, CTES)


_NONE = "CASE WHEN total_discharge_points > 0 THEN {c} END AS {c}"

ORACLES = {
    "clean_incidents": _sql("""
SELECT incident_id, incident_date, water_impact, pollutant_type, primary_pollutant, n_pollutants,
       round(lat, 6) AS lat, round(lon, 6) AS lon, raw_report_count FROM reports"""),
    "clean_overflows": _sql("""
SELECT point_id, unique_id, permit_ref, reporting_year, spills AS spill_count, round(duration_hours, 6) AS duration_hours,
       round(plat, 6) AS lat, round(plon, 6) AS lon FROM returned WHERE kind = 1"""),
    "locate_permits": _sql("""
SELECT point_id, discharge_category, discharge_site_name, round(lat, 6) AS lat, round(lon, 6) AS lon FROM permit_points"""),
    "enriched_feed": _sql("""
SELECT s.site_id, s.region, CASE WHEN i.n + e.n > 0 THEN i.n END AS total_pollution_incidents,
       CASE WHEN i.n + e.n > 0 THEN i.cause END AS primary_pollution_cause, CASE WHEN i.n + e.n > 0 THEN e.n END AS total_edm_spills,
       nullif(t.ecological_class, 'Not assessed') AS ecological_status, p.n AS total_discharge_points, p.sewage_m
FROM fx_sites s JOIN enr_incidents i USING (site_id) JOIN enr_spills e USING (site_id)
JOIN enr_tiles t USING (site_id) LEFT JOIN enr_permits p USING (site_id)"""),
    "radius_join": _sql("SELECT site_id, incident_id, round(distance_m, 3) AS distance_m FROM inc_pairs"),
    "pair_distance": _sql(f"""
SELECT a.site_id, round({haversine_sql("a", "b")}, 3) AS distance_m FROM fx_sites a
JOIN (SELECT water_body_name, lat0 AS lat, lon0 AS lon FROM fx_tiles) b ON a.region = b.water_body_name"""),
    "point_in_polygon_join": _sql("""
SELECT i.site_id, t.water_body_id, t.ecological_class FROM in_tiles i LEFT JOIN fx_tiles t ON i.tile = t.water_body_id"""),
    "point_in_polygon_parts": _sql("""
SELECT i.site_id, t.water_body_id, t.ecological_class FROM in_parts i LEFT JOIN fx_tiles t ON i.tile = t.water_body_id"""),
    "nearest_centroid_join": _sql("SELECT site_id, water_body_id, by_centroid FROM tiled"),
    "nearest_centroid_parts": _sql(f"""
SELECT site_id, coalesce(tile, near_id) AS water_body_id, near_id IS NOT NULL AS by_centroid
FROM in_parts LEFT JOIN (
  SELECT site_id, first(water_body_id ORDER BY d, water_body_id) AS near_id FROM (
    SELECT a.site_id, b.water_body_id, {haversine_sql("a", "b")} AS d
    FROM in_parts a JOIN part_centres b ON true WHERE a.tile IS NULL)
  WHERE d <= 40000 GROUP BY site_id) USING (site_id)"""),
    "clean_status": _sql("SELECT * FROM status"),
    "filter_water_impact": _sql(f"SELECT incident_id, water_impact FROM fx_incidents WHERE {_IMPACT}"),
    "scope_incidents": _sql(f"""
SELECT DISTINCT incident_id, incident_date, water_impact FROM fx_incidents WHERE {_IMPACT}
AND (water_impact = 'Category 1 (Major)' OR incident_id IN (
  SELECT incident_id FROM fx_pollutants WHERE (poll_type IN {_in(TYPES)} OR pollutant IN {_in(NAMES)})
    AND pollutant NOT IN {_in(OUTSIDE)}))"""),
    "attach_pollutants": _sql("""
SELECT i.incident_id, p.poll_type, p.pollutant, p.all_pollutants_text, p.n AS n_pollutants
FROM fx_incidents i LEFT JOIN (
  SELECT incident_id, first(poll_type ORDER BY ord, poll_type, pollutant) AS poll_type,
         first(pollutant ORDER BY ord, poll_type, pollutant) AS pollutant,
         string_agg(pollutant, '; ' ORDER BY ord, poll_type, pollutant) AS all_pollutants_text, count(*) AS n
  FROM fx_pollutants GROUP BY 1) p USING (incident_id)"""),
    "union_distinct": _sql("""
SELECT DISTINCT incident_id, water_impact, pollutant_type FROM fx_incidents
WHERE water_impact = 'Category 1 (Major)' OR pollutant_type = '5-LOW'"""),
    "incident_dates": _sql("""
SELECT incident_id, t AS incident_time, CAST(TRY_STRPTIME(t, '%d/%m/%Y %H:%M:%S') AS DATE) AS incident_date
FROM (SELECT incident_id, CASE WHEN incident_id % 7 = 0 THEN '2020-13-45'
        ELSE strftime(incident_date, '%d/%m/%Y 13:45:10') END AS t FROM fx_incidents)"""),
    "dedupe_incidents": _sql("""
SELECT min(incident_id) AS incident_id, incident_date, pollutant_type,
       first(water_impact ORDER BY incident_id) AS water_impact, count(*) AS raw_report_count
FROM (SELECT *, CASE WHEN incident_id % 10 <> 0 THEN round(floor(easting / 100000) * 1000) END AS e,
             CASE WHEN incident_id % 10 <> 0 THEN round((floor(northing / 100000) * 100000 + 50) / 100) END AS n FROM fx_incidents)
GROUP BY incident_date, e, n, pollutant_type"""),
    "sort_incidents": _sql("SELECT incident_id, incident_date FROM fx_incidents ORDER BY incident_date DESC, incident_id"),
    "incident_summary": _sql("SELECT * FROM inc_sum"),
    "overflow_durations": _sql("""
SELECT permit_ref, total_duration, round(duration_hours, 6) AS duration_hours FROM ovf_hours""").replace(
        "SELECT * FROM ovf_clean WHERE spill_count > 0 OR spill_count IS NULL", "SELECT * FROM fx_overflows"
    ),
    "dedupe_overflows": _sql("""
SELECT unique_id, permit_ref, outlet_ngr, reporting_year, spill_count, total_duration, round(lat, 6) AS lat,
       round(lon, 6) AS lon FROM ovf_clean"""),
    "filter_zero_spills": _sql(f"""
SELECT permit_ref, reporting_year, n AS spill_count FROM (SELECT *, {_NUM_SPILLS} AS n FROM fx_overflows)
WHERE n > 0 OR n IS NULL"""),
    "sort_overflows": _sql("""
SELECT reporting_year, water_company, permit_ref FROM fx_overflows ORDER BY reporting_year DESC, water_company"""),
    "harmonise_overflow_returns": _sql("""
SELECT unique_id, water_company, CAST(NULL AS VARCHAR) AS permit_ref, outlet_ngr, spill_count,
       CAST(NULL AS VARCHAR) AS total_duration, 1998 AS reporting_year FROM fx_overflows WHERE reporting_year <= 1998
UNION ALL SELECT NULL, 'South', permit_ref, outlet_ngr, NULL, total_duration, 1999 FROM fx_overflows WHERE reporting_year > 1998"""),
    "overflow_summary": _sql("SELECT * FROM ovf_sum"),
    "site_pressure_join": _sql("""
SELECT site_id, total_pollution_incidents, total_edm_spills, total_spill_hours FROM pressure"""),
    "pressure_summary": _sql("SELECT site_id, has_any_incidents, total_all_incidents FROM pressure"),
    "pressure_totals": _sql("""
SELECT count(*) AS n_sites, count(*) FILTER (has_any_incidents) AS sites_with,
       count(*) FILTER (NOT has_any_incidents) AS sites_without, sum(total_pollution_incidents) AS incidents_matched,
       sum(total_edm_spills) AS spill_records_matched, round(sum(total_spill_hours), 2) AS spill_hours FROM pressure"""),
    "top_sites_by_pressure": _sql("""
SELECT site_id, total_all_incidents FROM pressure ORDER BY total_all_incidents DESC, site_id LIMIT 10"""),
    "merge_incidents": _sql("""
SELECT s.site_id, s.region, p.total_pollution_incidents, p.most_recent_pollution_date, p.primary_pollution_cause,
       p.total_edm_spills, p.total_spill_hours, p.most_recent_spill_date, p.has_any_incidents, p.total_all_incidents
FROM fx_sites s LEFT JOIN (SELECT * FROM pressure WHERE has_any_incidents) p USING (site_id)"""),
    "georeference_grid": _sql("SELECT permit_number, easting, northing FROM gridded"),
    "georeference_linear": _sql("""
SELECT permit_number, round(49.0 + northing / 111000, 5) AS lat_approx,
       round(-8.0 + easting / (111000 * 0.6), 5) AS lon_approx FROM gridded_effluent"""),
    "georeference_linear_table": _sql("""
SELECT permit_number, round(49.0 + northing / 111000, 5) AS lat_approx,
       round(-8.0 + easting / (111000 * 0.6), 5) AS lon_approx FROM gridded_by_table"""),
    "easting_northing_to_latlon": _sql("""
SELECT incident_id, round(plat, 6) AS lat, round(plon, 6) AS lon FROM inc_phi_done"""),
    "fill_coordinates": _sql("""
SELECT incident_id, round(coalesce(lat0, plat), 6) AS lat, round(coalesce(lon0, plon), 6) AS lon FROM gap_phi_done
WHERE coalesce(lat0, plat) IS NOT NULL"""),
    "classify_discharges": _sql("SELECT permit_number, effluent_type, discharge_category FROM classed"),
    "dedupe_discharges": _sql("""
SELECT concat('D', right(permit_number, 2)) AS permit_number, effluent_type,
       substr(discharge_ngr, 1, 4) AS discharge_ngr, min(discharge_site_name) AS discharge_site_name
FROM fx_discharges GROUP BY 1, 2, 3"""),
    "category_counts": _sql("SELECT discharge_category AS category, count(*) AS n FROM classed GROUP BY 1"),
    "status_counts": _sql("""
SELECT ecological_status AS category, count(*) AS n FROM status WHERE ecological_status IS NOT NULL GROUP BY 1"""),
    "discharge_summary": _sql(f"""
SELECT site_id, {', '.join(_NONE.format(c=c) for c in ('sewage_works_count', 'storm_overflows_count', 'industrial_discharges_count'))},
       nullif(total_discharge_points, 0) AS total_discharge_points, sewage_name, sewage_m, industrial_name, industrial_m
FROM dis_sum"""),
    "merge_site_layers": _sql("""
SELECT s.site_id, s.region, t.ecological_status, nullif(d.total_discharge_points, 0) AS total_discharge_points
FROM fx_sites s JOIN status t USING (site_id) JOIN dis_sum d USING (site_id)"""),
    "region_bounds": _sql("""
SELECT region, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM fx_sites GROUP BY region"""),
    "nearest_sites": _sql(f"""
SELECT site_id, round(d, 4) AS distance_km FROM (
  SELECT b.site_id, {haversine_sql("a", "b")} / 1000 AS d FROM (SELECT 52.5 AS lat, -1.5 AS lon) a, fx_sites b)
WHERE d <= 50 ORDER BY d, site_id LIMIT 10"""),
    "nearest_sites_batch": _sql(f"""
SELECT origin_id, site_id, nth, round(d, 4) AS distance_km FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY origin_id ORDER BY d, site_id) AS INTEGER) AS nth FROM (
    SELECT a.water_body_id AS origin_id, b.site_id, {haversine_sql("a", "b")} / 1000 AS d
    FROM (SELECT water_body_id, lat0 AS lat, lon0 AS lon FROM fx_tiles) a, fx_sites b) WHERE d <= 40) WHERE nth <= 5"""),
}
