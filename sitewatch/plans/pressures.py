"""Raw incidents, overflow returns and permits to the tables that the feed is enriched with."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatch import constants as C
from sitewatch.functions import geo
from sitewatch.operators import pressures, spatial
from sitewatch.operators.checkpoints import cut


@dataclass(frozen=True)
class Pressures:
    """Cleaned tables around the sites.

    ``incidents`` has ``incident_id, incident_date, pollutant_type, lat, lon``; ``overflows``
    ``point_id, reporting_year, spill_count, duration_hours, lat, lon``; ``permits``
    ``point_id, discharge_category, discharge_site_name, lat, lon``; ``polygons`` the water
    bodies with ``parts`` or ``ring``.
    """

    incidents: DataFrame
    overflows: DataFrame
    permits: DataFrame
    polygons: DataFrame


def enriched(feed: DataFrame, tables: Pressures, radius_m: float = 2000.0) -> DataFrame:
    """The feed with the structs ``incidents``, ``wfd_status`` and ``discharge_points``."""
    sites = feed.select("site_id", "lat", "lon")
    reports = tables.incidents.select("incident_date", "pollutant_type", "lat", "lon")
    spills = tables.overflows.select("reporting_year", "spill_count", "duration_hours", "lat", "lon")
    permits = tables.permits.select("point_id", "discharge_category", "discharge_site_name", "lat", "lon")
    near = pressures.incident_summary(sites, pressures.incidents_around(sites, reports, radius_m))
    spilled = pressures.overflow_summary(sites, pressures.overflows_around(sites, spills, radius_m))
    summary = pressures.pressure_summary(pressures.site_pressure_join(near, spilled))
    rivers = tables.polygons
    if "water_body_type" in rivers.columns:
        rivers = spatial.rivers(rivers).drop("water_body_type")
    status = spatial.clean_status(
        spatial.nearest_centroid_join(spatial.point_in_polygon_join(sites, rivers), rivers)
    )
    around = pressures.discharge_summary(sites, pressures.permits_around(sites, permits, radius_m))
    return pressures.merge_site_layers(pressures.merge_incidents(feed, summary), status, around)


def clean_incidents(
    incidents: DataFrame,
    pollutants: DataFrame,
    relevant_types: tuple[str, ...] = C.RELEVANT_POLLUTANT_TYPES,
    relevant_names: tuple[str, ...] = C.RELEVANT_POLLUTANTS,
    out_of_scope: tuple[str, ...] = C.OUT_OF_SCOPE_POLLUTANTS,
    order_by: str = "ord",
) -> DataFrame:
    """Incidents with water impact and a relevant pollutant, dated, located, once each.

    ``incidents`` has ``incident_id, water_impact, incident_time, grid_ref, easting, northing``
    and further columns, which are kept; ``pollutants`` ``incident_id, poll_type, pollutant``
    and the order of the list. Places come from the grid reference or else from easting
    and northing; reports without either go. Reports of one day, type and 100 m square are
    one incident. Sorted by date, latest first.
    """
    scoped = pressures.scope_incidents(
        pressures.filter_water_impact(incidents), pollutants, relevant_types, relevant_names, out_of_scope
    )
    named = pressures.attach_pollutants(scoped, pollutants, order_by)
    dated = pressures.incident_dates(named, "incident_time")
    said = {f"_{c}": F.col(c).try_cast("double") for c in ("easting", "northing")}
    # What is reported decides the square; the grid reference, if readable, decides the place.
    read = pressures.georeference_grid(dated.withColumns(said), "grid_ref")
    by_reference = F.col("easting").isNotNull()
    x = F.when(by_reference, F.col("easting")).otherwise(F.col("_easting"))
    y = F.when(by_reference, F.col("northing")).otherwise(F.col("_northing"))
    placed = read.withColumns({"_x": x, "_y": y}).drop("easting", "northing", "incident_time", "all_pollutants_text")
    placed = placed.withColumnsRenamed(
        {"_easting": "easting", "_northing": "northing", "poll_type": "pollutant_type", "pollutant": "primary_pollutant"}
    )
    once = pressures.dedupe_incidents(placed.where("_x IS NOT NULL AND _y IS NOT NULL"))
    return pressures.sort_incidents(cut(_located(once, "_x", "_y"), "incidents"))


def _located(df: DataFrame, x: str, y: str) -> DataFrame:
    """``lat, lon`` in place of the numbers of the grid, which were already found to be there."""
    lat, lon = geo.grid_to_latlon(F.col(x), F.col(y))
    return df.select(*[c for c in df.columns if c not in (x, y)], lat.alias("lat"), lon.alias("lon"))


def clean_overflows(returns: DataFrame, tie_breaks: tuple[str, ...] = ()) -> DataFrame:
    """Harmonised yearly returns to located overflows that spilled, one per asset and year.

    ``returns`` has the columns of :func:`harmonise_overflow_returns`. Records whose outlet
    reference cannot be read go. ``point_id`` names asset and year. Sorted by year, latest
    first, and company.
    """
    read = pressures.georeference_grid(returns, "outlet_ngr").where("easting IS NOT NULL")
    spilled = pressures.filter_zero_spills(pressures.dedupe_overflows(read, tie_breaks))
    timed = pressures.overflow_durations(_located(spilled, "easting", "northing"))
    name = F.concat_ws("/", F.col("reporting_year").cast("string"), "unique_id", "permit_ref", "outlet_ngr")
    return pressures.sort_overflows(cut(timed.withColumn("point_id", name), "overflows"))


def locate_permits(permits: DataFrame) -> DataFrame:
    """Sewage and industrial permits with their class and place, one per permit, type and reference.

    The effluent's grid reference serves, or else the site's; permits without a readable one go.
    """
    classified = pressures.classify_discharges(permits)
    read = pressures.georeference_grid(classified, "effluent_grid_ref", "discharge_ngr").where("easting IS NOT NULL")
    once = _located(pressures.dedupe_discharges(read), "easting", "northing")
    return cut(once.withColumn("point_id", F.concat_ws("/", "permit_number", "effluent_type", "discharge_ngr")), "permits")
