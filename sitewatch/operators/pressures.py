"""Incidents, storm overflows and discharge permits around the sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch import constants as C
from sitewatch.functions import geo
from sitewatch.functions.numeric import null_if_nan, parse_number, round_to_int
from sitewatch.functions.text import blank_to_null, without_first
from sitewatch.operators.spatial import radius_totals

# --- grid references ------------------------------------------------------------


Squares = dict[str, tuple[int, int]]


def _once(df: DataFrame, name: str, **fields: Column) -> DataFrame:
    """Add a struct that is computed once per row, whatever uses it later."""
    return df.withColumn(name, F.explode(F.array(F.struct(*[value.alias(field) for field, value in fields.items()]))))


def _grid_places(df: DataFrame, reference: Column, squares: Squares) -> DataFrame:
    """Add ``_place`` with easting and northing of "AB 123 456"; anything malformed gives nulls."""
    compact = F.col("_read.compact")
    digits = without_first(compact, 2)
    read = _once(df, "_read", compact=F.upper(F.replace(F.trim(reference), F.lit(" "), F.lit(""))))
    square = F.try_element_at(_square_map(squares), F.substring(compact, 1, 2))
    valid = compact.rlike("^[A-Z]{2}([0-9]{2}){1,}$")
    read = _once(read, "_parts", digits=digits, half=F.length(digits) / 2, square=F.when(valid, square))
    digits, half, square = (F.col(f"_parts.{c}") for c in ("digits", "half", "square"))

    def metres(index: str, start: Column) -> Column:
        part = F.substring(digits, start, half.cast("int")).try_cast("double")
        scale = F.pow(F.lit(10.0), 5 - half)
        return F.when(square.isNotNull(), square[index] * 100_000.0 + part * scale)

    placed = _once(read, "_place", easting=metres("column", F.lit(1)), northing=metres("row", half.cast("int") + 1))
    return placed.drop("_read", "_parts")


def _square_map(squares: Squares) -> Column:
    entries = []
    for letters, (column, row) in squares.items():
        entries += [
            F.lit(letters),
            F.struct(F.lit(float(column)).alias("column"), F.lit(float(row)).alias("row")),
        ]
    return F.create_map(*entries)


def georeference_grid(
    df: DataFrame, column: str, fallback: str | None = None, squares: Squares = C.GRID_SQUARES
) -> DataFrame:
    """Add ``easting`` and ``northing`` from a grid reference column.

    With ``fallback`` that column serves where the first is null. Unreadable
    references give null; callers that need a location drop them.
    """
    reference = F.col(column) if fallback is None else F.coalesce(column, fallback)
    placed = _grid_places(df, reference, squares)
    return placed.withColumn("easting", F.col("_place.easting")).withColumn("northing", F.col("_place.northing")).drop("_place")


def georeference_linear(df: DataFrame, column: str, squares: Squares = C.GRID_SQUARES) -> DataFrame:
    """Parity mode: ``lat_approx, lon_approx`` by the straight-line formula.

    ``squares`` says which letters stand for which square; ``C.LINEAR_SQUARES`` is the table
    that published approximate places were made with, which differs for some letters.
    """
    placed = _grid_places(df, F.col(column), squares)
    lat, lon = geo.linear_grid_to_latlon(F.col("_place.easting"), F.col("_place.northing"))
    return placed.withColumn("lat_approx", lat).withColumn("lon_approx", lon).drop("_place")


def easting_northing_to_latlon(df: DataFrame) -> DataFrame:
    lat, lon = geo.grid_to_latlon(
        F.col("easting").cast("double"), F.col("northing").cast("double")
    )
    return df.withColumn("lat", lat).withColumn("lon", lon)


def fill_coordinates(df: DataFrame) -> DataFrame:
    """Fill missing ``lat, lon`` from ``easting, northing``; drop what stays without."""
    easting = F.col("easting").try_cast("double")
    northing = F.col("northing").try_cast("double")
    lat, lon = geo.grid_to_latlon(easting, northing)
    known = F.col("lat").isNotNull()
    return (
        df.withColumn("_lat", F.when(known, F.col("lat")).otherwise(lat))
        .withColumn("_lon", F.when(known, F.col("lon")).otherwise(lon))
        .drop("lat", "lon")
        .withColumnsRenamed({"_lat": "lat", "_lon": "lon"})
        .where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    )


# --- incidents --------------------------------------------------------------------


def filter_water_impact(incidents: DataFrame) -> DataFrame:
    return incidents.where(F.col("water_impact").isin(*C.WATER_IMPACT_CATEGORIES))


def scope_incidents(
    incidents: DataFrame,
    pollutants: DataFrame,
    relevant_types: tuple[str, ...] = C.RELEVANT_POLLUTANT_TYPES,
    relevant_names: tuple[str, ...] = C.RELEVANT_POLLUTANTS,
    out_of_scope: tuple[str, ...] = C.OUT_OF_SCOPE_POLLUTANTS,
) -> DataFrame:
    """Incidents with a relevant pollutant, and every major one, once per id."""
    listed = F.col("poll_type").isin(*relevant_types) | F.col("pollutant").isin(*relevant_names)
    in_scope = (
        pollutants.where(listed & ~F.col("pollutant").isin(*out_of_scope))
        .select("incident_id")
        .distinct()
        .withColumn("_relevant", F.lit(True))
    )
    major = F.col("water_impact") == C.WATER_IMPACT_CATEGORIES[0]
    return (
        incidents.join(in_scope, "incident_id", "left")
        .where(F.col("_relevant") | major)
        .drop("_relevant")
        .dropDuplicates(["incident_id"])
    )


def attach_pollutants(incidents: DataFrame, pollutants: DataFrame, order_by: str = "ord") -> DataFrame:
    """Add first type, first name, and all names as array and as text.

    "First" is the lowest ``order_by``, then type and name.
    """
    ordered = F.array_sort(F.collect_list(F.struct(order_by, "poll_type", "pollutant")))
    own = pollutants.join(incidents.select("incident_id").distinct(), "incident_id", "left_semi")
    listed = own.groupBy("incident_id").agg(ordered.alias("_all"))
    first = F.get("_all", F.lit(0))
    names = F.transform("_all", lambda e: e["pollutant"])
    summary = listed.select(
        "incident_id",
        first["poll_type"].alias("poll_type"),
        first["pollutant"].alias("pollutant"),
        names.alias("all_pollutants"),
        F.array_join(names, "; ").alias("all_pollutants_text"),
    )
    return incidents.join(summary, "incident_id", "left")


def incident_dates(incidents: DataFrame, column: str = "incident_time") -> DataFrame:
    """Add ``incident_date`` from text like 31/12/2020 23:59:59; unreadable is null."""
    moment = F.try_to_timestamp(F.col(column), F.lit("dd/MM/yyyy HH:mm:ss"))
    return incidents.withColumn("incident_date", moment.cast("date"))


def dedupe_incidents(incidents: DataFrame, keep_first: str = "incident_id") -> DataFrame:
    """One incident per (date, 100 m square, type) with ``raw_report_count``.

    The row with the lowest id represents the group. Halves round away from zero;
    incidents without a square group together.
    """
    square = [F.round(F.col(c).cast("double") / 100).alias(f"_{c}") for c in ("easting", "northing")]
    rest = [c for c in incidents.columns if c not in ("incident_date", "pollutant_type", keep_first)]
    keyed = incidents.select("*", *square)
    return (
        keyed.groupBy("incident_date", "_easting", "_northing", "pollutant_type")
        .agg(
            F.min(F.struct(keep_first, *rest)).alias("_row"),
            F.count(F.lit(1)).alias("raw_report_count"),
        )
        .select("incident_date", "pollutant_type", "_row.*", "raw_report_count")
    )


def sort_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.orderBy(F.desc_nulls_first("incident_date"), "incident_id")


# --- storm overflows ----------------------------------------------------------------


def overflow_durations(df: DataFrame) -> DataFrame:
    """Add ``duration_hours``: plain numbers, H:MM:SS, or a spreadsheet's 1899 time."""
    text = F.col("total_duration")
    parts = F.split(text, ":")
    clock = (
        parts[0].try_cast("double") + parts[1].try_cast("double") / 60 + parts[2].try_cast("double") / 3600
    )
    moment = F.try_to_timestamp(text)
    of_day = F.hour(moment) + F.minute(moment) / 60 + F.second(moment) / 3600
    hours = (
        F.when(text.contains("1899"), of_day)
        .when(text.rlike(r"^[0-9]+:[0-9]{2}:[0-9]{2}$"), clock)
        .otherwise(parse_number(text))
    )
    return df.withColumn("duration_hours", hours)


def numeric_spills(df: DataFrame) -> DataFrame:
    return df.withColumn("spill_count", parse_number(F.col("spill_count").cast("string")))


def dedupe_overflows(df: DataFrame, tie_breaks: tuple[str, ...] = ()) -> DataFrame:
    """Per asset and year the record with most spills.

    The asset is ``unique_id``; where that is missing, permit and outlet reference.
    Equal counts fall back to ``tie_breaks`` and then to all other columns. A table
    without ``unique_id`` is treated as all missing.
    """
    if "unique_id" not in df.columns:
        df = df.withColumn("unique_id", F.lit(None).cast("string"))
    counted = numeric_spills(df)
    missing = F.col("unique_id").isNull()
    keys = [
        F.col("unique_id"),
        F.col("reporting_year"),
        *[F.when(missing, F.col(c)).alias(f"_{c}") for c in ("permit_ref", "outlet_ngr") if c in df.columns],
    ]
    rest = [c for c in counted.columns if c not in ("unique_id", "reporting_year", "spill_count")]
    ordered = [*tie_breaks, *[c for c in rest if c not in tie_breaks]]
    # The smallest struct: most spills first, unknown counts last.
    best = F.min(
        F.struct(
            F.col("spill_count").isNull().alias("_unknown"),
            (-F.col("spill_count")).alias("_less"),
            *[F.col(c) for c in ordered],
        )
    )
    picked = counted.groupBy(*keys).agg(best.alias("_row"))
    return picked.select(
        "unique_id",
        "reporting_year",
        (-F.col("_row._less")).alias("spill_count"),
        *[F.col(f"_row.{c}").alias(c) for c in rest],
    )


def filter_zero_spills(df: DataFrame) -> DataFrame:
    """Keep records that spilled or whose count is unknown."""
    spills = F.col("spill_count")
    return df.where((spills > 0) | spills.isNull())


def sort_overflows(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("reporting_year"), F.asc_nulls_first("water_company"))


# --- discharge permits ----------------------------------------------------------------


def classify_discharges(df: DataFrame) -> DataFrame:
    """Keep effluent permits and name their class; overflows are tested first."""
    code = F.col("effluent_type")
    targets = dict.fromkeys(C.SEWAGE_CODES + C.INDUSTRIAL_CODES)
    label = (
        F.when(code.isin(*C.STORM_OVERFLOW_CODES), "storm_overflow")
        .when(code.isin(*C.SEWAGE_CODES), "sewage_works")
        .when(code.isin(*C.INDUSTRIAL_CODES), "industrial")
        .otherwise("other")
    )
    return df.where(code.isin(*targets)).withColumn("discharge_category", label)


def dedupe_discharges(df: DataFrame) -> DataFrame:
    """One row per (permit, effluent type, grid reference): the lowest of them."""
    keys = ["permit_number", "effluent_type", "discharge_ngr"]
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*")


def category_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "category")
    )


# --- per-site summaries -----------------------------------------------------------------


def _stands_for(pairs: DataFrame) -> Column:
    """Points that a row stands for: ``n_points``, or one where rows are single pairs."""
    return F.col("n_points") if "n_points" in pairs.columns else F.lit(1).cast("long")


def incidents_around(sites: DataFrame, incidents: DataFrame, radius_m: float) -> DataFrame:
    """Incidents near each site, counted per cause; for :func:`incident_summary`."""
    latest = {"incident_date": F.max("incident_date")}
    return radius_totals(
        sites, incidents, radius_m,
        {"n_points": F.count(F.lit(1))} | latest, {"n_points": F.sum("n_points")} | latest, ("pollutant_type",),
    )


def overflows_around(sites: DataFrame, overflows: DataFrame, radius_m: float) -> DataFrame:
    """Overflow records near each site, summed up; for :func:`overflow_summary`."""
    known = {c: null_if_nan(F.col(c).cast("double")) for c in ("spill_count", "duration_hours")}
    totals = {c: F.sum(c) for c in known} | {"reporting_year": F.max("reporting_year")}
    return radius_totals(
        sites, overflows.withColumns(known), radius_m,
        {"n_points": F.count(F.lit(1))} | totals, {"n_points": F.sum("n_points")} | totals,
    )


def permits_around(sites: DataFrame, permits: DataFrame, radius_m: float) -> DataFrame:
    """Permits near each site per category, with the nearest one; for :func:`discharge_summary`."""
    own = F.struct("point_id", "discharge_site_name")
    nearest = F.struct("distance_m", "_first.point_id", "_first.discharge_site_name")
    found = radius_totals(
        sites, permits, radius_m,
        {"n_points": F.count(F.lit(1)), "_first": F.min(own)},
        {"n_points": F.sum("n_points"), "_nearest": F.min(nearest)},
        ("discharge_category",),
    )
    return found.select("site_id", "discharge_category", "n_points", "_nearest.*")


def incident_summary(sites: DataFrame, pairs: DataFrame) -> DataFrame:
    """Count, latest date and modal cause per site; 0 and null when none.

    Causes are counted per (site, cause) first, so a busy site is never one group
    of raw pairs. Equal counts go to the alphabetically first cause. ``pairs`` may be
    totals with ``n_points``.
    """
    by_cause = pairs.groupBy("site_id", "pollutant_type").agg(
        F.sum(_stands_for(pairs)).alias("_n"), F.max("incident_date").alias("_latest")
    )
    named = F.when(
        F.col("pollutant_type").isNotNull(), F.struct((-F.col("_n")).alias("_less"), "pollutant_type")
    )
    per_site = by_cause.groupBy("site_id").agg(
        F.sum("_n").alias("total_pollution_incidents"),
        F.date_format(F.max("_latest"), "yyyy-MM-dd").alias("most_recent_pollution_date"),
        F.min(named)["pollutant_type"].alias("primary_pollution_cause"),
    )
    return sites.select("site_id").join(per_site, "site_id", "left").fillna(
        0, ["total_pollution_incidents"]
    )


def overflow_summary(sites: DataFrame, pairs: DataFrame) -> DataFrame:
    """Records, spill events, spill hours and latest year per site.

    ``pairs`` may be totals with ``n_points``.
    """
    per_site = pairs.groupBy("site_id").agg(
        F.sum(_stands_for(pairs)).alias("total_edm_spills"),
        F.sum(null_if_nan(F.col("spill_count"))).cast("long").alias("total_edm_spill_events"),
        F.round(F.sum(null_if_nan(F.col("duration_hours"))), 2).alias("total_spill_hours"),
        F.max("reporting_year").cast("int").cast("string").alias("most_recent_spill_date"),
    )
    return (
        sites.select("site_id")
        .join(per_site, "site_id", "left")
        .fillna(0, ["total_edm_spills", "total_edm_spill_events"])
        .fillna(0.0, ["total_spill_hours"])
    )


def site_pressure_join(incidents: DataFrame, overflows: DataFrame) -> DataFrame:
    return incidents.join(overflows, "site_id", "full")


def pressure_summary(joined: DataFrame) -> DataFrame:
    """Add the combined indicators. A side without the site leaves them null."""
    incidents, spills = F.col("total_pollution_incidents"), F.col("total_edm_spills")
    return joined.withColumn("has_any_incidents", (incidents > 0) | (spills > 0)).withColumn(
        "total_all_incidents", incidents + spills
    )


def pressure_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("n_sites"),
        F.count_if(F.col("has_any_incidents")).alias("sites_with"),
        F.count_if(~F.coalesce("has_any_incidents", F.lit(False))).alias("sites_without"),
        F.sum("total_pollution_incidents").alias("incidents_matched"),
        F.sum("total_edm_spills").alias("spill_records_matched"),
        F.round(F.sum("total_spill_hours"), 2).alias("spill_hours"),
    )


def discharge_summary(sites: DataFrame, pairs: DataFrame) -> DataFrame:
    """``discharge_points`` struct per site: counts by class and nearest works.

    ``pairs`` has ``site_id, point_id, discharge_category, discharge_site_name,
    distance_m``. Equal distances go to the smaller permit id. Rows may be totals per
    category with ``n_points`` and the nearest point.
    """
    category, stands_for = F.col("discharge_category"), _stands_for(pairs)

    def count_of(name: str) -> Column:
        return F.sum(F.when(category == name, stands_for).otherwise(F.lit(0)))

    def nearest(*names: str) -> Column:
        row = F.when(
            category.isin(*names), F.struct("distance_m", "point_id", "discharge_site_name")
        )
        return F.min(row)

    def facility(column: str) -> Column:
        row = F.col(column)
        name = F.coalesce(blank_to_null(row["discharge_site_name"]), F.lit("Unknown"))
        metres = round_to_int(row["distance_m"])
        return F.when(
            row.isNotNull(), F.struct(name.alias("name"), metres.alias("distance_m"))
        )

    per_site = pairs.groupBy("site_id").agg(
        count_of("sewage_works").alias("sewage_works_count"),
        count_of("storm_overflow").alias("storm_overflows_count"),
        count_of("industrial").alias("industrial_discharges_count"),
        F.sum(stands_for).alias("total_discharge_points"),
        nearest("sewage_works", "storm_overflow").alias("_sewage"),
        nearest("industrial").alias("_industrial"),
    )
    summary = per_site.select(
        "site_id",
        F.struct(
            "sewage_works_count",
            "storm_overflows_count",
            "industrial_discharges_count",
            "total_discharge_points",
            (F.col("total_discharge_points") > 0).alias("has_discharge_points"),
            facility("_sewage").alias("nearest_sewage_work"),
            facility("_industrial").alias("nearest_industrial"),
        ).alias("discharge_points"),
    )
    return sites.select("site_id").join(summary, "site_id", "left")


# --- merging into the feed ----------------------------------------------------------------


def merge_incidents(feed: DataFrame, summary: DataFrame) -> DataFrame:
    """Attach the ``incidents`` struct to sites that have any."""

    def field(key: str) -> Column:
        column = F.col(f"_i.{key}")
        if key == "total_spill_hours":
            column = F.coalesce(column.cast("double"), F.lit(0.0))
        elif key.startswith("most_recent"):
            column = column.cast("string")
        return column.alias(key)

    nested = summary.select("site_id", F.struct(*C.INCIDENT_KEYS).alias("_i")).where(
        F.col("_i.has_any_incidents")
    )
    attached = feed.drop("incidents").join(nested, "site_id", "left")
    struct = F.struct(*[field(k) for k in C.INCIDENT_KEYS])
    return attached.withColumn("incidents", F.when(F.col("_i").isNotNull(), struct)).drop("_i")


def merge_site_layers(feed: DataFrame, status: DataFrame, discharges: DataFrame) -> DataFrame:
    """Attach water-body status and, where there are any, discharge points."""
    usable = discharges.where(F.col("discharge_points.has_discharge_points"))
    return (
        feed.drop("wfd_status", "discharge_points")
        .join(status.select("site_id", "wfd_status"), "site_id", "left")
        .join(usable.select("site_id", "discharge_points"), "site_id", "left")
    )
