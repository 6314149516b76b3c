"""Cleaning, statistics and feature queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sitewatch.catalog.base import (
    DETERMINAND_OK,
    FEATURES,
    MATERIAL_OK,
    PANEL,
    RANGE_OK,
    UNIT_OK,
    imputed,
    observations,
    r,
    signatures,
    sql,
    stats,
    stats_layer,
)
from sitewatch.fixtures import view
from sitewatch.operators import cleaning, features, statistics
from sitewatch.operators.checkpoints import cut
from sitewatch.operators.feed import union_by_name

_RAW = "site_id, determinand_code, determinant, unit, sample_material, result_raw, sample_datetime"
_NAMES = _RAW.split(", ")


def _raw(spark, sf):
    return view(spark, sf, "fx_obs_raw")


def harmonise_columns(spark, sf):
    old_style = _raw(spark, sf).withColumnsRenamed(
        {
            "site_id": "samplingPoint.notation",
            "determinand_code": "determinand.notation",
            "determinant": "determinand.prefLabel",
            "sample_material": "sampleMaterialType",
            "result_raw": "result",
            "sample_datetime": "phenomenonTime",
        }
    )
    return cleaning.harmonise_columns(old_style).select(*_NAMES)


def parse_censored(spark, sf):
    return cleaning.parse_censored(_raw(spark, sf)).select(
        "site_id", "determinand_code", "result_raw", "is_left_censored", r("value")
    )


def physical_range_filter(spark, sf):
    parsed = cleaning.parse_censored(_raw(spark, sf))
    return cleaning.physical_range_filter(parsed).select("site_id", "determinant", r("value"))


def parse_sample_time(spark, sf):
    # Times as text: one in thirteen is unreadable, some have no time of day.
    text = _raw(spark, sf).withColumn(
        "sample_datetime",
        F.when(F.substring("result_raw", 1, 1) == "N", F.lit("not a date"))
        .when(F.col("determinand_code") == "0001", F.date_format("sample_datetime", "yyyy-MM-dd"))
        .otherwise(F.date_format("sample_datetime", "yyyy-MM-dd HH:mm:ss")),
    )
    return cleaning.parse_sample_time(text).select("site_id", "sample_datetime", "sample_dt", "year")


def clean_observations(spark, sf):
    return observations(spark, sf).select(
        "site_id", "determinand_code", "determinant", "unit", "is_left_censored", r("value"), "sample_dt", "year"
    )


def drop_invalid(spark, sf):
    parsed = cleaning.parse_sample_time(cleaning.parse_censored(_raw(spark, sf)))
    return cleaning.drop_invalid(parsed).select("site_id", "determinand_code", r("value"), "sample_dt")


def stage_profile(spark, sf):
    return cleaning.stage_profile(_raw(spark, sf)).select("stage", "n_rows", "n_sites", "n_determinands")


def site_determinand_stats(spark, sf):
    return stats(spark, sf).select(
        "site_id", "determinand_code", "unit", "n", r("mean"), r("median"), r("std"), r("min"), r("max"),
        r("q10"), r("q90"), "determinant", "dt_min", "dt_max",
    )


def choose_panel_features(spark, sf):
    return features.choose_panel_features(_stats_table(spark, sf), PANEL)


def choose_features_by_coverage(spark, sf):
    return features.choose_features_by_coverage(_stats_table(spark, sf), FEATURES).select(
        "determinand_code", "unit", "n_sites", r("median_n_per_site"), "feature"
    )


def select_features_join(spark, sf):
    table = _stats_table(spark, sf)
    chosen = features.choose_features_by_coverage(table, FEATURES)
    return features.select_features_join(table, chosen).select(
        "site_id", "determinand_code", "unit", "n", r("median")
    )


def _stats_table(spark, sf):
    return stats_layer(spark, sf)


def _labelled(spark, sf):
    sites = view(spark, sf, "fx_sites").select("site_id", "site_label", "region", "lat", "lon")
    return observations(spark, sf).join(sites, "site_id")


def site_metadata(spark, sf):
    meta = statistics.site_metadata(_labelled(spark, sf), ("sample_dt",))
    return meta.select("site_id", "site_label", r("lon"), r("lat"), "region", "area")


def site_coverage(spark, sf):
    return statistics.site_coverage(observations(spark, sf)).select(
        "site_id", "first_sample", "last_sample", "total_observations", "distinct_sample_dates",
        r("avg_days_between_visits"),
    )


def site_meta_join(spark, sf):
    obs = _labelled(spark, sf)
    built = signatures(spark, sf)
    matrix = features.signature_matrix(built.grid, built.features)
    joined = features.site_meta_join(
        statistics.site_metadata(obs), statistics.site_coverage(obs), matrix
    )
    return joined.select(
        "site_id", "region", "total_observations", "distinct_sample_dates",
        F.round("pH", 6).alias("ph"), F.round("Nitrate as N", 6).alias("nitrate"),
    )


def signature_matrix(spark, sf):
    selected = features.select_features(_stats_table(spark, sf), FEATURES)
    matrix = features.signature_matrix(features.signature_long(selected), list(PANEL.values()))
    return matrix.select(
        "site_id",
        F.round("Temperature of Water", 6).alias("temperature"),
        F.round("pH", 6).alias("ph"),
        F.round("Nitrate as N", 6).alias("nitrate"),
        F.round("Orthophosphate, reactive as P", 6).alias("phosphate"),
        F.round("Conductivity at 25 C", 6).alias("conductivity"),
    )


def prune_features(spark, sf):
    long = cut(
        features.signature_long(features.select_features(_stats_table(spark, sf), FEATURES)), "signatures"
    )
    return features.prune_features(long, 0.96).select("feature", "n_present", r("coverage"))


def prune_sites(spark, sf):
    return signatures(spark, sf).sites


def impute_median(spark, sf):
    return features.impute_median(signatures(spark, sf).grid).select(
        "site_id", "feature", r("value"), "is_imputed"
    )


def standard_scale(spark, sf):
    return features.standard_scale(imputed(spark, sf)).select("site_id", "feature", r("value"))


def feature_model(spark, sf):
    return features.feature_model(signatures(spark, sf).grid).select(
        "position", "feature", r("median"), r("mean"), r("std")
    )


def embed_2d(spark, sf):
    scaled = features.standard_scale(imputed(spark, sf))
    return features.embed_2d(scaled).select("site_id", r("umap_x", 4), r("umap_y", 4))


def typology_join(spark, sf):
    sites = view(spark, sf, "fx_sites")
    # Every customer twice, as a lookup with repeated rows has it.
    lookup = sites.select("site_id", F.col("wfd_type").alias("water_body_typology")).union(
        sites.select("site_id", F.lower("wfd_type"))
    )
    return features.typology_join(sites.select("site_id", "region"), lookup)


def data_period(spark, sf):
    return statistics.data_period(observations(spark, sf))


def events_coverage(spark, sf):
    return statistics.site_coverage(view(spark, sf, "fx_events_obs")).select(
        "site_id", "total_observations", "distinct_sample_dates", r("avg_days_between_visits")
    )


def union_by_name_query(spark, sf):
    first = view(spark, sf, "fx_incidents").select("incident_id", "water_impact", "lat")
    second = view(spark, sf, "fx_overflows").select(
        F.col("permit_ref").alias("incident_id"), "reporting_year"
    )
    return union_by_name(first, second).select(
        "incident_id", "water_impact", r("lat"), "reporting_year"
    )


def linear_quantile_stats(spark, sf):
    table = statistics.site_determinand_stats(
        observations(spark, sf), replace(FEATURES), interpolation="linear"
    )
    return table.select("site_id", "determinand_code", "unit", r("q10"), r("q90"))


QUERIES = {
    "harmonise_columns": harmonise_columns,
    "filter_material": lambda spark, sf: cleaning.filter_material(_raw(spark, sf)).select(*_NAMES),
    "exclude_determinands": lambda spark, sf: cleaning.exclude_determinands(_raw(spark, sf)).select(*_NAMES),
    "exclude_units": lambda spark, sf: cleaning.exclude_units(_raw(spark, sf)).select(*_NAMES),
    "parse_censored": parse_censored,
    "physical_range_filter": physical_range_filter,
    "parse_sample_time": parse_sample_time,
    "drop_invalid": drop_invalid,
    "clean_observations": clean_observations,
    "stage_profile": stage_profile,
    "site_determinand_stats": site_determinand_stats,
    "site_determinand_stats_linear": linear_quantile_stats,
    "choose_panel_features": choose_panel_features,
    "choose_features_by_coverage": choose_features_by_coverage,
    "select_features_join": select_features_join,
    "site_metadata": site_metadata,
    "site_coverage": site_coverage,
    "site_coverage_events": events_coverage,
    "site_meta_join": site_meta_join,
    "signature_matrix": signature_matrix,
    "prune_features": prune_features,
    "prune_sites": prune_sites,
    "impute_median": impute_median,
    "standard_scale": standard_scale,
    "feature_model": feature_model,
    "embed_2d": embed_2d,
    "typology_join": typology_join,
    "data_period": data_period,
    "union_by_name": union_by_name_query,
}


def _leading_axis(matrix: str) -> str:
    """Unit eigenvector of the largest eigenvalue of the symmetric matrix in ``m`` of a one-row table.

    The matrix is squared and scaled again and again, which leaves the outer product of the
    vector with itself; its longest row gives the vector, whose largest entry is made positive.
    """
    return f"""
WITH RECURSIVE powers AS (
  SELECT 0 AS t, m FROM {matrix}
  UNION ALL
  SELECT t + 1, list_transform(q, lambda r: list_transform(r, lambda x: x / list_max(list_transform(q, lambda s: list_max(list_transform(s, lambda y: abs(y)))))))
  FROM (SELECT t, list_transform(m, lambda r: list_transform(m, lambda s: list_dot_product(r, s))) AS q FROM powers WHERE t < 24)),
longest AS (SELECT r FROM (SELECT unnest(m) AS r FROM powers WHERE t = 24) ORDER BY list_dot_product(r, r) DESC LIMIT 1),
largest AS (SELECT sign(max_by(y, abs(y))) AS g FROM (SELECT unnest(r) AS y FROM longest))
SELECT list_transform(r, lambda x: x * g / sqrt(list_dot_product(r, r))) AS v FROM longest, largest"""


AXES = {
    "scaled": """
SELECT site_id, feature, (value - avg(value) OVER w) /
       (CASE WHEN stddev_pop(value) OVER w > 1e-12 THEN stddev_pop(value) OVER w ELSE 1 END) AS value
FROM filled WINDOW w AS (PARTITION BY feature)""",
    "scaled_rows": "SELECT site_id, list(value ORDER BY feature) AS z FROM scaled GROUP BY site_id",
    "scatter": """
SELECT list(line ORDER BY i) AS m FROM (
  SELECT i, list(c ORDER BY j) AS line FROM (
    SELECT a.feature AS i, b.feature AS j, sum(a.value * b.value) AS c
    FROM scaled a JOIN scaled b USING (site_id) GROUP BY 1, 2) GROUP BY i)""",
    "axis_1": _leading_axis("scatter"),
    "rest": """
SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - v[i] * v[j]
  * list_dot_product(v, list_transform(m, lambda s: list_dot_product(s, v))))) AS m FROM scatter, axis_1""",
    "axis_2": _leading_axis("rest"),
}


def _stage(name: str, condition: str) -> str:
    return (
        f"SELECT '{name}' AS stage, count(*) AS n_rows, count(DISTINCT coalesce(site_id, '∅')) AS n_sites, "
        f"count(DISTINCT coalesce(determinant, '∅')) AS n_determinands FROM parsed WHERE {condition}"
    )


_M, _D, _U = MATERIAL_OK, f"{MATERIAL_OK} AND {DETERMINAND_OK}", f"{MATERIAL_OK} AND {DETERMINAND_OK} AND {UNIT_OK}"
_R = f"{_U} AND coalesce({RANGE_OK}, false)"

_GAP = (
    "CASE WHEN {d} > 1 THEN round(floor(date_diff('second', min(sample_dt), max(sample_dt)) / 86400) / {d}, 6) END"
)
_DISTINCT = "count(DISTINCT sample_dt)"

_PIVOT = """
SELECT site_id,
       round(max(value) FILTER (feature = 'Temperature of Water'), 6) AS temperature,
       round(max(value) FILTER (feature = 'pH'), 6) AS ph,
       round(max(value) FILTER (feature = 'Nitrate as N'), 6) AS nitrate,
       round(max(value) FILTER (feature = 'Orthophosphate, reactive as P'), 6) AS phosphate,
       round(max(value) FILTER (feature = 'Conductivity at 25 C'), 6) AS conductivity
FROM sig_long GROUP BY site_id"""

ORACLES = {
    "harmonise_columns": sql(f"SELECT {_RAW} FROM fx_obs_raw"),
    "filter_material": sql(f"SELECT {_RAW} FROM fx_obs_raw WHERE {MATERIAL_OK}"),
    "exclude_determinands": sql(f"SELECT {_RAW} FROM fx_obs_raw WHERE {DETERMINAND_OK}"),
    "exclude_units": sql(f"SELECT {_RAW} FROM fx_obs_raw WHERE {UNIT_OK}"),
    "parse_censored": sql(
        "SELECT site_id, determinand_code, result_raw, is_left_censored, round(value, 6) AS value FROM parsed"
    ),
    "physical_range_filter": sql(
        f"SELECT site_id, determinant, round(value, 6) AS value FROM parsed WHERE {RANGE_OK}"
    ),
    "parse_sample_time": sql("""
SELECT site_id, sample_datetime, TRY_CAST(sample_datetime AS TIMESTAMP) AS sample_dt,
       year(TRY_CAST(sample_datetime AS TIMESTAMP)) AS year
FROM (SELECT site_id, CASE WHEN substr(result_raw, 1, 1) = 'N' THEN 'not a date'
                           WHEN determinand_code = '0001' THEN strftime(sample_datetime, '%Y-%m-%d')
                           ELSE strftime(sample_datetime, '%Y-%m-%d %H:%M:%S') END AS sample_datetime
      FROM fx_obs_raw)"""),
    "drop_invalid": sql("""
SELECT site_id, determinand_code, round(value, 6) AS value, sample_dt FROM parsed
WHERE value IS NOT NULL AND sample_dt IS NOT NULL AND site_id IS NOT NULL"""),
    "clean_observations": sql("""
SELECT site_id, determinand_code, determinant, unit, is_left_censored, round(value, 6) AS value,
       sample_dt, year FROM cleaned"""),
    "stage_profile": sql(" UNION ALL ".join([
        _stage("after_rename", "true"),
        _stage("after_material", _M),
        _stage("after_determinands", _D),
        _stage("after_units", _U),
        _stage("after_parsing", _U),
        _stage("after_physical_range", _R),
        _stage("final", f"{_R} AND value IS NOT NULL AND sample_dt IS NOT NULL AND site_id IS NOT NULL"),
    ])),
    "site_determinand_stats": sql("""
SELECT site_id, determinand_code, unit, n, round(mean, 6) AS mean, round(median, 6) AS median,
       round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(q10, 6) AS q10,
       round(q90, 6) AS q90, determinant, dt_min, dt_max FROM det_stats"""),
    "site_determinand_stats_linear": sql("""
SELECT site_id, determinand_code, unit, round(quantile_cont(value, 0.1), 6) AS q10,
       round(quantile_cont(value, 0.9), 6) AS q90
FROM cleaned WHERE year BETWEEN 1996 AND 2000 GROUP BY site_id, determinand_code, unit"""),
    "choose_panel_features": sql("SELECT DISTINCT determinand_code, feature FROM selected"),
    "choose_features_by_coverage": sql("""
SELECT determinand_code, unit, count(DISTINCT site_id) AS n_sites,
       round(quantile_cont(n, 0.5), 6) AS median_n_per_site,
       coalesce(min(determinant), determinand_code) AS feature
FROM det_stats WHERE n >= 4 GROUP BY determinand_code, unit HAVING count(DISTINCT site_id) >= 100"""),
    "select_features_join": sql("""
SELECT site_id, determinand_code, unit, n, round(median, 6) AS median FROM det_stats
WHERE (determinand_code, unit) IN (
  SELECT (determinand_code, unit) FROM det_stats WHERE n >= 4 GROUP BY determinand_code, unit
  HAVING count(DISTINCT site_id) >= 100)"""),
    "site_metadata": sql("""
SELECT site_id, min(site_label) AS site_label, round(min(lon), 6) AS lon, round(min(lat), 6) AS lat,
       min(region) AS region, CAST(NULL AS VARCHAR) AS area
FROM cleaned JOIN fx_sites USING (site_id) GROUP BY site_id"""),
    "site_coverage": sql(f"""
SELECT site_id, min(sample_dt) AS first_sample, max(sample_dt) AS last_sample,
       count(value) AS total_observations, {_DISTINCT} AS distinct_sample_dates,
       {_GAP.format(d=_DISTINCT)} AS avg_days_between_visits
FROM cleaned GROUP BY site_id"""),
    "site_coverage_events": sql(f"""
SELECT site_id, count(value) AS total_observations, {_DISTINCT} AS distinct_sample_dates,
       {_GAP.format(d=_DISTINCT)} AS avg_days_between_visits
FROM fx_events_obs GROUP BY site_id"""),
    "site_meta_join": sql("""
SELECT c.site_id, c.region, c.total_observations, c.distinct_sample_dates,
       round(max(g.value) FILTER (g.feature = 'pH'), 6) AS ph,
       round(max(g.value) FILTER (g.feature = 'Nitrate as N'), 6) AS nitrate
FROM (SELECT site_id, min(region) AS region, count(value) AS total_observations,
             count(DISTINCT sample_dt) AS distinct_sample_dates
      FROM cleaned JOIN fx_sites USING (site_id) GROUP BY site_id) c
JOIN grid g USING (site_id) GROUP BY ALL"""),
    "signature_matrix": sql(_PIVOT),
    "prune_features": sql("""
SELECT feature, count(*) AS n_present,
       round(count(*) / (SELECT count(DISTINCT site_id) FROM sig_long), 6) AS coverage
FROM sig_long GROUP BY feature
HAVING count(*) / (SELECT count(DISTINCT site_id) FROM sig_long) >= 0.96"""),
    "prune_sites": sql("SELECT * FROM kept_sites"),
    "impute_median": sql("SELECT site_id, feature, round(value, 6) AS value, is_imputed FROM filled"),
    "standard_scale": sql("""
SELECT site_id, feature,
       round((value - avg(value) OVER w) /
             (CASE WHEN stddev_pop(value) OVER w > 1e-12 THEN stddev_pop(value) OVER w ELSE 1 END), 6) + 0.0 AS value
FROM filled WINDOW w AS (PARTITION BY feature)"""),
    "embed_2d": sql(
        "SELECT site_id, round(list_dot_product(z, axis_1.v), 4) + 0.0 AS umap_x, "
        "round(list_dot_product(z, axis_2.v), 4) + 0.0 AS umap_y FROM scaled_rows, axis_1, axis_2",
        AXES,
    ),
    "feature_model": sql("""
SELECT CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS position, feature,
       round(m, 6) AS median, round(a, 6) AS mean, round(s, 6) AS std
FROM (SELECT g.feature, median(g.value) AS m, avg(f.value) AS a, stddev_pop(f.value) AS s
      FROM grid g JOIN filled f USING (site_id, feature) GROUP BY g.feature)"""),
    "typology_join": sql("""
SELECT site_id, region, least(wfd_type, lower(wfd_type)) AS wfd_type FROM fx_sites"""),
    "data_period": sql("""
SELECT CAST(min(sample_dt) AS DATE) AS period_start, CAST(max(sample_dt) AS DATE) AS period_end FROM cleaned"""),
    "union_by_name": sql("""
SELECT CAST(incident_id AS VARCHAR) AS incident_id, water_impact, round(lat, 6) AS lat,
       CAST(NULL AS INTEGER) AS reporting_year FROM fx_incidents
UNION ALL SELECT permit_ref, NULL, NULL, reporting_year FROM fx_overflows"""),
}
