"""Shared inputs of the registered queries, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.config import FeatureSettings
from sitewatch.fixtures import view, with_views
from sitewatch.operators import cleaning, features
from sitewatch.operators.checkpoints import cut
from sitewatch.plans.fingerprint import Signatures, build_signatures
from sitewatch.operators.statistics import site_determinand_stats

PANEL = {
    "1": "Temperature of Water",
    "2": "pH",
    "3": "Nitrate as N",
    "6": "Orthophosphate, reactive as P",
    "7": "Conductivity at 25 C",
}
FEATURES = FeatureSettings(
    year_start=1996,
    year_end=2000,
    min_sites_per_determinand=100,
    min_obs_per_site_determinand=4,
    max_missing_features=1,
    panel=PANEL,
)
DIGITS = 6


def r(column: str | Column, digits: int = DIGITS) -> Column:
    """Rounded for comparison across engines; -0.0 becomes 0.0."""
    name = column if isinstance(column, str) else None
    out = F.round(F.col(column) if name else column, digits) + F.lit(0.0)
    return out.alias(name) if name else out


_LAYERS: dict[tuple[str, str, str], DataFrame] = {}


def layer(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A layer table, written at first use in a session and read by every later query.

    This is how the release job works too: each layer is written once and the next
    steps read it.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _LAYERS:
        _LAYERS[key] = cut(build(), name)
    return _LAYERS[key]


def forget_layers() -> None:
    """Make the next query write its layers anew."""
    _LAYERS.clear()
    _FEATURE_LISTS.clear()


def observations(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_observations(view(spark, sf, "fx_obs_raw"))


def clean_layer(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["site_id", "determinand_code", "determinant", "unit", "value", "sample_dt", "year"]
    return layer(spark, sf, "observations", lambda: observations(spark, sf).select(*columns))


def stats(spark: SparkSession, sf: str) -> DataFrame:
    return site_determinand_stats(clean_layer(spark, sf), FEATURES)


def stats_layer(spark: SparkSession, sf: str) -> DataFrame:
    return layer(spark, sf, "stats", lambda: stats(spark, sf))


def signatures(spark: SparkSession, sf: str) -> Signatures:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FEATURE_LISTS:
        _FEATURE_LISTS[key] = build_signatures(stats_layer(spark, sf), FEATURES)
    return _FEATURE_LISTS[key]


_FEATURE_LISTS: dict[tuple[str, str], Signatures] = {}


def imputed(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        filled = features.impute_median(signatures(spark, sf).grid)
        return filled.select("site_id", "feature", "value")

    return layer(spark, sf, "imputed", build)


# --- the same in SQL ----------------------------------------------------------------

NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def sql_number(text: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({text}), '{NUMBER}') THEN TRY_CAST(trim({text}) AS DOUBLE) END"


MATERIAL_OK = "sample_material IN ('RIVER / RUNNING SURFACE WATER', 'RIVER/RUNNING SURFACE WATER')"
DETERMINAND_OK = (
    "determinant NOT IN ('Ionic Balance', 'Equiv.Carbon No >10-35, Aliphatic Fraction', "
    "'Equiv.Carbon No >10-20, Aromatic Fraction', 'Equiv.Carbon No >5-40') "
    r"AND NOT regexp_matches(determinant, '(?i)\bionic balance\b') "
    r"AND NOT regexp_matches(determinant, '(?i)equiv\.?\s*carbon')"
)
UNIT_OK = (
    "unit NOT IN ('CEL', 'Hazen', 'JTU', 'FTU', 'Text Result', 'Coded Result', "
    "'PRESENT/NOT FOUND', 'COLOUR')"
)
RANGE_OK = "NOT (determinant = 'Temperature of Water' AND value > 45)"

_PANEL_ROWS = ", ".join(f"('{code}', '{name}')" for code, name in PANEL.items())

CTES = {
    "parsed": f"""
SELECT *, starts_with(trim(result_raw), '<') AS is_left_censored,
       CASE WHEN starts_with(trim(result_raw), '<')
            THEN ({sql_number("substr(trim(result_raw), 2)")}) * 0.5
            ELSE {sql_number("result_raw")} END AS value,
       sample_datetime AS sample_dt, year(sample_datetime) AS year
FROM fx_obs_raw""",
    "cleaned": f"""
SELECT * FROM parsed
WHERE {MATERIAL_OK} AND {DETERMINAND_OK} AND {UNIT_OK} AND coalesce({RANGE_OK}, false)
  AND value IS NOT NULL AND sample_dt IS NOT NULL AND site_id IS NOT NULL""",
    "det_stats": """
SELECT site_id, determinand_code, unit, count(*) AS n, avg(value) AS mean,
       quantile_cont(value, 0.5) AS median, stddev_samp(value) AS std,
       min(value) AS min, max(value) AS max,
       list_sort(list(value))[CAST(round(0.1 * (count(*) - 1)) AS BIGINT) + 1] AS q10,
       list_sort(list(value))[CAST(round(0.9 * (count(*) - 1)) AS BIGINT) + 1] AS q90,
       min(determinant) AS determinant, min(sample_dt) AS dt_min, max(sample_dt) AS dt_max
FROM cleaned WHERE year BETWEEN 1996 AND 2000
GROUP BY site_id, determinand_code, unit""",
    "panel": f"SELECT * FROM (VALUES {_PANEL_ROWS}) AS t(code_key, feature)",
    "selected": """
SELECT det_stats.*, panel.feature FROM det_stats JOIN panel
  ON coalesce(nullif(ltrim(trim(determinand_code), '0'), ''), trim(determinand_code)) = code_key""",
    "sig_long": """
SELECT site_id, feature, median AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id, feature ORDER BY n DESC, unit DESC) AS nth
  FROM selected WHERE median IS NOT NULL) WHERE nth = 1""",
    "kept_features": """
SELECT feature, count(*) AS n_present,
       count(*) / (SELECT count(DISTINCT site_id) FROM sig_long) AS coverage
FROM sig_long GROUP BY feature
HAVING count(*) / (SELECT count(DISTINCT site_id) FROM sig_long) >= 0.6""",
    "kept_sites": """
SELECT site_id, count(*) AS n_features_present FROM sig_long
WHERE feature IN (SELECT feature FROM kept_features) GROUP BY site_id
HAVING (SELECT count(*) FROM kept_features) - count(*) <=
       least(1, greatest((SELECT count(*) FROM kept_features) - 1, 0))""",
    "grid": """
SELECT s.site_id, f.feature, l.value
FROM kept_sites s CROSS JOIN kept_features f
LEFT JOIN sig_long l ON l.site_id = s.site_id AND l.feature = f.feature""",
    "filled": """
SELECT site_id, feature, coalesce(value, median(value) OVER (PARTITION BY feature)) AS value,
       value IS NULL AS is_imputed FROM grid""",
    "sc_sites": "SELECT * FROM fx_sites WHERE site_id IN (SELECT site_id FROM kept_sites)",
}


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    return with_views(CTES | (extra or {}), body)
