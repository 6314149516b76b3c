"""Release checks over the proxies, with thresholds scaled to them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitewatch.catalog.base import clean_layer, sql
from sitewatch.catalog.feed import CTES as FEED_CTES
from sitewatch.catalog.feed import _feed, _previous, scored
from sitewatch.config import GateSettings
from sitewatch.fixtures import view
from sitewatch.operators import gates
from sitewatch.operators.checkpoints import checkpoint_root
from sitewatch.sources.feed import read_feed_lines

AS_OF = 2002
SETTINGS = GateSettings(
    first_run_rows=20_000,
    min_site_count=1_000,
    value_ranges={"pH": (0.0, 14.0), "Nitrate as N": (0.0, 100.0), "Oxygen": (0.0, 500.0)},
    known_bad_sites=("S1", "S2", "S3", "no such site"),
    known_clean_sites=("S4", "S5", "no such site"),
    known_bad_max_rank=500,
    known_clean_min_rank=700,
    min_skewness=0.2,
    flagged_range=(10, 100),
    min_summary_length=120,
    size_mb_range=(0.1, 15.0),
    lat_bounds=(50.0, 54.9),
    lon_bounds=(-5.0, 0.9),
)
SHOWN = ("gate", "check", "passed", "message")


def _with_region(spark, sf):
    regions = view(spark, sf, "fx_sites").select("site_id", "region", "lat", "lon")
    gap = F.when(F.substring("site_id", -1, 1) != "7", F.col("lat"))
    return clean_layer(spark, sf).join(regions, "site_id").withColumn("lat", gap)


def _over_clean(gate):
    return lambda spark, sf: gate(clean_layer(spark, sf)).select(*SHOWN)


def _over_scored(gate):
    return lambda spark, sf: gate(scored(spark, sf)[0]).select(*SHOWN)


def _over_feed(gate):
    return lambda spark, sf: gate(_feed(spark, sf)).select(*SHOWN)


def gate_rank_stability(spark, sf):
    table, _ = scored(spark, sf)
    return gates.gate_rank_stability(table, _previous(table), SETTINGS).select(*SHOWN)


def release_diff(spark, sf):
    table, _ = scored(spark, sf)
    return gates.release_diff(table, _previous(table)).select(*SHOWN)


def gate_schema(spark, sf):
    damaged = _feed(spark, sf).withColumn(
        "summary", F.when(F.col("anomaly_rank") % 3 != 0, F.col("summary"))
    )
    return gates.gate_schema(damaged).select(*SHOWN)


def _damaged_feed(spark, sf):
    """Sites as one file of JSON lines, some cut off, some without a site, some blank."""
    folder = f"{checkpoint_root(spark)}/sitewatch/files-{uuid.uuid4().hex}"
    sites = view(spark, sf, "fx_sites").select("site_id", "lat", "lon")
    whole = F.to_json(F.struct("site_id", "lat", "lon"))
    text = (
        F.when(F.col("site_id").endswith("13"), F.substring(whole, 1, 20))
        .when(F.col("site_id").endswith("77"), F.to_json(F.struct("lat", "lon")))
        .when(F.col("site_id").endswith("99"), F.lit(""))
        .otherwise(whole)
    )
    sites.coalesce(1).sortWithinPartitions("site_id").select(text.alias("value")).write.text(f"{folder}/feed")
    return folder


def gate_readable(spark, sf):
    return gates.gate_readable(spark, _damaged_feed(spark, sf)).select(*SHOWN)


def damaged_lines(spark, sf):
    """Which lines of a feed cannot be read."""
    return read_feed_lines(spark, _damaged_feed(spark, sf)).where("not readable").select("line", "site_id")


def _gate_1(spark, sf):
    obs = _with_region(spark, sf)
    measured = gates.measure_observations(obs, ("0001", "0004", "0007"), SETTINGS)
    return measured, gates.checks_of_observations(measured, obs.columns, AS_OF, None, SETTINGS)


def gate_metadata(spark, sf):
    measured, _ = _gate_1(spark, sf)
    return gates.gate_metadata(measured).select(
        "row_count", "site_count", F.array_join("determinand_codes", ",").alias("codes"),
        F.date_format("date_min", "yyyy-MM-dd").alias("date_min"), F.date_format("date_max", "yyyy-MM-dd").alias("date_max"),
        F.array_join("regions", ",").alias("regions"),
    )


def run_gates(spark, sf):
    """Checks of all three gates evaluated together; what is returned is the written report."""
    _, data = _gate_1(spark, sf)
    table, _ = scored(spark, sf)
    told = _feed(spark, sf)
    checks = data.unionByName(gates.gate_known_bad(table, SETTINGS)).unionByName(gates.gate_known_clean(table, SETTINGS))
    for check in (gates.gate_rank_stability(table, _previous(table), SETTINGS), gates.gate_flag_band(table, SETTINGS)):
        checks = checks.unionByName(check)
    for check in (gates.gate_narratives(told, SETTINGS), gates.gate_coordinates(told, SETTINGS), gates.gate_rank_continuity(told)):
        checks = checks.unionByName(check)
    report = f"{checkpoint_root(spark)}/sitewatch/files-{uuid.uuid4().hex}"
    gates.run_gates(checks, report, halt=False)
    return spark.read.schema(gates.CHECK_SCHEMA).json(report).select(*SHOWN)


QUERIES = {
    "gate_readable": gate_readable,
    "damaged_lines": damaged_lines,
    "gate_metadata": gate_metadata,
    "run_gates": run_gates,
    "gate_row_count": _over_clean(lambda df: gates.gate_row_count(df, None, SETTINGS)),
    "gate_row_count_previous": _over_clean(lambda df: gates.gate_row_count(df, 40_000, SETTINGS)),
    "gate_site_count": _over_clean(lambda df: gates.gate_site_count(df, SETTINGS)),
    "gate_determinands": _over_clean(lambda df: gates.gate_determinands(df, ("0001", "0004", "0007"))),
    "gate_determinands_normalised": _over_clean(
        lambda df: gates.gate_determinands(df, ("1", "2", "7"), normalise=True)
    ),
    "gate_null_rates": lambda spark, sf: gates.gate_null_rates(_with_region(spark, sf), SETTINGS).select(*SHOWN),
    "gate_value_ranges": _over_clean(lambda df: gates.gate_value_ranges(df, SETTINGS)),
    "gate_temporal": _over_clean(lambda df: gates.gate_temporal(df, AS_OF, SETTINGS)),
    "gate_regions": lambda spark, sf: gates.gate_regions(_with_region(spark, sf), SETTINGS).select(*SHOWN),
    "gate_known_bad": _over_scored(lambda df: gates.gate_known_bad(df, SETTINGS)),
    "gate_known_clean": _over_scored(lambda df: gates.gate_known_clean(df, SETTINGS)),
    "gate_rank_stability": gate_rank_stability,
    "gate_score_skew": _over_scored(lambda df: gates.gate_score_skew(df, SETTINGS)),
    "gate_flag_band": _over_scored(lambda df: gates.gate_flag_band(df, SETTINGS)),
    "gate_drivers": _over_scored(lambda df: gates.gate_drivers(df, 200)),
    "gate_peer_coverage": _over_scored(lambda df: gates.gate_peer_coverage(df, SETTINGS)),
    "gate_schema": gate_schema,
    "gate_narratives": _over_feed(lambda df: gates.gate_narratives(df, SETTINGS)),
    "gate_coordinates": _over_feed(lambda df: gates.gate_coordinates(df, SETTINGS)),
    "gate_rank_continuity": _over_feed(gates.gate_rank_continuity),
    "gate_output_size": lambda spark, sf: gates.gate_output_size(
        scored(spark, sf)[0].select("site_id", "anomaly_rank", "is_flagged", "region"), SETTINGS
    ).select(*SHOWN),
    "release_diff": release_diff,
}


def _row(gate: str, check: str, passed: str, message: str, source: str) -> str:
    return sql(
        f"SELECT '{gate}' AS gate, '{check}' AS \"check\", {passed} AS passed, {message} AS message FROM ({source})",
        FEED_CTES,
    )


def _either(good: str, test: str, bad: str) -> str:
    return f"CASE WHEN {test} THEN '{good}' ELSE {bad} END"


_DATA, _RANK, _OUT = "data_sanity", "ranking_quality", "output_quality"
_LISTED = (
    "SELECT count(*) FILTER ({test}) AS n FROM (VALUES {values}) AS t(site_id) LEFT JOIN site_scores USING (site_id)"
)

ORACLES = {
    "gate_row_count": _row(
        _DATA, "row_count", "n >= 20000", "concat(format('{:,}', n), ' rows; first run needs 20,000')",
        "SELECT count(*) AS n FROM cleaned",
    ),
    "gate_row_count_previous": _row(
        _DATA, "row_count", "n BETWEEN 34000 AND 46000",
        "concat(format('{:,}', n), ' rows; expected 34,000 to 46,000')", "SELECT count(*) AS n FROM cleaned",
    ),
    "gate_site_count": _row(
        _DATA, "site_count", "n >= 1000", "concat(format('{:,}', n), ' sites; at least 1,000 needed')",
        "SELECT count(DISTINCT site_id) AS n FROM cleaned",
    ),
    "gate_determinands": _row(
        _DATA, "determinands", "m IS NULL",
        _either("All panel determinands present", "m IS NULL", "concat('Missing codes: ', m)"),
        "SELECT string_agg(code, ', ' ORDER BY code) AS m FROM (VALUES ('0001'), ('0004'), ('0007')) AS t(code) "
        "WHERE code NOT IN (SELECT determinand_code FROM cleaned)",
    ),
    "gate_determinands_normalised": _row(
        _DATA, "determinands", "m IS NULL",
        _either("All panel determinands present", "m IS NULL", "concat('Missing codes: ', m)"),
        "SELECT string_agg(code, ', ' ORDER BY code) AS m FROM (VALUES ('1'), ('2'), ('7')) AS t(code) "
        "WHERE code NOT IN (SELECT ltrim(determinand_code, '0') FROM cleaned)",
    ),
    "gate_null_rates": _row(
        _DATA, "null_rates", "rate <= 0.05",
        _either("Null rates are low", "rate <= 0.05", "'Columns above threshold: lat'"),
        "SELECT avg(CASE WHEN site_id LIKE '%7' THEN 1 ELSE 0 END) AS rate FROM cleaned JOIN fx_sites USING (site_id)",
    ),
    "gate_value_ranges": _row(
        _DATA, "value_ranges", "m = ''",
        _either("Values are inside their ranges", "m = ''", "concat('Range failures: ', m)"),
        """SELECT concat_ws(', ', CASE WHEN count(*) FILTER (determinant = 'pH') = 0
             OR count(*) FILTER (determinant = 'pH' AND (value < 0 OR value > 14)) > 0 THEN 'pH' END,
           CASE WHEN count(*) FILTER (determinant = 'Nitrate as N') = 0
             OR count(*) FILTER (determinant = 'Nitrate as N' AND (value < 0 OR value > 100)) > 0 THEN 'Nitrate as N' END,
           CASE WHEN count(*) FILTER (determinant = 'Oxygen') = 0 THEN 'Oxygen' END,
           CASE WHEN count(*) FILTER (value < 0) > 0 THEN 'non_negative_values' END) AS m FROM cleaned""",
    ),
    "gate_temporal": _row(
        _DATA, "temporal", "n >= 5 AND 2002 - latest <= 2",
        "concat(n, ' distinct years; latest is ', latest)",
        "SELECT count(DISTINCT year) AS n, max(year) AS latest FROM cleaned",
    ),
    "gate_regions": _row(
        _DATA, "regions", "n >= 5", "concat(n, ' regions; at least 5 needed')",
        "SELECT count(DISTINCT region) AS n FROM cleaned JOIN fx_sites USING (site_id)",
    ),
    "gate_known_bad": _row(
        _RANK, "known_bad", "n = 0",
        _either("Known-bad sites rank high", "n = 0", "concat(n, ' known-bad sites are not in the top 500')"),
        _LISTED.format(
            test="anomaly_rank IS NULL OR anomaly_rank > 500", values="('S1'), ('S2'), ('S3'), ('no such site')"
        ),
    ),
    "gate_known_clean": _row(
        _RANK, "known_clean", "n = 0",
        _either("Known-clean sites rank low", "n = 0", "concat(n, ' known-clean sites are in the top 700')"),
        _LISTED.format(test="anomaly_rank <= 700", values="('S4'), ('S5'), ('no such site')"),
    ),
    "gate_rank_stability": _row(
        _RANK, "rank_stability", "rho >= 0.85",
        "concat('Rank correlation ', printf('%.3f', rho), ' over ', n, ' sites')",
        """SELECT corr(o, w) AS rho, count(*) AS n FROM (
             SELECT rank() OVER (ORDER BY old_rank) + (count(*) OVER (PARTITION BY old_rank) - 1) / 2.0 AS o,
                    rank() OVER (ORDER BY new_rank) + (count(*) OVER (PARTITION BY new_rank) - 1) / 2.0 AS w FROM history)""",
    ),
    "gate_score_skew": _row(
        _RANK, "score_skew", "s > 0.2", "concat('Score skewness is ', printf('%.3f', s))",
        "SELECT skewness(anomaly_score) AS s FROM site_scores",
    ),
    "gate_flag_band": _row(
        _RANK, "flag_band", "n BETWEEN 10 AND 100", "concat(n, ' flagged sites; expected 10 to 100')",
        "SELECT count(*) FILTER (is_flagged) AS n FROM site_scores",
    ),
    "gate_drivers": _row(
        _RANK, "drivers", "n = 0",
        _either("The top 200 sites have drivers", "n = 0", "concat(n, ' of the top 200 sites lack drivers')"),
        "SELECT count(*) FILTER (trim(anomaly_drivers) = '') AS n FROM "
        "(SELECT * FROM site_scores ORDER BY anomaly_rank, site_id LIMIT 200)",
    ),
    "gate_peer_coverage": _row(
        _RANK, "peer_coverage", "share <= 0.1",
        "concat(printf('%.1f', share * 100), '% of sites used the global fallback')",
        "SELECT avg(CASE WHEN regexp_matches(lower(score_reference), 'global|fallback') THEN 1 ELSE 0 END) AS share FROM site_scores",
    ),
    "gate_schema": _row(
        _OUT, "schema", "n = 0",
        _either("All entries are complete", "n = 0", "concat(n, ' entries lack required fields')"),
        "SELECT count(*) FILTER (is_flagged AND anomaly_rank % 3 = 0) AS n FROM told",
    ),
    "gate_narratives": _row(
        _OUT, "narratives", "n = 0",
        _either("Flagged sites are fully narrated", "n = 0", "concat(n, ' flagged sites have weak summaries')"),
        "SELECT count(*) FILTER (is_flagged AND (length(trim(summary)) <= 120 OR trim(summary) LIKE '%...')) AS n FROM told",
    ),
    "gate_coordinates": _row(
        _OUT, "coordinates", "n = 0",
        _either("Coordinates are in bounds", "n = 0", "concat(n, ' entries lie outside the bounds')"),
        "SELECT count(*) FILTER (NOT (lat BETWEEN 50 AND 54.9 AND lon BETWEEN -5 AND 0.9)) AS n FROM site_scores",
    ),
    "gate_rank_continuity": _row(
        _OUT, "rank_continuity", "ok",
        _either("Ranks run from 1 to N", "ok", "'Ranks have gaps, duplicates or no value'"),
        "SELECT count(*) = count(DISTINCT anomaly_rank) AND min(anomaly_rank) = 1 AND max(anomaly_rank) = count(*) AS ok FROM site_scores",
    ),
    "gate_output_size": _row(
        _OUT, "output_size", "mb BETWEEN 0.1 AND 15",
        "concat('Output is ', printf('%.2f', mb), ' MB; expected 0.1 to 15.0')",
        "SELECT sum(strlen(CAST(to_json({'site_id': site_id, 'anomaly_rank': anomaly_rank, 'is_flagged': is_flagged, "
        "'region': region}) AS VARCHAR)) + 1) / 1048576.0 AS mb FROM site_scores",
    ),
    "release_diff": _row(
        _OUT, "release_diff", "true", "concat(entered, ' entered and ', exited, ' left the top 50')",
        """SELECT (SELECT count(*) FROM site_scores WHERE anomaly_rank <= 50
                   AND site_id NOT IN (SELECT site_id FROM previous WHERE old_rank <= 50)) AS entered,
                  (SELECT count(*) FROM previous WHERE old_rank <= 50
                   AND site_id NOT IN (SELECT site_id FROM site_scores WHERE anomaly_rank <= 50)) AS exited""",
    ),
}

_DAMAGED = """
SELECT site_id, row_number() OVER (ORDER BY site_id) AS line, right(site_id, 2) AS tail FROM fx_sites"""
ORACLES |= {
    "gate_readable": _row(
        _OUT, "readable", "bad = 0", "concat(n, ' entries, ', bad, ' unreadable')",
        f"SELECT count(*) FILTER (tail <> '99') AS n, count(*) FILTER (tail IN ('13', '77')) AS bad FROM ({_DAMAGED})",
    ),
    "damaged_lines": sql(f"SELECT line, CAST(NULL AS VARCHAR) AS site_id FROM ({_DAMAGED}) WHERE tail IN ('13', '77')"),
    "gate_metadata": sql("""
SELECT count(*) AS row_count, count(DISTINCT site_id) AS site_count,
       string_agg(DISTINCT determinand_code, ',' ORDER BY determinand_code) AS codes,
       strftime(min(sample_dt), '%Y-%m-%d') AS date_min, strftime(max(sample_dt), '%Y-%m-%d') AS date_max,
       string_agg(DISTINCT region, ',' ORDER BY region) AS regions
FROM cleaned JOIN fx_sites USING (site_id)""", FEED_CTES),
    "run_gates": " UNION ALL ".join(
        f"SELECT * FROM ({ORACLES[name]})"
        for name in (
            "gate_row_count", "gate_site_count", "gate_determinands", "gate_null_rates", "gate_value_ranges", "gate_temporal",
            "gate_regions", "gate_known_bad", "gate_known_clean", "gate_rank_stability", "gate_flag_band", "gate_narratives",
            "gate_coordinates", "gate_rank_continuity",
        )
    ),
}
