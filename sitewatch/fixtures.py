"""Proxy tables: the monitoring data model read off the generic test tables.

One SQL text per view serves Spark and DuckDB alike. A customer plays a site, a line
item a measurement, an order an incident, a part a permit, a nation a water body.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings",
)

VIEWS = {
    "fx_sites": """
SELECT concat('S', CAST(c_custkey AS STRING)) AS site_id,
       c_name AS site_label, n_name AS region,
       CAST(50 AS DOUBLE) + (c_custkey * 7919 % 5000) / CAST(1000 AS DOUBLE) AS lat,
       CAST(-5 AS DOUBLE) + (c_custkey * 104729 % 6000) / CAST(1000 AS DOUBLE) AS lon,
       CASE WHEN c_custkey % 17 = 0 THEN NULL
            ELSE concat(c_mktsegment, ', ', n_name) END AS wfd_type
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "fx_obs_raw": """
SELECT concat('S', CAST(o_custkey AS STRING)) AS site_id,
       concat('000', CAST(l_linenumber AS STRING)) AS determinand_code,
       CASE l_linenumber WHEN 1 THEN 'Temperature of Water' WHEN 2 THEN 'pH'
            WHEN 3 THEN 'Nitrate as N' WHEN 4 THEN 'Ionic Balance'
            WHEN 5 THEN 'Equiv. Carbon No >5-40'
            WHEN 6 THEN 'Orthophosphate, reactive as P'
            ELSE 'Conductivity at 25 C' END AS determinant,
       CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'Coded Result'
            WHEN l_linenumber = 3 AND l_suppkey % 4 = 0 THEN 'ug/l' ELSE 'mg/l' END AS unit,
       CASE WHEN l_linestatus = 'F' AND l_suppkey % 10 = 0 THEN 'SEA WATER'
            ELSE 'RIVER / RUNNING SURFACE WATER' END AS sample_material,
       CASE WHEN l_partkey % 50 = 0 THEN 'ND'
            WHEN l_partkey % 7 = 0 THEN concat('<', CAST(l_quantity AS STRING))
            WHEN l_partkey % 11 = 0 THEN concat(' ', CAST(l_quantity AS STRING), ' ')
            ELSE CAST(l_quantity AS STRING) END AS result_raw,
       l_shipdate AS sample_datetime
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "fx_incidents": """
SELECT o_orderkey AS incident_id, CAST(o_orderdate AS DATE) AS incident_date,
       CASE o_orderstatus WHEN 'F' THEN 'Category 1 (Major)'
            WHEN 'O' THEN 'Category 3 (Minor)' ELSE 'Category 4 (No Impact)' END AS water_impact,
       o_orderpriority AS pollutant_type,
       CAST(50 AS DOUBLE) + (o_orderkey * 15485863 % 5000) / CAST(1000 AS DOUBLE) AS lat,
       CAST(-5 AS DOUBLE) + (o_orderkey * 32452843 % 6000) / CAST(1000 AS DOUBLE) AS lon,
       CAST(o_orderkey * 6151 % 700000 AS DOUBLE) AS easting,
       CAST(o_orderkey * 7717 % 650000 AS DOUBLE) AS northing
FROM {orders}""",
    "fx_incident_reports": """
SELECT o_orderkey AS incident_id,
       CASE o_orderstatus WHEN 'F' THEN 'Category 1 (Major)'
            WHEN 'O' THEN 'Category 3 (Minor)' ELSE 'Category 4 (No Impact)' END AS water_impact,
       CASE WHEN o_orderkey % 11 = 0 THEN 'in spring'
            ELSE concat(substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2), '/',
              substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2), '/',
              substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4), ' 13:45:10') END AS incident_time,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS STRING)
            WHEN o_orderkey % 3 = 1 THEN concat('SU ', CAST(100 + o_orderkey * 37 % 900 AS STRING), ' ',
              CAST(100 + o_orderkey * 53 % 900 AS STRING)) ELSE 'ZZ 12' END AS grid_ref,
       CASE WHEN o_orderkey % 5 = 0 THEN 'unknown'
            ELSE CAST(400000 + o_orderkey * 6151 % 2 * 1000 AS STRING) END AS easting,
       CAST(200000 + o_orderkey * 7717 % 2 * 1000 AS DOUBLE) AS northing
FROM {orders}""",
    "fx_pollutants": """
SELECT l_orderkey AS incident_id, l_linenumber AS ord, p_type AS poll_type, p_name AS pollutant
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "fx_overflows": """
SELECT CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE concat('U', CAST(l_suppkey AS STRING)) END AS unique_id,
       concat('P', CAST(l_suppkey AS STRING)) AS permit_ref,
       concat('SU ', CAST(100 + l_suppkey * 37 % 900 AS STRING), ' ',
              CAST(100 + l_linenumber * 53 % 900 AS STRING)) AS outlet_ngr,
       concat('Company ', CAST(l_suppkey % 7 AS STRING)) AS water_company,
       YEAR(l_shipdate) AS reporting_year,
       CASE WHEN l_partkey % 13 = 0 THEN 'n/a' WHEN l_partkey % 29 = 0 THEN '0'
            ELSE CAST(l_quantity AS STRING) END AS spill_count,
       CASE l_linenumber WHEN 1 THEN '26:30:00' WHEN 2 THEN '1899-12-31 05:15:00'
            WHEN 3 THEN 'unknown' ELSE CAST(l_quantity AS STRING) END AS total_duration,
       CAST(50 AS DOUBLE) + (l_orderkey * 49979687 % 5000) / CAST(1000 AS DOUBLE) AS lat,
       CAST(-5 AS DOUBLE) + (l_orderkey * 86028121 % 6000) / CAST(1000 AS DOUBLE) AS lon
FROM {lineitem}""",
    "fx_discharges": """
SELECT concat('D', CAST(p_partkey AS STRING)) AS permit_number, p_name AS discharge_site_name,
       CASE p_size % 5 WHEN 0 THEN 'SA' WHEN 1 THEN 'SB' WHEN 2 THEN 'TA' WHEN 3 THEN 'UC' ELSE 'XX' END AS effluent_type,
       CASE WHEN p_size % 11 = 0 THEN CAST(NULL AS STRING)
            ELSE concat(CASE p_size % 4 WHEN 0 THEN 'SU' WHEN 1 THEN 'TQ' WHEN 2 THEN 'NZ' ELSE 'ZZ' END, ' ',
              CAST(100 + p_partkey * 37 % 900 AS STRING), ' ',
              CAST(100 + p_partkey * 53 % 900 AS STRING)) END AS effluent_grid_ref,
       concat('sp ', CAST(10 + p_partkey * 7 % 90 AS STRING), CAST(10 + p_partkey * 3 % 90 AS STRING)) AS discharge_ngr
FROM {part}""",
    "fx_tiles": """
SELECT concat('W', CAST(n_nationkey AS STRING)) AS water_body_id, n_name AS water_body_name,
       CASE n_nationkey % 5 WHEN 0 THEN 'Not assessed' WHEN 1 THEN 'Good'
            WHEN 2 THEN 'Moderate' WHEN 3 THEN 'Poor' ELSE NULL END AS ecological_class,
       CASE n_nationkey % 3 WHEN 0 THEN 'Does not require assessment' WHEN 1 THEN 'Fail'
            ELSE 'Good' END AS chemical_class,
       CASE n_nationkey % 4 WHEN 0 THEN 'Not assessed' ELSE 'Moderate' END AS overall_water_body_class,
       CAST(50 + n_nationkey % 5 AS DOUBLE) AS lat0,
       CAST(50 + n_nationkey % 5 AS DOUBLE) + CAST(0.9 AS DOUBLE) AS lat1,
       CAST(-5 AS DOUBLE) + CAST(1.2 AS DOUBLE) * CAST(floor(n_nationkey / 5) AS DOUBLE) AS lon0,
       CAST(-4 AS DOUBLE) + CAST(1.2 AS DOUBLE) * CAST(floor(n_nationkey / 5) AS DOUBLE) AS lon1
FROM {nation}""",
    "fx_events_obs": """
SELECT concat('U', CAST(user_id AS STRING)) AS site_id, event_type AS feature, value, ts AS sample_dt
FROM {events}""",
}

VECTORS_SPARK = """
SELECT CAST(vec_id AS STRING) AS site_id,
       CASE WHEN label = 0 THEN NULL ELSE concat('T', CAST(label AS STRING)) END AS wfd_type,
       transform(embedding, v -> CAST(v AS DOUBLE)) AS vector,
       CAST(embedding[0] AS DOUBLE) AS x, CAST(embedding[1] AS DOUBLE) AS y FROM {embeddings}"""

VECTORS_DUCKDB = """
SELECT CAST(vec_id AS STRING) AS site_id,
       CASE WHEN label = 0 THEN NULL ELSE concat('T', CAST(label AS STRING)) END AS wfd_type,
       CAST(embedding AS DOUBLE[]) AS vector,
       CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM {embeddings}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A proxy table as a lazy DataFrame over the parquet files."""
    text = VECTORS_SPARK if name == "fx_vectors" else VIEWS[name]
    return spark.sql(text.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def duckdb_views() -> dict[str, str]:
    """The same texts over plain table names."""
    plain = {t: t for t in TABLES}
    texts = {name: text.format(**plain).strip() for name, text in VIEWS.items()}
    return texts | {"fx_vectors": VECTORS_DUCKDB.format(**plain).strip()}


def with_views(ctes: dict[str, str], body: str) -> str:
    """SQL text that starts with just the common table expressions it needs."""
    known = duckdb_views() | ctes
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(known[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    head = ",\n".join(f"{n} AS (\n{known[n]}\n)" for n in needed)
    return f"WITH {head}\n{body}" if head else body
