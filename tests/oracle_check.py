"""Run registered queries against their SQL in DuckDB and compare the rows.

Usage: python tests/oracle_check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sitewatch-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def canon(value) -> str:
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(row[i]) for i in order) for row in rows)


def compare(spark, con, query, oracle: str, sf_dir: str) -> str | None:
    """None when equal, else a description of the difference."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    result = con.execute(oracle)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        only_got = [g for g in got if g not in set(want)][:3]
        only_want = [w for w in want if w not in set(got)][:3]
        return f"{len(got)} rows vs {len(want)}\n    spark  {only_got}\n    duckdb {only_want}"
    return None if got else "EMPTY"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        del argv[at : at + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv or list(queries)
    spark, con = session(), duck(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, queries[name], oracles[name], sf_dir)
            else:
                n = queries[name](spark, sf_dir).count()
                problem = None if n else "EMPTY"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        took = time.time() - start
        label = "ok  " if problem is None else "FAIL"
        if name not in oracles:
            label += " (rows only)"
        print(f"{label} {name} {took:.1f}s" + (f"\n    {problem}" if problem else ""), flush=True)
        failed += problem is not None
    print(f"{len(names) - failed}/{len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
