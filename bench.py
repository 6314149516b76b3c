"""Time the headline queries end to end and print one JSON line.

Every query starts without written layers, so its time covers the whole chain from
the raw tables. One small untimed query starts the session first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "clean_observations",
    "stage_profile",
    "site_determinand_stats",
    "site_coverage",
    "impute_median",
    "peer_zscores",
    "flag_anomalies",
    "radius_join",
    "overflow_summary",
    "discharge_summary",
    "nearest_centroid_join",
    "knn_geo",
    "knn_vector",
    "peer_typology",
    "narrate",
    "gate_value_ranges",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from sitewatch.catalog import queries
    from sitewatch.catalog.base import forget_layers

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sitewatch-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    registered["filter_material"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    only = sys.argv[1:] or HEADLINES
    seconds: dict[str, float] = {}
    for name in only:
        forget_layers()
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "observations": rows,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
