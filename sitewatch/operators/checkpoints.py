"""Cutting long lineages by writing a table to shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
WAREHOUSE = "spark.sql.warehouse.dir"
_RUN: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    That is the cluster's checkpoint folder or, where the session names none, a folder
    below its warehouse. A warehouse on a local disk is accepted from a local master
    only: the executors of a cluster would each write to a disk of their own.
    """
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    warehouse = spark.conf.get(WAREHOUSE).rstrip("/")
    on_disk = warehouse.startswith(("file:", "/")) or ":" not in warehouse
    master = spark.sparkContext.master
    if on_disk and not (master == "local" or master.startswith("local[")):
        raise RuntimeError(
            f"set {SETTING} to a folder that all executors share; "
            f"{WAREHOUSE} is a local path ({warehouse}) and the master is {master}"
        )
    return f"{warehouse}/_intermediate"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables of one run go below one folder, which is removed at its end."""
    folder = f"{checkpoint_root(spark)}/sitewatch/run-{uuid.uuid4().hex}"
    _RUN.append(folder)
    try:
        yield folder
    finally:
        _RUN.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    For results that several later steps read: they are computed once, survive lost
    executors, and give the planner real sizes and a short plan.
    """
    folder = _RUN[-1] if _RUN else f"{checkpoint_root(df.sparkSession)}/sitewatch"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
