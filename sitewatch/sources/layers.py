"""Parquet layers between jobs and archived snapshots of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def write_layer(df: DataFrame, root: str, name: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write one layer and return its path."""
    path = f"{root}/{name}"
    writer = df.write.mode("overwrite")
    if partition_by:
        # Rows of one value come together, so there are few files; large values are split.
        writer = df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by)
    writer.parquet(path)
    return path


def read_layer(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def has_layer(spark: SparkSession, root: str, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def snapshot_run(df: DataFrame, archive: str, name: str, run_id: str) -> str:
    """Archive an artefact under its run; an existing run is never overwritten."""
    path = f"{archive}/{name}/run_id={run_id}"
    df.write.mode("errorifexists").parquet(path)
    return path


def latest_snapshot(spark: SparkSession, archive: str, name: str) -> DataFrame | None:
    """Newest archived run that holds the artefact; None where there is none.

    The newest run comes from directory names; only its files are read.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{archive}/{name}")
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    runs = sorted(
        s.getPath().getName() for s in fs.listStatus(hadoop) if s.getPath().getName().startswith("run_id=")
    )
    if not runs:
        return None
    newest = runs[-1]
    table = spark.read.parquet(f"{archive}/{name}/{newest}")
    return table.withColumn("run_id", F.lit(newest.removeprefix("run_id=")))


# --- versions: what readers see changes at one moment -------------------------------------


def _file_context(spark: SparkSession, path: str):
    """Hadoop's view of the file system of ``path`` and a function that makes paths."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    uri = hadoop.Path(path).toUri()
    named = uri.getScheme() is not None
    return hadoop.FileContext.getFileContext(uri, conf) if named else hadoop.FileContext.getFileContext(conf), hadoop.Path


def new_version(root: str) -> str:
    """A folder below ``root`` that no reader looks into yet."""
    return f"{root}/versions/{uuid.uuid4().hex}"


def publish_version(spark: SparkSession, root: str, version: str) -> str:
    """Make a completely written version the current one.

    The name is written to a file beside the pointer, which then takes the pointer's place in
    one rename: readers see the old version or the new one, never half of either.
    """
    context, path = _file_context(spark, root)
    jvm = spark.sparkContext._jvm
    beside = path(f"{root}/.{POINTER}-{uuid.uuid4().hex}")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    gateway = spark.sparkContext._gateway
    options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$CreateOpts"), 0)
    out = context.create(beside, flags, options)
    try:
        out.write(version.rsplit("/", 1)[-1].encode())
    finally:
        out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context.rename(beside, path(f"{root}/{POINTER}"), how)
    return version


def current_version(spark: SparkSession, root: str) -> str | None:
    """Folder of the current version; None where nothing was published."""
    context, path = _file_context(spark, root)
    pointer = path(f"{root}/{POINTER}")
    if not context.util().exists(pointer):
        return None
    stream = context.open(pointer)
    try:
        name = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
    return f"{root}/versions/{name}"
