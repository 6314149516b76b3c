"""Raw measurement files."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sitewatch import constants as C
from sitewatch.operators.feed import union_by_name


HEADER_THREADS = 32


class NoInput(FileNotFoundError):
    """Nothing to read."""


def _list_files(spark: SparkSession, directory: str) -> list[str]:
    """File paths of a directory, through the file system Spark uses."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(path))


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names of one CSV file, from its first line.

    Every column is read as text, which keeps codes such as "0076" intact.
    """
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine()
    finally:
        stream.close()
    return tuple(next(csv.reader([(line or "").removeprefix("\ufeff")]), ()))


def _headers(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by header. Only first lines are read, many files at a time and without a job."""
    by_header: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        for path, header in zip(paths, pool.map(lambda p: _header(spark, p), paths), strict=True):
            if header:
                by_header.setdefault(header, []).append(path)
    return by_header


def read_observations(spark: SparkSession, directory: str) -> DataFrame:
    """All CSV and parquet files of a directory, united by column name.

    Files named ``obs_area-<id>_<year>.csv`` add ``area_id`` and ``source_year``;
    years on the skip list are left out before anything is read.
    """
    files = _list_files(spark, directory)
    skipped = "|".join(str(y) for y in C.SKIPPED_SOURCE_YEARS)
    texts = [f for f in files if f.endswith(".csv") and not _is_skipped(f, skipped)]
    parquet = [f for f in files if f.endswith(".parquet")]
    frames: list[DataFrame] = []
    for header, paths in _headers(spark, texts).items():  # one scan per distinct header
        schema = StructType([StructField(name, StringType()) for name in header])
        name = F.col("_metadata.file_name")
        frame = spark.read.option("header", True).schema(schema).csv(paths)
        frames.append(
            frame.select(
                *[F.col(f"`{c}`") for c in header],
                F.regexp_extract(name, C.RAW_FILE_PATTERN, 1).try_cast("int").alias("area_id"),
                F.regexp_extract(name, C.RAW_FILE_PATTERN, 2).try_cast("int").alias("source_year"),
            )
        )
    if parquet:  # one scan; columns that a file lacks are null
        frames.append(spark.read.option("mergeSchema", True).parquet(*parquet))
    if not frames:
        raise NoInput(f"no usable CSV or parquet files in {directory}")
    return reduce(union_by_name, frames)


def _is_skipped(path: str, years: str) -> bool:
    import re

    return re.search(rf"(?i)obs_area-\d+_({years})\.csv$", path) is not None


def read_lookup(spark: SparkSession, candidates: list[str]) -> DataFrame | None:
    """The first typology lookup that exists, CSV or parquet; None without one."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for candidate in candidates:
        path = jvm.org.apache.hadoop.fs.Path(candidate)
        if path.getFileSystem(conf).exists(path):
            if candidate.endswith(".parquet"):
                return spark.read.parquet(candidate)
            return spark.read.option("header", True).csv(candidate)
    return None


def lookup_candidates(processed: str, raw: str) -> list[str]:
    """Where a lookup may lie, in order of preference."""
    return [
        f"{base}/site_wfd_typology_lookup.{kind}" for base in (processed, raw) for kind in ("parquet", "csv")
    ]
