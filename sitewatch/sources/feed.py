"""The published feed as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sitewatch.sources.layers import current_version, new_version, publish_version


def write_feed(feed: DataFrame, header: DataFrame, path: str) -> str:
    """Publish the feed, its envelope and the flagged summaries together; returns the version.

    The feed is JSON lines in rank order, written by all tasks in parallel; a single
    document would have to pass through one of them. Everything goes to a new version
    below ``path``, which becomes the current one when it is complete.
    """
    spark, version = feed.sparkSession, new_version(path)
    ordered = feed.orderBy("anomaly_rank", "site_id")
    ordered.write.option("ignoreNullFields", False).json(f"{version}/feed")
    stamped = header.withColumn("generated_at", F.current_timestamp().cast("string"))
    stamped.coalesce(1).write.option("ignoreNullFields", False).json(f"{version}/header")
    if {"is_flagged", "summary"} <= set(feed.columns):
        write_flagged(feed, f"{version}/flagged")
    return publish_version(spark, path, version)


def published(spark: SparkSession, path: str) -> str:
    """Folder of the current version of a published feed, or ``path`` itself if it has none."""
    return current_version(spark, path) or path


def write_flagged(feed: DataFrame, path: str) -> None:
    """The flagged, narrated subset as JSON lines."""
    from sitewatch.operators.feed import flagged_summaries

    flagged_summaries(feed).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_feed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the feed: ``file, line, site_id, readable``; blank lines do not count.

    Lines are numbered from 1 within their file though files are read in parts: the parts'
    line counts, one row each, tell where a part begins.
    """
    read = spark.read.text(f"{published(spark, path)}/feed").select(
        "value",
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("_part"),
        F.monotonically_increasing_id().alias("_at"),
    )
    parts = read.groupBy("file", "_part").agg(F.count(F.lit(1)).alias("_lines"), F.min("_at").alias("_first"))
    before = Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0)))
    parsed = F.from_json("value", "site_id string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    lines = read.where(F.trim("value") != "").withColumn("_record", parsed).drop("value")
    return lines.join(parts.drop("_lines"), ["file", "_part"]).select(
        "file",
        (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line"),
        F.col("_record.site_id").alias("site_id"),
        (F.col("_record._corrupt").isNull() & F.col("_record.site_id").isNotNull()).alias("readable"),
    )


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """``(site_id, lat, lon)`` of a feed.

    Reads our own JSON lines, and for exchange also a single document that is a
    list of records or an object with a ``feed`` list.
    """
    if not path.endswith(".json"):
        table = spark.read.json(f"{published(spark, path)}/feed")
    else:
        table = spark.read.option("multiLine", True).json(path)
        field = next((f for f in table.schema.fields if f.name == "feed"), None)
        if field is not None and isinstance(field.dataType, ArrayType):
            table = table.select(F.inline("feed"))
    return table.select("site_id", F.col("lat").cast("double"), F.col("lon").cast("double"))
