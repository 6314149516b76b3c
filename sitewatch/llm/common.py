"""Small helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2_000_000  # text that one step in a Python worker holds at once
BATCH_BYTES = 8_000_000  # of an Arrow batch, which the executor and its Python worker both hold
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def own_names(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; extra columns, whatever they are called, stay outside."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for row, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(size) + 1
    if start < batch.num_rows:
        yield batch.slice(start)


def map_arrow(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` over batches of about ``BATCH_BYTES``, one row at least.

    Spark reads the limit from the session when the rows are computed, so it is set there
    and stays; a session that names a limit of its own keeps that.
    """
    conf = df.sparkSession.conf
    if BATCH_SETTING not in conf.getAll:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def map_chunks(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text"
) -> DataFrame:
    """``function`` over every chunk of every Arrow batch; nothing is kept between chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                yield function(part)

    return df.mapInArrow(run, schema)


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as the struct ``row``, beside the given columns; no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])
