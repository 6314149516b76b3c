"""Whitening of embeddings with a distributed BlockMatrix.

Components become whole numbers ``floor(256 * c)``. The distinct vectors (the fit list) are
centred and packed into blocks of ``BLOCK_ROWS`` rows of a ``BlockMatrix``; the transpose
times the matrix is the scatter, whose eigenvectors are found locally (its side is the
dimension of the vectors, whatever their number). The matrix of all rows times the
whitening matrix gives the projections.

Each task packs the rows it reads and fills its last block with zero rows, so that making
blocks needs no shuffle; a zero row adds nothing to the scatter, and no result is read from
it. Blocks are written as a table (and so survive lost executors) before MLlib reads them.

Defined results: rows whose vector is null or holds null, NaN or infinite entries are left
out. Shorter vectors count as filled with zeros up to the longest one. Entries beyond the
range of 64-bit integers become its ends. Equal vectors count once in the fit; every row
is returned, repeated rows and rows without an id too. Components are numbered by falling
eigenvalue; equal eigenvalues leave their order and directions to the solver, but it is one
choice for all rows. The sign makes the entry of largest size positive. There are as many
components as dimensions at most. A component of vanishing variance (below 1e-12 of the
trace) has no scale: ``whitened`` is null. ``deviation`` is null where it exceeds 64 bits.
Empty tables, and tables without a usable vector or with empty vectors only, give no rows.
Other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sitewatch.llm.common import own_names
from sitewatch.operators.checkpoints import cut

SCALE = 256
BLOCK_ROWS = 1024
#: Blocks that one task of the scatter product takes.
BLOCKS_PER_SPLIT = 16
#: Eigenvalues below this share of the trace count as vanishing.
VANISHING = 1e-12

#: How MLlib stores a dense matrix (type 1), column by column.
MATRIX = T.StructType(
    [
        T.StructField("type", T.ByteType(), False),
        T.StructField("numRows", T.IntegerType(), False),
        T.StructField("numCols", T.IntegerType(), False),
        T.StructField("colPtrs", T.ArrayType(T.IntegerType(), False), True),
        T.StructField("rowIndices", T.ArrayType(T.IntegerType(), False), True),
        T.StructField("values", T.ArrayType(T.DoubleType(), False), True),
        T.StructField("isTransposed", T.BooleanType(), False),
    ]
)
INDEX = T.StructType([T.StructField("_1", T.IntegerType(), False), T.StructField("_2", T.IntegerType(), False)])


@dataclass(frozen=True)
class Whitening:
    """What the fit finds: everything has the size of the dimension."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    matrix: np.ndarray  # dimension x components, scaled by 1 / sqrt(eigenvalue)
    explained: list[float]
    identity_error: float


def integer_rows(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, x``: rows with finite vectors as arrays of long."""
    entries = own_names(df, id_column, vector).select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("c")
    )
    finite = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return entries.where(F.col("c").isNotNull() & finite).select("id", F.transform("c", lambda c: F.floor(c * SCALE)).alias("x"))


def _filled(rows: DataFrame, dimension: int) -> DataFrame:
    """All vectors with ``dimension`` entries."""
    missing = F.array_repeat(F.lit(0).cast("long"), dimension - F.size("x"))
    return rows.withColumn("x", F.when(F.size("x") < dimension, F.concat("x", missing)).otherwise(F.col("x")))


def _matrix_of(table: pa.Table, dimension: int) -> np.ndarray:
    return table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _sums(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of every dimension; tasks send one row a batch."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix_of(pa.Table.from_batches([batch]), dimension)
            wide = x.size and np.abs(x.astype(np.float64)).max() * len(x) >= 2.0**62
            sums = [str(sum(map(int, column))) for column in x.T] if wide else [str(s) for s in x.sum(axis=0)]
            yield pa.RecordBatch.from_pydict(
                {"k": pa.array(range(-1, dimension), pa.int32()), "s": pa.array([str(len(x)), *sums], pa.string())}
            )

    partial = fit.mapInArrow(add, "k int, s string")
    total = partial.groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found = {row["k"]: int(row["s"]) for row in total}
    return found.get(-1, 0), [found.get(k, 0) for k in range(dimension)]


def _block_offsets(rows: DataFrame) -> dict[int, int]:
    """First block number of every task that reads the written table ``rows``."""
    counts = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, used = {}, 0
    for row in sorted(counts, key=lambda r: r["task"]):
        offsets[row["task"]] = used
        used += -(-row["n"] // BLOCK_ROWS)
    return offsets


def _packed(rows: DataFrame, dimension: int, n: int, sums: list[int]) -> DataFrame:
    """Written blocks of centred rows, ``number, matrix``.

    If the rows have an ``id``, the blocks carry their ``ids`` and exact ``deviations``.
    """
    mean = np.array([s / n for s in sums])
    squares = sum(s * s for s in sums)
    with_ids = "id" in rows.columns
    offsets = _block_offsets(rows)
    out = T.StructType().add("number", T.IntegerType()).add("matrix", MATRIX)
    if with_ids:
        out = out.add("ids", T.ArrayType(rows.schema["id"].dataType)).add("deviations", T.ArrayType(T.LongType()))
    schema = to_arrow_schema(out)

    def block(x: np.ndarray) -> dict:
        held = np.zeros((BLOCK_ROWS, dimension))
        held[: len(x)] = x - mean
        return {
            "type": 1, "numRows": BLOCK_ROWS, "numCols": dimension, "colPtrs": None, "rowIndices": None,
            "values": held.ravel(order="F"), "isTransposed": False,
        }

    def deviations(x: np.ndarray) -> list[int | None]:
        size = float(np.abs(x.astype(np.float64)).max(initial=0)) * n + max(map(abs, sums), default=0)
        if size * size * dimension < 2.0**62:
            return (((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1)).tolist()
        exact = [n * n * sum(int(v) ** 2 for v in row) - 2 * n * sum(int(v) * s for v, s in zip(row, sums)) + squares for row in x]
        return [d if d < 2**63 else None for d in exact]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = offsets.get(TaskContext.get().partitionId(), 0)
        held = None

        def emit(table: pa.Table) -> pa.RecordBatch:
            x = _matrix_of(table, dimension)
            row = {"number": number, "matrix": block(x)}
            if with_ids:
                row |= {"ids": table.column("id").to_pylist(), "deviations": deviations(x)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            while held.num_rows >= BLOCK_ROWS:
                yield emit(held.slice(0, BLOCK_ROWS))
                held, number = held.slice(BLOCK_ROWS), number + 1
        if held is not None and held.num_rows:
            yield emit(held)

    return cut(rows.mapInArrow(pack, out), "whitening_blocks")


def _block_matrix(blocks: DataFrame, dimension: int) -> BlockMatrix:
    """The written blocks as MLlib's matrix; the table is read again with the matrix type."""
    schema = T.StructType().add("number", T.IntegerType()).add("matrix", MatrixUDT())
    read = blocks.sparkSession.read.schema(schema).parquet(*blocks.inputFiles())
    indexed = read.select(F.struct(F.col("number").cast("long").alias("_1"), F.lit(0).cast("long").alias("_2")).alias("_1"), F.col("matrix").alias("_2"))
    rows = (blocks.agg(F.max("number")).first()[0] + 1) * BLOCK_ROWS
    java = callMLlibFunc("createBlockMatrix", indexed, BLOCK_ROWS, dimension, rows, dimension)
    return BlockMatrix(java, BLOCK_ROWS, dimension)


def _scatter(matrix: BlockMatrix, n_blocks: int) -> np.ndarray:
    """Transpose times matrix. The middle dimension is split over tasks, whose sums are added."""
    splits = max(1, -(-n_blocks // BLOCKS_PER_SPLIT))
    java = matrix._java_matrix_wrapper._java_model
    product = java.transpose().multiply(java, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _times(matrix: BlockMatrix, local: np.ndarray) -> BlockMatrix:
    """Matrix times a small local one, which is one block of a matrix of its own."""
    one = matrix._java_matrix_wrapper._sc.parallelize([((0, 0), DenseMatrix(*local.shape, local.ravel(order="F")))], 1)
    small = BlockMatrix(one, *local.shape)
    # Not multiply() of the wrapper, which would call the product's blocks as wide as the matrix's.
    product = matrix._java_matrix_wrapper._java_model.multiply(small._java_matrix_wrapper._java_model)
    return BlockMatrix(product, BLOCK_ROWS, local.shape[1])


def _written_blocks(matrix: BlockMatrix, name: str) -> DataFrame:
    """``number, values`` of every block: the table is read again without the matrix type."""
    written = cut(callMLlibFunc("getMatrixBlocks", matrix._java_matrix_wrapper._java_model), name)
    plain = T.StructType().add("_1", INDEX).add("_2", MATRIX)
    read = written.sparkSession.read.schema(plain).parquet(*written.inputFiles())
    return read.select(F.col("_1._1").alias("number"), F.col("_2.values").alias("values"))


def _directions(scatter: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues and unit eigenvectors of the covariance, largest first, and its trace."""
    covariance = (scatter + scatter.T) / (2.0 * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return np.maximum(values, 0.0), vectors * np.where(largest < 0, -1.0, 1.0), float(np.trace(covariance))


def fit_whitening(rows: DataFrame, dimension: int, components: int) -> Whitening | None:
    """Fit on the distinct vectors of ``rows`` (``id, x``); None if there are none."""
    fit = cut(rows.select("x").distinct(), "whitening_fit")
    n, sums = _sums(fit, dimension)
    if n == 0:
        return None
    blocks = _packed(fit, dimension, n, sums)
    matrix = _block_matrix(blocks, dimension)
    n_blocks = blocks.count()
    values, vectors, trace = _directions(_scatter(matrix, n_blocks), n, components)
    usable = values > VANISHING * trace
    whitening = vectors * np.where(usable, 1.0 / np.sqrt(np.where(usable, values, 1.0)), np.nan)
    error = float("nan")
    if usable.any():
        error = _identity_error(matrix, np.where(usable, whitening, 0.0), n, n_blocks)
    explained = [float(v / trace) if trace > 0 else 0.0 for v in values]
    return Whitening(n, sums, values, whitening, explained, error)


def _identity_error(matrix: BlockMatrix, whitening: np.ndarray, n: int, n_blocks: int) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity.

    The whitened rows are made and multiplied as the rows themselves were. Their means are
    products of the means of the centred rows, which vanish, so they are centred already;
    zero rows stay zero.
    """
    covariance = _scatter(_times(matrix, whitening), n_blocks) / n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whitened_rows(df: DataFrame, components: int = 4, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row and component: id, ``component, n, deviation, whitened, explained, identity_error``."""
    id_type = own_names(df, id_column).schema[id_column].dataType
    rows = integer_rows(df, id_column, vector)
    rows = rows.withColumn("id", F.col("id").cast("long" if isinstance(id_type, T.LongType) else "string"))
    rows = cut(rows, "whitening_rows")
    dimension = rows.agg(F.max(F.size("x"))).first()[0] or 0
    model = fit_whitening(_filled(rows, dimension).select("x"), dimension, min(components, dimension)) if dimension else None
    schema = T.StructType().add(id_column, id_type).add("component", T.IntegerType()).add("n", T.LongType()).add("deviation", T.LongType())
    schema = schema.add("whitened", T.DoubleType()).add("explained", T.DoubleType()).add("identity_error", T.DoubleType())
    if model is None:
        return df.sparkSession.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    blocks = _packed(_filled(rows, dimension), dimension, model.n, model.sums)
    width = len(model.explained)
    usable = np.nan_to_num(model.matrix)
    projected = _written_blocks(_times(_block_matrix(blocks, dimension), usable), "whitening_projected")
    members = F.posexplode(F.arrays_zip("ids", "deviations")).alias("place", "member")
    own = blocks.select("number", "ids", "deviations").join(projected, "number").select("values", members)
    parts = [
        F.struct(
            F.lit(k + 1).alias("component"),
            (F.col("values")[F.col("place") + k * BLOCK_ROWS] if np.isfinite(model.matrix[:, k]).all() else F.lit(None).cast("double")).alias("whitened"),
            F.lit(model.explained[k]).alias("explained"),
        )
        for k in range(width)
    ]
    long = own.select("member", F.explode(F.array(*parts)).alias("part"))
    return long.select(
        F.col("member.ids").cast(id_type).alias(id_column),
        F.col("part.component"),
        F.lit(model.n).cast("long").alias("n"),
        F.col("member.deviations").alias("deviation"),
        F.col("part.whitened"),
        F.col("part.explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
