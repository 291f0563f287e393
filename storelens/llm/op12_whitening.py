"""Embedding whitening with MLlib's BlockMatrix.

1. Entries become integers, ``floor(SCALE * c) + OFFSET``; n and the sums S per dimension
   are taken over all vectors that take part.
2. Every task cuts its own rows into blocks of centred rows, (n * x - S) / n, where the
   numerator is exact, and writes them in the layout of MLlib's matrix type, so the
   blocks are read back as a BlockMatrix without a shuffle.
3. The scatter is the transposed matrix times the matrix, with the blocks dealt to
   as many splits as keep ``SPLIT_BLOCKS`` in one; its d x d result is small, and its
   eigenvectors are found on the driver.
4. The matrix times the whitening matrix projects the rows.  There the blocks stand in
   a square, with the whitening matrix along the diagonal of a block matrix as
   wide as the square: a single column of blocks would be dealt to the root of
   the partitions only.
5. ``identity_error`` is measured on the projected rows: one sum of outer products per
   task.  Centred rows stay centred under a projection, so nothing is subtracted again.

Cases: rows whose vector is null, or holds an entry that is null, not finite or beyond
``LARGEST``, take no part and are not in the result, nor are vectors whose length isn't
the most frequent one (of equally frequent ones the longest).  Rows with a null id or
repeated rows count and return as rows of their own.  A component without variance (its
eigenvalue within rounding of 0) has ``whitened`` 0, and isn't part of ``identity_error``.
``deviation`` is null where the exact number doesn't fit a long.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.llm.common import common_length, finite_vector, map_arrow, scratch, written

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Entries of larger size would leave no room for n in the exact numerators.
LARGEST = 2.0**24
#: Entries of one block, 2 MB of doubles.
BLOCK_VALUES = 2**18
#: Blocks that one task of a multiplication holds of either side.
SPLIT_BLOCKS = 16

_MATRIX = "struct<type:tinyint,numRows:int,numCols:int,colPtrs:array<int>,rowIndices:array<int>,values:array<double>,isTransposed:boolean>"
_ARROW_MATRIX = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())),
                           ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])


@dataclass(frozen=True)
class Whitening:
    """Blocks of centred rows, where they lie and what was fitted."""

    folder: str
    n: int
    length: int
    blocks: int
    projection: np.ndarray
    explained: tuple[float, ...]
    ranked: int


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(id, x)`` of the rows that take part: integer entries, all of one length."""
    vector = F.col(f"`{embedding}`")
    rows = vectors.select(F.col(f"`{vec_id}`").alias("id"), vector.alias("vector")).where(finite_vector("vector", LARGEST))
    length = common_length(rows, "vector")
    x = F.transform("vector", lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET))
    return rows.where(F.size("vector") == length).select("id", x.alias("x"))


def _deviation(numerators: np.ndarray) -> list[int | None]:
    """Exact sums of squares of the rows; None where a long can't hold one."""
    rough = (numerators.astype(np.float64) ** 2).sum(axis=1)
    exact = np.where(rough < 9e18, (numerators * numerators).sum(axis=1), 0).tolist()
    for i in np.flatnonzero(rough >= 9e18):
        total = sum(int(v) ** 2 for v in numerators[i])
        exact[i] = total if total < 2**63 else None
    return exact


def _blocks(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """``(part, block, ids, deviation, matrix)``: centred rows cut into blocks, numbered within their partition."""
    length = len(sums)
    size = max(1, BLOCK_VALUES // length)
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids, held, total = [], [], np.array(sums, np.int64) - n * OFFSET

        def block(arrow_id):
            nonlocal number, ids, held
            x = np.concatenate(held)
            numerators = n * (x - OFFSET) - total
            matrix = {"type": 1, "numRows": len(x), "numCols": length, "colPtrs": None, "rowIndices": None,
                      "values": (numerators / n).ravel(), "isTransposed": True}
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([ids], pa.list_(arrow_id)),
                 pa.array([_deviation(numerators)], pa.list_(pa.int64())), pa.array([matrix], _ARROW_MATRIX)],
                names=["part", "block", "ids", "deviation", "matrix"])
            number, ids, held = number + 1, [], []
            return out

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, min(size - len(ids), batch.num_rows - at))
                at += piece.num_rows
                ids += piece.column(0).to_pylist()
                held.append(piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, length))
                if len(ids) == size:
                    yield block(batch.column(0).type)
        if ids:
            yield block(batch.column(0).type)

    return map_arrow(rows, run, f"part long, block long, ids array<{id_type}>, deviation array<long>, matrix {_MATRIX}")


def _numbered(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Blocks numbered from 0 without gaps, and how many they are; the driver sees one count per partition."""
    counts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.count("*").alias("n")).collect())
    first, at = [], 0
    for part, k in counts:
        first.append((part, at))
        at += k
    offsets = blocks.sparkSession.createDataFrame(first, "part long, first long")
    return blocks.join(F.broadcast(offsets), "part").withColumn("block", F.col("block") + F.col("first")), at


def _block_matrix(spark: SparkSession, folder: str, rows_per_block: int, length: int, across: int, down: int) -> BlockMatrix:
    """The written blocks as a BlockMatrix ``across`` blocks wide: block b stands in row b // across, column b % across."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("matrix", MatrixUDT())])
    place = F.struct(F.expr(f"block div {across}").alias("_1"), (F.col("block") % across).alias("_2"))
    blocks = spark.read.schema(schema).parquet(folder).select(place.alias("_1"), F.col("matrix").alias("_2"))
    model = callMLlibFunc("createBlockMatrix", blocks, rows_per_block, length, down * rows_per_block, across * length)
    return BlockMatrix(model, rows_per_block, length)


def _scatter(matrix: BlockMatrix, blocks: int) -> np.ndarray:
    """The transposed matrix times the matrix, blocks dealt to splits of a bounded number."""
    splits = ceil(blocks / SPLIT_BLOCKS)
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``(id, x)`` rows of one length; None without rows or entries."""
    spark = rows.sparkSession
    rows = written(rows, "quantised")
    n, length = rows.count(), 0
    sums = [r["s"] for r in rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s")).orderBy("at").collect()]
    if not sums:
        return None
    length = len(sums)
    size = max(1, BLOCK_VALUES // length)
    numbered, blocks = _numbered(written(_blocks(rows, n, sums), "centred"))
    folder = scratch(spark, "blocks")
    numbered.drop("part", "first").write.parquet(folder)

    covariance = _scatter(_block_matrix(spark, folder, size, length, 1, blocks), blocks) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    k, trace = min(components, length), float(values.sum())
    ranked = int((values[:k] > trace * 1e-12).sum())
    scales = np.where(np.arange(k) < ranked, 1 / np.sqrt(np.where(values[:k] > 0, values[:k], 1.0)), 0.0)
    return Whitening(folder, n, length, blocks, vectors[:, :k] * scales, tuple((values[:k] / trace if trace else values[:k]).tolist()), ranked)


def project(spark: SparkSession, fitted: Whitening) -> DataFrame:
    """``(block, values)``: the blocks times the whitening matrix, entries column by column."""
    length, k = fitted.projection.shape
    size = max(1, BLOCK_VALUES // length)
    across = isqrt(fitted.blocks - 1) + 1
    down = ceil(fitted.blocks / across)
    matrix = _block_matrix(spark, fitted.folder, size, length, across, down)
    flat = fitted.projection.ravel(order="F").tolist()
    diagonal = spark.sparkContext.parallelize(range(across), max(across, ceil(fitted.blocks / SPLIT_BLOCKS))).map(
        lambda i: ((i, i), Matrices.dense(length, k, flat)))
    product = matrix.multiply(BlockMatrix(diagonal, length, k, across * length, across * k))
    found = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model)
    folder = scratch(spark, "projected")
    found.toDF("place", "matrix").write.parquet(folder)
    # Read back in the layout of the matrix type.
    plain = spark.read.schema(f"place struct<_1:long,_2:long>, matrix {_MATRIX}").parquet(folder)
    return plain.select((F.col("place._1") * across + F.col("place._2")).alias("block"), "matrix")


def _entries(matrix: pa.StructScalar) -> np.ndarray:
    """Rows by components of one projected block."""
    m, k = matrix["numRows"].as_py(), matrix["numCols"].as_py()
    values = matrix["values"].values.to_numpy(zero_copy_only=False)
    return values.reshape(m, k) if matrix["isTransposed"].as_py() else values.reshape(k, m).T


def identity_error(projected: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the projected rows' covariance minus the identity."""
    k = fitted.projection.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for matrix in batch.column(0):
                z = _entries(matrix)
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["products"])

    parts = map_arrow(projected.select("matrix"), run, "products array<double>")
    sums = parts.select(F.posexplode("products").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s")).orderBy("at").collect()
    covariance = np.array([r["s"] for r in sums]).reshape(k, k)[:fitted.ranked, :fitted.ranked] / fitted.n
    return float(np.abs(covariance - np.eye(fitted.ranked)).max()) if fitted.ranked else 0.0


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of every row that takes part and component."""
    spark = vectors.sparkSession
    rows = quantised(vectors, vec_id, embedding)
    id_type = rows.schema["id"].dataType.simpleString()
    out_type = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(rows, components)
    if fitted is None:
        return spark.createDataFrame([], out_type)
    projected = project(spark, fitted)
    error = identity_error(projected, fitted)
    known = spark.read.parquet(fitted.folder).select("block", "ids", "deviation")
    both = projected.join(known, "block").select("matrix", "ids", "deviation")
    n, explained = fitted.n, np.array(fitted.explained)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for matrix, ids, deviation in zip(*batch.columns):
                z = _entries(matrix)
                m, k = z.shape
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [ids.values.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                     deviation.values.take(each), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(both, run, out_type)
