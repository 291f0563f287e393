"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.session import ensure_checkpoint_dir, ship_package
from storelens.sources.tables import table as scan

#: Documents without an id sort after every other document.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of one input table."""
    return scan(spark, sf_dir, name).select(*columns)


#: Scratch folders of this process, oldest first.
_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder of the session."""
    _MADE.append(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def scratch_mark() -> int:
    """A point in the order of scratch folders, for ``discard``."""
    return len(_MADE)


def discard(spark: SparkSession, since: int, until: int) -> None:
    """Deletes the scratch folders made between two marks; nothing may read them any more."""
    for folder in _MADE[since:until]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage: a lost executor costs tasks of the readers, never another
    run of what led here, and rows made with sampled range bounds stay as drawn.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, function: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` of a function that may use this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, max_rows: int, name: str) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows stay within ``max_rows``.

    Above the bound the plain table is returned and joins with it shuffle.
    """
    kept = written(df, name)
    return F.broadcast(kept) if kept.limit(max_rows + 1).count() <= max_rows else kept


def hash_sample(key: Column, share: float) -> Column:
    """True for about ``share`` of the keys, however small that is; for all of them where it is 1."""
    return F.shiftrightunsigned(F.xxhash64(key), 1) <= F.lit(int(share * (2**63 - 1)) if share < 1 else 2**63 - 1)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_or_last(column: str = "doc_id") -> Column:
    """The id, nulls as the largest long."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def packed(docs: DataFrame, carry: Sequence[str], text: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.Array]]:
    """``carry`` as one struct column ``row``, and a function that gives a batch's texts.

    A struct keeps names of carried columns apart from what an operator adds.  The
    text follows as a second column only if it isn't carried.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    if text in carry:
        at = list(carry).index(text)
        return docs.select(row), lambda batch: batch.column(0).field(at)
    return docs.select(row, F.col(f"`{text}`").alias("text")), lambda batch: batch.column(1)


def finite_vector(column: str, largest: float) -> Column:
    """The vector is there, and no entry of it is null, not finite or of a size above ``largest``."""
    # A NaN is larger than every other number in Spark.
    return F.col(column).isNotNull() & F.forall(column, lambda c: F.coalesce(F.abs(c.cast("double")) <= largest, F.lit(False)))


def common_length(rows: DataFrame, column: str) -> int:
    """The most frequent length of an array column, the longest of equally frequent ones; 0 without rows."""
    best = rows.groupBy(F.size(column).alias("size")).count().agg(F.max(F.struct("count", "size")).alias("best")).first()["best"]
    return best["size"] if best else 0
