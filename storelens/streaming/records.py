"""Records kept up to date batch by batch: the audit log and current tables.

Both are laid out so that a batch touches its own part only: an audit batch reads one
small table of counters, and a batch of versions rewrites the key-hash buckets that its keys
fall into.  A batch that is tried again gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.operators.records import latest_records, sequence_within
from storelens.streaming.tables import exists, write_batch

#: Buckets of a current table, fixed when it is begun; its files hold about 1/BUCKETS of the keys each.
BUCKETS = 256


def _children(spark: SparkSession, path: str, key: str) -> list[int]:
    """Values of the partition folders ``key=value`` right below ``path``."""
    if not exists(spark, path):
        return []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    names = [f.getPath().getName() for f in found if f.isDirectory()]
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith(f"{key}="))


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


# --- audit log -------------------------------------------------------------------

def append_audit(spark: SparkSession, path: str, actions: DataFrame, batch_id: int) -> None:
    """Appends ``actions`` to the log below ``path``, numbered on from each store's last number.

    Within the batch a store's rows are numbered by (created_at, id).  Only the newest
    counters from before this batch are read: one row per store.  The rows are
    written before the counters that count them.
    """
    log, counters = f"{path}/log", f"{path}/counters"
    before = [b for b in _children(spark, counters, "batch_id") if b < batch_id]
    known = spark.read.parquet(f"{counters}/batch_id={before[-1]}") if before else spark.createDataFrame([], "store_id string, last long")
    numbered = sequence_within(actions, "store_id", ["created_at", "id"])
    last = F.coalesce(F.col("last"), F.lit(0))
    rows = numbered.join(known, "store_id", "left").withColumn("sequence", F.col("sequence") + last).drop("last")
    write_batch(rows, log, batch_id)
    added = numbered.groupBy("store_id").agg(F.max("sequence").alias("n"))
    after = known.join(added, "store_id", "full").select("store_id", (last + F.coalesce("n", F.lit(0))).alias("last"))
    write_batch(after, counters, batch_id)
    for old in before[:-1]:  # the counters that a retry of this batch reads stay
        _delete(spark, f"{counters}/batch_id={old}")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/log").drop("batch_id")


# --- current tables --------------------------------------------------------------

def _bucket(keys: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _generations(spark: SparkSession, path: str, buckets: list[int], before: int | None) -> dict[int, list[int]]:
    """Generations of each bucket, those from ``before`` on left out."""
    found = {b: _children(spark, f"{path}/bucket={b}", "batch_id") for b in buckets}
    return {b: [g for g in gs if before is None or g < before] for b, gs in found.items()}


def _newest(spark: SparkSession, path: str, generations: dict[int, list[int]], schema) -> DataFrame:
    paths = [f"{path}/bucket={b}/batch_id={gs[-1]}" for b, gs in sorted(generations.items()) if gs]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_current(spark: SparkSession, path: str, versions: DataFrame, batch_id: int, keys: tuple[str, ...] = ("id",),
                   version: str = "version", buckets: int = BUCKETS) -> list[int]:
    """Folds a batch of versions into the current table below ``path``; the buckets that it rewrote.

    A bucket's new generation is its newest one from before this batch, with the batch's
    versions: the greatest version of a key wins, ties by the other columns, so any order
    of batches gives the same table.  Tombstones stay in the table and win over older
    versions that come later.  Generations before the last two are deleted.
    """
    batch = versions.withColumn("bucket", _bucket(keys, buckets))
    # At most as many numbers as there are buckets come to the driver.
    touched = sorted(r["bucket"] for r in batch.select("bucket").distinct().collect())
    generations = _generations(spark, path, touched, batch_id)
    known = _newest(spark, path, generations, versions.schema).withColumn("bucket", _bucket(keys, buckets))
    newest = known.unionByName(batch).groupBy(*keys, "bucket").agg(
        F.max(F.struct(version, *[c for c in versions.columns if c not in (*keys, version)])).alias("r"))
    folded = newest.select(*[F.col(c) if c in keys else F.col(f"r.`{c}`").alias(c) for c in versions.columns], "bucket")
    write_batch(folded.repartition("bucket"), path, batch_id, "bucket")
    for b, gs in generations.items():
        for old in gs[:-1]:
            _delete(spark, f"{path}/bucket={b}/batch_id={old}")
    return touched


def read_newest(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest version of every key, tombstones included."""
    return _newest(spark, path, _generations(spark, path, _children(spark, path, "bucket"), None), schema)


def read_current(spark: SparkSession, path: str, schema, key: str = "id", version: str = "version", deleted: str | None = "deleted") -> DataFrame:
    """The current records, without tombstones, as ``latest_records`` gives them."""
    return latest_records(read_newest(spark, path, schema), key, version, deleted)
