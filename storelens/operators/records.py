"""Record-store semantics as append-only logs.

Upserts become "newest version per key" aggregations (``max`` over a struct led
by the version: partial aggregation, no window over a hot key); deletes are
tombstones.  Ordered per-store sequences are assigned with a range-partitioned
ordinal so one huge store is split across many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.session import cut_lineage


def latest_records(log: DataFrame, key: str = "id", version: str = "version", deleted: str | None = "deleted") -> DataFrame:
    """Newest version of every record (INSERT OR REPLACE semantics); tombstones drop it.

    ``created_at`` falls back to ``occurred_at`` then ``generated_at`` when present.
    """
    cols = [c for c in log.columns if c not in (key, version)]
    created = [c for c in ("created_at", "occurred_at", "generated_at") if c in log.columns]
    newest = log.groupBy(key).agg(F.max(F.struct(F.col(version).alias("_v"), *[F.col(c) for c in cols])).alias("_r"))
    out = newest.select(key, F.col("_r._v").alias(version), *[F.col(f"_r.{c}").alias(c) for c in cols])
    if created:
        out = out.withColumn("created_at", F.coalesce(*[F.col(c).cast("string") for c in created]))
    if deleted and deleted in log.columns:
        out = out.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)
    return out


def latest_settings(log: DataFrame, keys: tuple[str, ...] = ("store_id", "key"), version: str = "version") -> DataFrame:
    """Upsert by (store, key): value of the greatest version."""
    return log.groupBy(*keys).agg(F.max(F.struct(F.col(version).alias("v"), F.col("value").alias("value")))
                                  .alias("_r")).select(*keys, F.col("_r.value").alias("value"),
                                                       F.col("_r.v").alias(version))


def sequence_within(df: DataFrame, key: str, order: list[str], out: str = "sequence",
                    num_partitions: int | None = None, checkpoint: bool = True) -> DataFrame:
    """Gapless 1-based sequence per ``key`` ordered by ``order`` (ties must be broken by it).

    Range-partition on (key, order) so a hot key spans many partitions; inside a
    sorted partition ``monotonically_increasing_id`` is consecutive, so the local
    rank is ``mid - first_mid``; per-(partition, key) counts (a table of at most
    #partitions + #keys rows) give each partition's offset.  The staged rows are
    checkpointed to the shared checkpoint folder so recomputation after an
    executor loss cannot re-draw the range boundaries.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    staged = (df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
              .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    if checkpoint:
        staged = cut_lineage(staged)
    counts = staged.groupBy("_pid", key).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    j = staged.join(counts.select("_pid", key, "_first", "_offset"), ["_pid", key])
    return j.withColumn(out, (F.col("_offset") + F.col("_mid") - F.col("_first") + 1).cast("bigint")).drop(
        "_pid", "_mid", "_first", "_offset")


def audit_log(actions: DataFrame, checkpoint: bool = True) -> DataFrame:
    """Append-only audit rows with a gapless per-store sequence by (created_at, id)."""
    return sequence_within(actions, "store_id", ["created_at", "id"], "sequence", checkpoint=checkpoint)


def recent_top_n(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """Newest ``n`` rows per group: a per-group limit Spark applies before the
    shuffle (WindowGroupLimit)."""
    if n < 1:
        raise ValueError(f"n must be at least 1, not {n}")
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def dedupe_ordered(df: DataFrame, value: str, position: str, case_insensitive: bool = True) -> DataFrame:
    """Order-preserving distinct: first (by position) occurrence of each non-blank value."""
    k = F.lower(F.col(value)) if case_insensitive else F.col(value)
    v = df.where(F.col(value).isNotNull() & (F.col(value) != ""))
    return v.groupBy(k.alias("_k")).agg(F.min(F.struct(F.col(position).alias("position"), F.col(value).alias("value")))
                                        .alias("_r")).select("_r.position", "_r.value")
