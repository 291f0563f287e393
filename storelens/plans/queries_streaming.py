"""Registered streaming queries: run the stream over files derived from the
driver tables (trigger availableNow) and return its output table."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from storelens.functions.scalar import iso_text
from storelens.plans.operations import report_steps
from storelens.plans.queries import CYCLE_NOW, _items, register
from storelens.session import ensure_checkpoint_dir, freed_shuffles, table_options
from storelens.sources import fixtures as fx
from storelens.sources.tables import table
from storelens.streaming import correlation as corr
from storelens.streaming import health, ingest

#: Times at which the fixtures' items and evidence are cut into consecutive batches.
ITEM_CUTS = ("1997-01-01", "1999-01-01")
EVIDENCE_CUTS = ("2024-01-08", "2024-01-15", "2024-01-22")
LATE_CONNECTOR = "late_feed"
HEARTBEAT_POLL_SECONDS = 1800


def _run_dir(spark, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name, uuid.uuid4().hex)


def _write_split(df, path: str, cut_col: str, cuts, parts: int = 2) -> None:
    """Write ``df`` as consecutive appends ordered by ``cut_col`` (one write per slice)."""
    bounds = [None, *cuts, None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = df
        if lo is not None:
            part = part.where(F.col(cut_col) >= lo)
        if hi is not None:
            part = part.where(F.col(cut_col) < hi)
        with freed_shuffles(df.sparkSession):
            part.repartition(parts).write.mode("append").options(**table_options(df.sparkSession)).parquet(path)


def _item_stream(spark, items, run: str):
    # The files are this run's own copy; those of a batch that is done are not needed again.
    _write_split(items, os.path.join(run, "input"), "occurred_at", ITEM_CUTS)
    return spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 2).option("cleanSource", "delete").parquet(os.path.join(run, "input"))


@register("stream_operational_cycle")
def q_stream_operational_cycle(spark, sf_dir):
    run = _run_dir(spark, "operational")
    source = _item_stream(spark, _items(spark, sf_dir), run)
    ingest.operational_stream(spark, source, os.path.join(run, "state"), CYCLE_NOW).awaitTermination()
    return spark.read.parquet(os.path.join(run, "state", "tasks")).drop("batch_id", "answer")


@register("stream_prime_ledger")
def q_stream_prime_ledger(spark, sf_dir):
    """Ids remembered and imported per connector; one connector joins with the second batch."""
    run = _run_dir(spark, "primed")
    items = _items(spark, sf_dir)
    joining = items.where((F.col("occurred_at") >= ITEM_CUTS[0]) & (F.substring("store_id", 7, 1).cast("int") < 5))
    both = items.unionByName(joining.withColumn("connector", F.lit(LATE_CONNECTOR)))
    state = os.path.join(run, "state")
    ingest.operational_stream(spark, _item_stream(spark, both, run), state, CYCLE_NOW, backfill=False).awaitTermination()
    count = lambda name, connector: spark.read.parquet(os.path.join(state, name)).groupBy(
        "store_id", F.col(connector).alias("connector")).agg(F.count("*").alias(name))
    return count("baseline", "connector").join(count("evidence", "source"), ["store_id", "connector"], "full").select(
        "store_id", "connector", F.coalesce("baseline", F.lit(0)).alias("primed"), F.coalesce("evidence", F.lit(0)).alias("imported"))


@register("stream_cycle_health")
def q_stream_cycle_health(spark, sf_dir):
    """One row per batch for each store and for the fleet; a step of the third batch fails."""
    run = _run_dir(spark, "cycle_health")
    state = os.path.join(run, "state")

    def audit(made):
        if made["evidence"].where(F.col("occurred_at") >= ITEM_CUTS[1]).count():
            raise ConnectionError("the archive is down")
        return made["evidence"].select("id", "store_id")

    source = _item_stream(spark, _items(spark, sf_dir), run)
    ingest.operational_stream(spark, source, state, CYCLE_NOW, steps=report_steps() | {"archive": audit}).awaitTermination()
    return spark.read.parquet(os.path.join(state, "health")).drop("batch_id")


@register("stream_correlation")
def q_stream_correlation(spark, sf_dir):
    """Batches are dealt by id, not by time, so most rows come late."""
    run = _run_dir(spark, "correlation")
    ev = fx.fx_evidence(spark, sf_dir)
    slot = F.pmod(F.xxhash64("id"), F.lit(3))
    for k in range(3):
        ev.where(slot == k).repartition(2).write.mode("append").parquet(os.path.join(run, "input"))
    source = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 2).parquet(os.path.join(run, "input"))
    state = os.path.join(run, "state")
    corr.stream_correlation(spark, source, state, 15).awaitTermination()
    return corr.correlated(spark, state)


def run_interval(spark, sf_dir) -> str:
    """The interval form over evidence in order of time, but for every 40th row, which comes last; its state folder."""
    run = _run_dir(spark, "interval")
    ev = fx.fx_evidence(spark, sf_dir)
    late = F.substring("id", 5, 20).cast("bigint") % 40 == 7
    path = os.path.join(run, "input")
    _write_split(ev.where(~late), path, "occurred_at", EVIDENCE_CUTS)
    ev.where(late).repartition(2).write.mode("append").parquet(path)
    source = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 2).parquet(path)
    state = os.path.join(run, "state")
    corr.place_stream(spark, source, state).awaitTermination()
    corr.interval_stream(spark, state).awaitTermination()
    return state


@register("stream_interval_correlation")
def q_stream_interval_correlation(spark, sf_dir):
    """Every record with a readable time and its nearest observation, if it has one."""
    return corr.interval_correlated(spark, run_interval(spark, sf_dir)).drop("settled_by")


def fx_heartbeats(spark, sf_dir):
    """A heartbeat per store and time of an event; 20 stores."""
    ev = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "error").otherwise(F.lit("Running"))
    beats = ev.select(
        F.concat(F.lit("store_"), (F.col("user_id") % 20).cast("string")).alias("store_id"), iso_text("ts").alias("updated_at"), status.alias("status"),
        F.when(F.col("event_type") == "signup", F.lit(None)).otherwise(F.lit("running")).alias("camera_status"), F.lit("running").alias("sql_status"))
    return beats.dropDuplicates(["store_id", "updated_at"])


@register("stream_collector_health")
def q_stream_collector_health(spark, sf_dir):
    """Every change of a collector's state, staleness included, by the heartbeats' own time."""
    run = _run_dir(spark, "heartbeats")
    beats = fx_heartbeats(spark, sf_dir)
    _write_split(beats, os.path.join(run, "input"), "updated_at", EVIDENCE_CUTS)
    source = spark.readStream.schema(beats.schema).option("maxFilesPerTrigger", 2).parquet(os.path.join(run, "input"))
    changes = health.watch_heartbeats(source, HEARTBEAT_POLL_SECONDS, "0 seconds")
    out = os.path.join(run, "changes")
    changes.writeStream.format("parquet").outputMode("append").option("path", out).option(
        "checkpointLocation", os.path.join(run, "_checkpoint")).trigger(availableNow=True).start().awaitTermination()
    made = spark.read.schema(health.TRANSITION).parquet(out)
    return made.select("store_id", F.unix_millis("at").alias("at_ms"), "state", "collector_status", "camera_status", "sql_status")
