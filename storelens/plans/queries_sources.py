"""Registered source / scan queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from storelens.functions.scalar import iso_text
from storelens.operators import payload
from storelens.operators.ingest import facts_to_events, normalize_evidence
from storelens.operators.workflows import evaluate_workflows
from storelens.plans.queries import register
from storelens.session import ensure_checkpoint_dir
from storelens.sources import collector_fixture as cfx
from storelens.sources import collectors as col
from storelens.sources.collector_source import FORMAT, register_collector_source
from storelens.sources.tables import table


@register("scan_camera_events")
def q_scan_camera_events(spark, sf_dir):
    return col.scan_camera_events(cfx.fx_camera_tables(spark, sf_dir))


@register("scan_verified_labels")
def q_scan_verified_labels(spark, sf_dir):
    return col.scan_verified_labels(cfx.fx_verified_labels(spark, sf_dir))


@register("scan_system_facts")
def q_scan_system_facts(spark, sf_dir):
    return col.scan_system_facts(cfx.fx_sql_facts(spark, sf_dir))


@register("scan_newest")
def q_scan_newest(spark, sf_dir):
    """The bounded poll: the 100 newest camera events per store and table."""
    return col.newest(q_scan_camera_events(spark, sf_dir), 100, per=("store_id", "source_table"))


@register("camera_registry")
def q_camera_registry(spark, sf_dir):
    return col.camera_registry(cfx.fx_camera_configs(spark, sf_dir))


@register("detect_event_tables")
def q_detect_event_tables(spark, sf_dir):
    from storelens.sources.catalog_fixture import fx_catalog

    return col.detect_event_tables(fx_catalog(spark, sf_dir))


@register("merge_ordered")
def q_merge_ordered(spark, sf_dir):
    keep = ["store_id", "external_id", "occurred_at", "kind", "confidence"]
    return col.merge_ordered(
        q_scan_camera_events(spark, sf_dir).select(*keep),
        q_scan_verified_labels(spark, sf_dir).select(*keep),
        q_scan_system_facts(spark, sf_dir).select(*keep),
    )


def fx_collector_folder(spark, sf_dir) -> str:
    """A collector folder with a drop per store, connector and week of the ``events`` table; its path."""
    ev = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "observation").otherwise(F.lit("system_record"))
    lines = ev.select(
        F.concat(F.lit("store "), (F.col("user_id") % 4).cast("string")).alias("store_id"), F.concat(F.lit("feed_"), F.col("event_type")).alias("connector"),
        F.floor(F.dayofyear("ts") / 7).alias("seq"), F.col("event_id").cast("string").alias("external_id"), iso_text("ts").alias("occurred_at"),
        kind.alias("kind"), (F.col("value") / 100).alias("confidence"), F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.struct(F.col("event_id").alias("no")).alias("lot"), F.lit("sale_line").alias("operation_type"),
        F.concat(F.lit("SKU-"), F.col("user_id").cast("string")).alias("product_id"), F.col("value").alias("quantity"))
    path = os.path.join(ensure_checkpoint_dir(spark), "collectors", uuid.uuid4().hex)
    lines.repartition("store_id", "connector", "seq").write.partitionBy("store_id", "connector", "seq").json(path)
    return path


def _collected(items):
    extra = payload.as_variant(F.col("payload"))
    return items.select("store_id", "connector", "seq", "external_id", "occurred_at", "kind", "confidence",
                        payload.value(extra, "k", "int").alias("k"), F.try_variant_get(extra, "$.lot.no", "bigint").alias("lot_no"))


@register("collector_source")
def q_collector_source(spark, sf_dir):
    """Two stores' observations, read from collector folders: other stores' folders are not opened."""
    register_collector_source(spark)
    items = spark.read.format(FORMAT).load(fx_collector_folder(spark, sf_dir))
    return _collected(items.where(F.col("store_id").isin("store 1", "store 3") & (F.col("kind") == "observation")))


@register("collector_source_stream")
def q_collector_source_stream(spark, sf_dir):
    """The whole folder by a stream."""
    register_collector_source(spark)
    path = fx_collector_folder(spark, sf_dir)
    out = path + "-out"
    stream = spark.readStream.format(FORMAT).load(path)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", path + "-checkpoint").trigger(
        availableNow=True).start().awaitTermination()
    return _collected(spark.read.schema(stream.schema).parquet(out))


@register("payload_facts")
def q_payload_facts(spark, sf_dir):
    """Facts that only the payload has, and the keys that no fact has, after the events were made."""
    register_collector_source(spark)
    items = spark.read.format(FORMAT).load(fx_collector_folder(spark, sf_dir)).drop("seq")
    evidence, _ = normalize_evidence(items, "2026-01-01T00:00:00")
    events, _ = evaluate_workflows(facts_to_events(evidence))
    lot = F.try_variant_get("extra", "$.lot.no", "bigint")
    return events.select("id", "store_id", "event_type", "occurred_at", F.col("facts.product_id").alias("product_id"),
                         F.col("facts.quantity").alias("quantity"), lot.alias("lot_no"),
                         F.array_join(payload.unknown_keys(F.col("extra")), ",").alias("unknown_keys"))
