"""Registered record-store, ordering and dedupe queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from storelens.functions.scalar import iso_text
from storelens.operators import records as rec
from storelens.plans.queries import register
from storelens.session import ensure_checkpoint_dir
from storelens.sources.tables import table
from storelens.streaming import records as kept


def fx_versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("id"),
        F.concat(F.lit("store_"), (F.col("o_custkey") % 10).cast("string")).alias("store_id"),
        F.lit("customer_profile").alias("kind"),
        F.col("o_orderkey").alias("version"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total"),
        (F.col("o_orderstatus") == "P").alias("deleted"),
    )


@register("latest_records")
def q_latest_records(spark, sf_dir):
    return rec.latest_records(fx_versions(spark, sf_dir))


def fx_settings(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select(F.concat(F.lit("store_"), (F.col("user_id") % 4).cast("string")).alias("store_id"),
                    F.col("event_type").alias("key"), F.col("props").alias("value"), F.col("event_id").alias("version"))


@register("latest_settings")
def q_latest_settings(spark, sf_dir):
    return rec.latest_settings(fx_settings(spark, sf_dir))


def fx_audit(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("store_"), (F.col("user_id") % 4).cast("string")).alias("store_id"),
        F.concat(F.lit("aud_"), F.col("event_id").cast("string")).alias("id"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("actor"),
        F.concat(F.lit("evd_"), F.col("event_id").cast("string")).alias("target"),
        F.col("props").alias("detail"),
        iso_text("ts").alias("created_at"),
    )


@register("audit_log")
def q_audit_log(spark, sf_dir):
    return rec.audit_log(fx_audit(spark, sf_dir))


def _run_dir(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), "records", name, uuid.uuid4().hex)


@register("audit_log_append")
def q_audit_log_append(spark, sf_dir):
    """The log appended in four batches, one of them tried twice."""
    path, actions = _run_dir(spark, "audit"), fx_audit(spark, sf_dir)
    cuts = ["2024-01-08", "2024-01-15", "2024-01-22"]
    for batch, (lo, hi) in enumerate(zip(["", *cuts], [*cuts, "9999"])):
        for _ in range(2 if batch == 1 else 1):
            kept.append_audit(spark, path, actions.where((F.col("created_at") >= lo) & (F.col("created_at") < hi)), batch)
    return kept.read_audit(spark, path)


#: Buckets of the queries' current tables, which are small.
QUERY_BUCKETS = 16


def _dealt(versions, n=3):
    """Versions dealt to batches by hash, so that older ones come after newer ones."""
    slot = F.pmod(F.xxhash64(*versions.columns), F.lit(n))
    return [versions.where(slot == k) for k in range(n)]


@register("current_records")
def q_current_records(spark, sf_dir):
    """The current table kept by batches in any order."""
    path, versions = _run_dir(spark, "current"), fx_versions(spark, sf_dir)
    for batch, part in enumerate(_dealt(versions)):
        kept.upsert_current(spark, path, part, batch, buckets=QUERY_BUCKETS)
    return kept.read_current(spark, path, versions.schema)


@register("current_settings")
def q_current_settings(spark, sf_dir):
    path, versions = _run_dir(spark, "settings"), fx_settings(spark, sf_dir)
    for batch, part in enumerate(_dealt(versions)):
        kept.upsert_current(spark, path, part, batch, ("store_id", "key"), buckets=QUERY_BUCKETS)
    return kept.read_newest(spark, path, versions.schema).select("store_id", "key", "value", "version")


@register("recent_top_n")
def q_recent_top_n(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    top = rec.recent_top_n(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 3)
    return top.select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "rank")


@register("dedupe_ordered")
def q_dedupe_ordered(spark, sf_dir):
    return rec.dedupe_ordered(table(spark, sf_dir, "part"), "p_type", "p_partkey")
