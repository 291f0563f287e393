"""Per-store operational snapshot.

A join of per-store aggregates; every input is aggregated to one row per store
before joining, so the joins are small and the store universe is the union of
stores seen in any input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.operators import evidence as ev_ops
from storelens.operators.correlate import nearest_observation, window_seconds

# Fixed attention texts.
ATTN_SETUP = ("Store setup has ", " unresolved confirmation(s).")
ATTN_UNCORROBORATED = " system record(s) have no camera observation within the configured time window."
ATTN_OPEN_WORK = "Open verification work: "


def attention_items(df: DataFrame) -> DataFrame:
    """Add ``attention`` (array<string>) from ready / unresolved / uncorroborated / open_work."""
    items = F.array(
        F.when(~F.col("ready"), F.concat(F.lit(ATTN_SETUP[0]), F.col("unresolved_questions").cast("string"), F.lit(ATTN_SETUP[1]))),
        F.when(F.col("uncorroborated_system_records") > 0,
               F.concat(F.col("uncorroborated_system_records").cast("string"), F.lit(ATTN_UNCORROBORATED))),
        F.when(F.coalesce(F.col("open_tasks_by_role"), F.lit("")) != "",
               F.concat(F.lit(ATTN_OPEN_WORK), F.col("open_tasks_by_role"), F.lit("."))),
    )
    return df.withColumn("attention", F.array_compact(items))


def operational_snapshot(
    evidence: DataFrame,
    events: DataFrame,
    tasks: DataFrame,
    readiness: DataFrame | None = None,
    window_minutes: int = 15,
) -> DataFrame:
    """One row per store: counts, correlation coverage, gap, attention and state."""
    stores = (
        evidence.select("store_id")
        .unionByName(events.select("store_id"))
        .unionByName(tasks.select("store_id"))
    )
    if readiness is not None:
        stores = stores.unionByName(readiness.select("store_id"))
    stores = stores.distinct()

    # One aggregate per (store, kind) serves the kind counts, the coverage
    # denominators and the latest-source gap: the evidence is scanned once for
    # them and once for the correlation.
    from storelens.functions.scalar import parse_timestamp, to_micros

    us = to_micros(parse_timestamp(F.col("occurred_at")))
    kinds = evidence.groupBy("store_id", F.coalesce(F.col("kind"), F.lit("unknown")).alias("kind")).agg(
        F.count(F.lit(1)).alias("count"), F.max(us).alias("latest_us"))
    per_store = kinds.groupBy("store_id").agg(
        F.sum(F.when(F.col("kind") == "system_record", F.col("count")).otherwise(0)).cast("bigint").alias("system_records"),
        F.sum(F.when(F.col("kind") == "observation", F.col("count")).otherwise(0)).cast("bigint").alias("observations"),
        F.max(F.when(F.col("kind") == "system_record", F.col("latest_us"))).alias("latest_system_us"),
        F.max(F.when(F.col("kind") == "observation", F.col("latest_us"))).alias("latest_observation_us"),
    )
    matches = nearest_observation(evidence, window_minutes)
    m = matches.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("match_count"), F.countDistinct("observation_id").alias("linked_observations"),
    ).withColumn("corroborated", F.col("match_count"))  # a record has one match
    cov = per_store.join(m, "store_id", "left").fillna(0, ["corroborated", "linked_observations", "match_count"])
    gap_us = F.abs(F.col("latest_observation_us") - F.col("latest_system_us"))
    unit = 36_000_000  # microseconds per 0.01 h; half-even on exact integers
    q = F.floor(gap_us / unit).cast("bigint")
    rem = gap_us - q * unit
    hundredths = q + F.when((rem * 2 > unit) | ((rem * 2 == unit) & (q % 2 == 1)), 1).otherwise(0)
    cov = cov.select(
        "store_id", "system_records", "observations", F.col("match_count").cast("bigint").alias("match_count"),
        F.col("corroborated").cast("bigint").alias("corroborated_system_records"),
        (F.col("system_records") - F.col("corroborated")).cast("bigint").alias("uncorroborated_system_records"),
        (F.col("observations") - F.col("linked_observations")).cast("bigint").alias("unlinked_observations"),
        (hundredths / F.lit(100.0)).alias("latest_source_gap_hours"),
    )
    ev_txt = ev_ops.counts_text(kinds, "kind", "evidence_counts")
    et_txt = ev_ops.counts_text(ev_ops.event_counts(events), "event_type", "event_counts")
    es_txt = ev_ops.counts_text(ev_ops.event_status_counts(events), "status", "event_status_counts")
    ot_txt = ev_ops.counts_text(ev_ops.open_tasks_by_role(tasks), "role", "open_tasks_by_role")

    seen = ev_ops.source_freshness(evidence)
    last = ev_ops.most_counted(seen, "source").groupBy("store_id").agg(ev_ops.listed(
        F.struct("source", "count", "kinds", "latest_at"),
        lambda x: F.concat(x["source"], F.lit("="), x["count"].cast("string"), F.lit(" ["), x["kinds"], F.lit("] "),
                           F.coalesce(x["latest_at"], F.lit("never")))).alias("last_seen_by_source"))

    snap = stores
    for part in (cov, ev_txt, et_txt, es_txt, ot_txt, last):
        snap = snap.join(part, "store_id", "left")
    if readiness is not None:
        snap = snap.join(readiness.select("store_id", "ready", "unresolved_questions"), "store_id", "left")
    else:
        snap = snap.withColumn("ready", F.lit(None).cast("boolean")).withColumn(
            "unresolved_questions", F.lit(None).cast("bigint"))
    snap = snap.withColumn("ready", F.coalesce(F.col("ready"), F.lit(False))).withColumn(
        "unresolved_questions", F.coalesce(F.col("unresolved_questions").cast("bigint"), F.lit(0).cast("bigint"))
    )
    for c in ("system_records", "observations", "match_count", "corroborated_system_records",
              "uncorroborated_system_records", "unlinked_observations"):
        snap = snap.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast("bigint")))
    for c in ("evidence_counts", "event_counts", "event_status_counts", "open_tasks_by_role", "last_seen_by_source"):
        snap = snap.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    snap = attention_items(snap)
    return snap.select(
        "store_id",
        F.when(F.size("attention") > 0, F.lit("needs_attention")).otherwise(F.lit("clear")).alias("state"),
        "ready",
        "unresolved_questions",
        "evidence_counts",
        "event_counts",
        "event_status_counts",
        "open_tasks_by_role",
        "last_seen_by_source",
        "match_count",
        "corroborated_system_records",
        "uncorroborated_system_records",
        "unlinked_observations",
        "latest_source_gap_hours",
        F.lit(window_seconds(window_minutes) // 60).alias("window_minutes"),
        F.array_join("attention", " | ").alias("attention"),
    )
