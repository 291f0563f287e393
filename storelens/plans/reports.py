"""Per-store reports, artifacts and status.

Reports are one row per line (store_id, section, line_no, line) so no store's
report is ever gathered into one value; line numbers come from known positions
(field order, check order), not from a window over a store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.operators.catalog import READINESS_GROUPS

# Fixed report texts.
EXCEPTION_TITLE = "# Operational exception "
EVIDENCE_HEADER = "## Evidence references"


def exception_report(events: DataFrame) -> DataFrame:
    """One markdown text per event that needed verification (status needs_verification)."""
    e = events.where(F.col("status") == "needs_verification")
    refs = F.array_join(F.transform(F.coalesce(F.col("evidence_ids"), F.array().cast("array<string>")),
                                    lambda x: F.concat(F.lit("- `"), x, F.lit("`"))), "\n")
    text = F.concat(F.lit(EXCEPTION_TITLE), F.col("id"), F.lit("\n\n"), F.col("summary"), F.lit("\n\n"),
                    F.lit(EVIDENCE_HEADER), F.lit("\n\n"), refs, F.lit("\n"))
    return e.select("store_id", F.col("id").alias("event_id"), text.alias("text"))


def mapping_lines(mappings: DataFrame) -> DataFrame:
    """'- `field` <- `path` (verified|proposed, confidence 0.98)' per mapping."""
    mark = F.when(F.col("verified"), F.lit("verified")).otherwise(F.lit("proposed"))
    line = F.concat(F.lit("- `"), F.col("canonical_field"), F.lit("` ← `"), F.col("source_path"), F.lit("` ("),
                    mark, F.lit(", confidence "), F.format_string("%.2f", F.col("confidence").cast("double")), F.lit(")"))
    return mappings.select("store_id", F.lit("mappings").alias("section"),
                           F.coalesce(F.col("field_pos"), F.lit(99)).alias("line_no"), line.alias("line"))


def readiness_lines(mappings: DataFrame, stores: DataFrame) -> DataFrame:
    """'- [x] label - detail' per readiness check (same rule as ``readiness``)."""
    from storelens.functions.cache import with_rules
    from storelens.operators.catalog import READINESS_DDL, readiness_rows

    g = with_rules(stores.select("store_id"), readiness_rows(), READINESS_DDL).join(
        mappings.select("store_id", "canonical_field", "verified"), ["store_id", "canonical_field"], "left")
    per = g.groupBy("store_id", "check_pos", "label").agg(F.array_sort(F.collect_list(F.when(
        ~F.coalesce(F.col("verified"), F.lit(False)), F.struct("field_order", "canonical_field")))).alias("m"))
    passed = F.size("m") == 0
    detail = F.when(passed, F.lit("Verified")).otherwise(
        F.concat(F.lit("Awaiting: "), F.array_join(F.transform("m", lambda x: x["canonical_field"]), ", ")))
    line = F.concat(F.lit("- ["), F.when(passed, F.lit("x")).otherwise(F.lit(" ")), F.lit("] "), F.col("label"),
                    F.lit(" — "), detail)
    return per.select("store_id", F.lit("readiness").alias("section"), F.col("check_pos").alias("line_no"),
                      line.alias("line"))


def snapshot_lines(snapshot: DataFrame) -> DataFrame:
    """Key snapshot facts as report lines."""
    items = [
        ("state", F.col("state")), ("evidence", F.col("evidence_counts")), ("events", F.col("event_counts")),
        ("open work", F.col("open_tasks_by_role")),
        ("corroborated", F.col("corroborated_system_records").cast("string")),
        ("uncorroborated", F.col("uncorroborated_system_records").cast("string")),
        ("unlinked observations", F.col("unlinked_observations").cast("string")),
        ("last seen", F.col("last_seen_by_source")),
    ]
    arr = F.array(*[F.struct(F.lit(i).alias("n"), F.concat(F.lit(f"- {k}: "), F.coalesce(v, F.lit(""))).alias("l"))
                    for i, (k, v) in enumerate(items)])
    return snapshot.select("store_id", F.explode(arr).alias("x")).select(
        "store_id", F.lit("snapshot").alias("section"), F.col("x.n").alias("line_no"), F.col("x.l").alias("line"))


def proof_state_lines(state_counts: DataFrame) -> DataFrame:
    """'- state: count' per (store, proof state)."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(
        ("disputed", "awaiting_system_record", "awaiting_camera_context", "awaiting_human_confirmation",
         "evidence_complete")) for x in (s, i)])
    return state_counts.select("store_id", F.lit("proofs").alias("section"),
                               F.coalesce(F.element_at(order, F.col("state")), F.lit(9)).alias("line_no"),
                               F.concat(F.lit("- "), F.col("state"), F.lit(": "), F.col("count").cast("string")).alias("line"))


def write_artifacts(df: DataFrame, path: str, fmt: str = "json", max_records_per_file: int = 1_000_000,
                    num_partitions: int | None = None) -> None:
    """Persist per-store artifacts, one folder per store; stores that are not in ``df`` keep theirs.

    Range-partitioning on store_id (then the next two columns) keeps each store in few tasks
    (few files) while a hot store is still split over several tasks; files are
    capped at ``max_records_per_file``.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartitionByRange(n, "store_id", *[c for c in df.columns if c != "store_id"][:2])
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", max_records_per_file)
     .partitionBy("store_id").format(fmt).save(path))


def store_status(questions: DataFrame | None, tasks: DataFrame, events: DataFrame, evidence: DataFrame,
                 actions: DataFrame | None) -> DataFrame:
    """Per-store counts: open questions, open tasks, events, evidence, actions."""
    parts = [tasks.where(F.col("status") == "open").select("store_id", F.lit("open_tasks").alias("metric")),
             events.select("store_id", F.lit("events").alias("metric")),
             evidence.select("store_id", F.lit("evidence").alias("metric"))]
    if questions is not None:
        parts.append(questions.where(~F.col("resolved")).select("store_id", F.lit("open_questions").alias("metric")))
    if actions is not None:
        parts.append(actions.select("store_id", F.lit("actions").alias("metric")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    metrics = ["open_questions", "open_tasks", "events", "evidence", "actions"]
    out = u.groupBy("store_id").pivot("metric", metrics).agg(F.count(F.lit(1)))
    return out.select("store_id", *[F.coalesce(F.col(m), F.lit(0)).cast("bigint").alias(m) for m in metrics])


def store_awareness(catalog: DataFrame, role_cands: DataFrame, declared: DataFrame, inferred: DataFrame,
                    caps: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """One summary row per store of what was learned from structure alone."""
    from storelens.operators.catalog import with_paths

    c = with_paths(catalog).groupBy("store_id").agg(
        F.countDistinct("table_path").alias("table_count"), F.count(F.lit(1)).alias("column_count"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    r = role_cands.groupBy("store_id").agg(F.count(F.lit(1)).alias("role_candidate_count"))
    d = declared.groupBy("store_id").agg(F.count(F.lit(1)).alias("declared_relationships"))
    i = inferred.groupBy("store_id").agg(F.count(F.lit(1)).alias("inferred_relationships"))
    out = c.join(r, "store_id", "left").join(d, "store_id", "left").join(i, "store_id", "left").join(caps, "store_id", "left")
    if channels is not None:
        out = out.join(channels.groupBy("store_id").agg(F.count(F.lit(1)).alias("camera_channel_count")), "store_id", "left")
    else:
        out = out.withColumn("camera_channel_count", F.lit(0))
    for col in ("role_candidate_count", "declared_relationships", "inferred_relationships", "camera_channel_count"):
        out = out.withColumn(col, F.coalesce(F.col(col), F.lit(0)).cast("bigint"))
    return out.select("store_id", F.lit("structural_metadata_only").alias("basis"), F.lit(False).alias("verified"),
                      "sources", "table_count", "column_count", "role_candidate_count", "capabilities", "unknowns",
                      "declared_relationships", "inferred_relationships", "camera_channel_count")
