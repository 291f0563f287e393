"""Strict per-event proof state.

A proof needs a linked system record, a camera observation near in time and a
positive role-routed human confirmation; a negative confirmation disputes it.
Camera timing never proves SKU or quantity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.scalar import confirmation_value
from storelens.operators.correlate import nearest_camera
from storelens.schemas import CONFIRMATION_ROLES

# Fixed vocabulary of proof states and missing items.
STATES = ("disputed", "awaiting_system_record", "awaiting_camera_context",
          "awaiting_human_confirmation", "evidence_complete")
MISSING = ("linked_system_record", "nearby_camera_observation", "positive_role_routed_confirmation")


def _ordered_ids(entries: Column) -> Column:
    """array<struct<o..., id>> -> ids ordered by the struct."""
    return F.transform(F.array_sort(entries), lambda e: e["id"])


def link_evidence(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """(event_id, position, evidence_id, kind): event links that resolve to evidence of
    the event's own store; order and duplicates kept, other ids dropped."""
    links = events.select(F.col("id").alias("event_id"), "store_id",
                          F.posexplode("evidence_ids").alias("position", "evidence_id"))
    known = evidence.select(F.col("id").alias("evidence_id"), "store_id", "kind")
    return links.join(known, ["evidence_id", "store_id"]).select("event_id", "position", "evidence_id", "kind")


def check_evidence_refs(events: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split events into (ok, rejected): rejected ones reference unknown evidence."""
    links = events.select(F.col("id").alias("_eid"), F.explode("evidence_ids").alias("_evd"))
    dangling = links.join(evidence.select(F.col("id").alias("_evd")), "_evd", "left_anti").select("_eid").distinct()
    ok = events.join(dangling, events["id"] == dangling["_eid"], "left_anti")
    rejected = events.join(dangling, events["id"] == dangling["_eid"], "left_semi")
    return ok, rejected


def task_confirmations(tasks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Answered operational-role tasks backed by a human_confirmation evidence row of
    the same store, with the decisive answer value (true / false / null)."""
    t = tasks.where((F.col("status") == "answered") & F.col("role").isin(*CONFIRMATION_ROLES))
    conf = evidence.where(F.col("kind") == "human_confirmation").select(
        F.col("id").alias("_cid"), F.col("store_id").alias("_cstore"))
    j = t.join(conf, (t["answer"].getField("evidence_id") == conf["_cid"]) & (t["store_id"] == conf["_cstore"]))
    return j.select(
        F.col("id").alias("task_id"),
        "store_id",
        "related_event_id",
        "role",
        F.col("answer").getField("evidence_id").alias("confirmation_evidence_id"),
        confirmation_value(F.col("answer")).alias("confirmation"),
        F.col("created_at"),
    )


def operation_proofs(events: DataFrame, evidence: DataFrame, tasks: DataFrame, window_minutes: int = 15) -> DataFrame:
    """One proof row per event."""
    ev = events.select("id", "store_id", "event_type", "occurred_at", "evidence_ids")

    linked = link_evidence(ev, evidence).where(F.col("kind") == "system_record")
    sys_ids = linked.groupBy("event_id").agg(
        _ordered_ids(F.collect_list(F.struct("position", F.col("evidence_id").alias("id")))).alias("system_ids")
    )

    conf = task_confirmations(tasks, evidence)
    entry = F.struct(F.col("created_at"), F.col("task_id").alias("id"))
    # One list is one event's tasks; tasks without an event vote on nothing.
    votes = conf.where(F.col("related_event_id").isNotNull()).groupBy(
        F.col("store_id").alias("_vstore"), "related_event_id").agg(
        _ordered_ids(F.collect_list(F.when(F.col("confirmation") == True, entry))).alias("positive"),  # noqa: E712
        _ordered_ids(F.collect_list(F.when(F.col("confirmation") == False, entry))).alias("negative"),  # noqa: E712
    )

    cam = nearest_camera(ev.select("id", "store_id", "occurred_at"), evidence, window_minutes).select(
        F.col("id").alias("_cid"), "camera_observation_id", "camera_diff_us"
    )

    # The joins by id alone stand together, so events are dealt by id once and by (id, store) once.
    p = (
        ev.join(sys_ids, ev["id"] == sys_ids["event_id"], "left")
        .join(cam, ev["id"] == cam["_cid"], "left")
        .join(votes, (ev["id"] == votes["related_event_id"]) & (ev["store_id"] == votes["_vstore"]), "left")
    )
    empty = F.array().cast("array<string>")
    sysa = F.coalesce(F.col("system_ids"), empty)
    pos = F.coalesce(F.col("positive"), empty)
    neg = F.coalesce(F.col("negative"), empty)
    has_sys, has_cam, has_pos = F.size(sysa) > 0, F.col("camera_observation_id").isNotNull(), F.size(pos) > 0
    state = (
        F.when(F.size(neg) > 0, "disputed")
        .when(~has_sys, "awaiting_system_record")
        .when(~has_cam, "awaiting_camera_context")
        .when(~has_pos, "awaiting_human_confirmation")
        .otherwise("evidence_complete")
    )
    missing = F.array_compact(F.array(
        F.when(~has_sys, F.lit(MISSING[0])), F.when(~has_cam, F.lit(MISSING[1])), F.when(~has_pos, F.lit(MISSING[2]))
    ))
    return p.select(
        F.col("id").alias("event_id"),
        "store_id",
        "event_type",
        "occurred_at",
        state.alias("state"),
        sysa.alias("system_evidence_ids"),
        "camera_observation_id",
        F.col("camera_diff_us").alias("camera_time_difference_us"),
        pos.alias("positive_confirmation_task_ids"),
        neg.alias("negative_confirmation_task_ids"),
        missing.alias("missing"),
        has_sys.alias("database_record_present"),
        has_cam.alias("camera_temporal_context_present"),
        has_pos.alias("role_routed_human_confirmation_present"),
    )


def proof_state_counts(proofs: DataFrame) -> DataFrame:
    """Per (store, state) counts plus the store's complete_count."""
    c = proofs.groupBy("store_id", "state").agg(F.count(F.lit(1)).alias("count"))
    complete = c.where(F.col("state") == "evidence_complete").select("store_id", F.col("count").alias("complete_count"))
    return c.join(complete, "store_id", "left").fillna(0, ["complete_count"])


def proofs_report(proofs: DataFrame) -> DataFrame:
    """Flat text form of the list-valued proof columns (for reports and exports)."""
    out = proofs
    for c in ("system_evidence_ids", "positive_confirmation_task_ids", "negative_confirmation_task_ids", "missing"):
        out = out.withColumn(c, F.array_join(F.col(c), ","))
    return out
