"""Proof states re-expressed from the reference's examples."""

from pyspark.sql import functions as F

from storelens.operators.proofs import operation_proofs
from storelens.operators.state import answer_tasks
from storelens.operators.workflows import evaluate_workflows


def _case(spark, camera_time, sql_time, answer=None):
    evidence = spark.createDataFrame([
        ("cam-1", "proof_shop", "observation", "authorized_camera_collector", 0.8, camera_time, '{"private": "x"}'),
        ("sys-1", "proof_shop", "system_record", "learned_sql_facts", 1.0, sql_time, '{"private": "x"}'),
    ], "id string, store_id string, kind string, source string, confidence double, occurred_at string, payload string")
    events = spark.createDataFrame(
        [("evt-1", "proof_shop", "receiving", sql_time, ["sys-1"],
          ("SKU-PRIVATE", 12.0, "GD-PRIVATE", False))],
        "id string, store_id string, event_type string, occurred_at string, evidence_ids array<string>, "
        "facts struct<product_id:string, pack_size:double, destination_id:string, receiver_confirmed:boolean>")
    events_eval, tasks = evaluate_workflows(events)
    assert set(r["role"] for r in tasks.collect()) == {"godown_staff"}
    if answer is not None:
        task_id = tasks.where(F.col("role") == "godown_staff").first()["id"]
        answers = spark.createDataFrame([("a1", "proof_shop", task_id, "gateway", "2026-07-16T11:00:00", answer)],
                                        "answer_id string, store_id string, task_id string, actor string, "
                                        "answered_at string, confirmed string")
        tasks, new_ev, rejected = answer_tasks(tasks, answers)
        assert rejected.count() == 0
        evidence = evidence.unionByName(new_ev)
    return operation_proofs(events_eval, evidence, tasks, 15).collect()[0]


def test_timing_alone_never_completes(spark):
    p = _case(spark, "2026-07-16T10:00:00+00:00", "2026-07-16T10:02:00+00:00")
    assert p["state"] == "awaiting_human_confirmation"
    assert p["positive_confirmation_task_ids"] == []
    assert "SKU-PRIVATE" not in str(p.asDict())


def test_positive_confirmation_completes(spark):
    p = _case(spark, "2026-07-16T10:00:00+00:00", "2026-07-16T10:02:00+00:00", "true")
    assert p["state"] == "evidence_complete"
    assert p["database_record_present"] and p["camera_temporal_context_present"]
    assert p["role_routed_human_confirmation_present"]


def test_negative_confirmation_disputes(spark):
    p = _case(spark, "2026-07-16T10:00:00+00:00", "2026-07-16T10:02:00+00:00", "false")
    assert p["state"] == "disputed"
    assert p["positive_confirmation_task_ids"] == [] and len(p["negative_confirmation_task_ids"]) == 1


def test_distant_camera_does_not_count(spark):
    p = _case(spark, "2026-07-16T08:00:00+00:00", "2026-07-16T10:02:00+00:00")
    assert p["state"] == "awaiting_camera_context"
    assert p["camera_observation_id"] is None


def test_other_stores_evidence_and_answers_prove_nothing(spark):
    evidence = spark.createDataFrame([
        ("sys-b", "b", "system_record", "sql", 1.0, "2026-01-01T10:00:00", "{}"),
        ("cam-a", "a", "observation", "camera_1", 1.0, "2026-01-01T10:00:00", "{}"),
        ("cnf-b", "b", "human_confirmation", "staff", 1.0, "2026-01-01T10:00:00", "{}"),
    ], "id string, store_id string, kind string, source string, confidence double, occurred_at string, payload string")
    events = spark.createDataFrame([("e1", "a", "sale", "2026-01-01T10:00:00", ["sys-b"]), ("e2", "b", "sale", "2026-01-01T10:00:00", ["sys-b"])],
                                   "id string, store_id string, event_type string, occurred_at string, evidence_ids array<string>")
    answer = "struct<confirmed:string,verified:string,matches_record:string,received:string,completed:string,evidence_id:string,actor:string>"
    yes = ("yes", None, None, None, None, "cnf-b", "x")
    tasks = spark.createDataFrame([("t1", "a", "e1", "deo", "answered", yes, "1"), ("t2", "a", "e2", "deo", "answered", yes, "1"),
                                   ("t3", "b", "e2", "deo", "answered", yes, "1"), ("t4", "b", None, "deo", "answered", yes, "1")],
                                  f"id string, store_id string, related_event_id string, role string, status string, answer {answer}, created_at string")
    got = {r["event_id"]: r for r in operation_proofs(events, evidence, tasks).collect()}
    assert got["e1"]["state"] == "awaiting_system_record" and got["e1"]["positive_confirmation_task_ids"] == []
    assert got["e2"]["state"] == "awaiting_camera_context" and got["e2"]["positive_confirmation_task_ids"] == ["t3"]
