"""Onboarding end to end: propose -> questions -> answers -> ready -> rescan stays ready."""

from pyspark.sql import functions as F

from storelens.operators import catalog as co
from storelens.operators.health import collector_health, rescan_due
from storelens.operators.state import action_status, answer_questions

from test_catalog import LEGACY, _catalog

ANSWERS = {
    "map:product.identity": "old_pos_sql.Mst_Itm.Item_No",
    "verify:purchase.quantity": "old_pos_sql.Pur_Dtl_26.QntyRcvd",
    "verify:product.pack_size": "old_pos_sql.Mst_Itm.CtnFactor",
    "verify:movement.destination": "old_pos_sql.Pur_Dtl_26.GoDown_No",
    "verify:camera.zone": "old_pos_sql.Cctv_Map.Feed_Channel",
    "verify:staff.role": "old_pos_sql.Emp_Mst.EmpDuty",
}


def test_legacy_store_becomes_ready_and_stays_ready(spark):
    cat = _catalog(spark, "legacy", LEGACY)
    stores = spark.createDataFrame([("legacy", False)], "store_id string, requires_confirmation boolean")
    scores = co.score_mappings(cat)
    mappings = co.propose_mappings(scores, stores)
    questions = co.setup_questions(mappings, scores, stores)
    assert questions.count() == 6
    answers = spark.createDataFrame([("legacy", k, v, "test_owner", "2026-01-01T00:00:00") for k, v in ANSWERS.items()],
                                    "store_id string, key string, answer string, actor string, answered_at string")
    q1, m1, rejected = answer_questions(questions, mappings, answers)
    assert rejected.count() == 0
    ready = co.readiness(m1, q1, stores).first()
    assert ready["ready"], ready["detail"]
    corrected = {r["canonical_field"]: r["source_path"] for r in m1.collect()}
    assert corrected["purchase.quantity"].endswith("QntyRcvd") and corrected["camera.zone"].endswith("Feed_Channel")
    # rescan: fresh proposals, previous verified mappings carried forward
    rescanned = co.carry_forward_mappings(co.propose_mappings(scores, stores), m1, cat)
    q2 = co.setup_questions(rescanned, scores, stores)
    assert q2.count() == 0
    assert co.readiness(rescanned, q2, stores).first()["ready"]


def test_rejected_answer_keeps_question_open(spark):
    cat = _catalog(spark, "legacy", LEGACY)
    stores = spark.createDataFrame([("legacy", False)], "store_id string, requires_confirmation boolean")
    scores = co.score_mappings(cat)
    mappings = co.propose_mappings(scores, stores)
    questions = co.setup_questions(mappings, scores, stores)
    answers = spark.createDataFrame([("legacy", "verify:staff.role", "none_of_these", "o", "t"),
                                     ("legacy", "map:product.identity", "nodot", "o", "t")],
                                    "store_id string, key string, answer string, actor string, answered_at string")
    q1, _, rejected = answer_questions(questions, mappings, answers)
    assert rejected.count() == 2
    assert q1.where(~F.col("resolved")).count() == 6


def test_collector_health_states(spark):
    hb = spark.createDataFrame([
        ("a", "running", "running", "ok", "2026-07-16T10:00:00+00:00"),
        ("b", "running", "running", "ok", "2026-07-16T09:00:00+00:00"),
        ("c", "stopped", "running", "ok", "2026-07-16T10:00:30+00:00"),
    ], "store_id string, status string, camera_status string, sql_status string, updated_at string")
    last = spark.createDataFrame([("d", "2026-07-16T09:00:00+00:00")], "store_id string, last_event_at string")
    got = {r["store_id"]: r["state"] for r in collector_health(hb, last, "2026-07-16T10:01:00+00:00").collect()}
    assert got == {"a": "running", "b": "stale_heartbeat", "c": "not_running", "d": "stale_event_store"}


def test_rescan_and_action_policy(spark):
    s = spark.createDataFrame([("a", True, "2026-07-16T09:00:00", False), ("b", True, "2026-07-16T10:30:00", False),
                               ("c", True, "bad", False), ("d", False, None, False), ("e", True, "2026-07-16T10:59:00", True)],
                              "store_id string, has_profile boolean, last_rescan_at string, force boolean")
    got = {r["store_id"]: r["reason"] for r in rescan_due(s, "2026-07-16T11:00:00", 3600).collect()}
    assert got == {"a": "interval_elapsed", "b": None, "c": "unparseable_last_rescan", "d": "no_profile", "e": "forced"}
    req = spark.createDataFrame([("x", "s", "open", "t", "observe"), ("y", "s", "pay", "t", "system_change"),
                                 ("z", "s", "delete", "t", "prohibited")],
                                "id string, store_id string, action string, target string, authority string")
    dec = spark.createDataFrame([("y", "s", "approve", "boss", "1"), ("y", "s", "approve", "other", "1"), ("y", "s", "execute", "exec", "1"),
                                 ("z", "s", "approve", "boss", "1"), ("x", "elsewhere", "approve", "boss", "1")],
                                "action_id string, store_id string, decision string, actor string, decided_at string")
    actions, rejected = action_status(req, dec)
    st = {r["id"]: (r["status"], r["approved_by"]) for r in actions.collect()}
    assert st == {"x": ("allowed", None), "y": ("executed", "boss"), "z": ("denied", None)}
    assert sorted((r["action_id"], r["actor"], r["reason"]) for r in rejected.collect()) == [
        ("x", "boss", "unknown_action"), ("y", "other", "illegal_transition"), ("z", "boss", "prohibited_action")]
