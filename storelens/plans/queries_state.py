"""Registered state-fold and health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.functions.scalar import iso_text
from storelens.operators import health, state
from storelens.plans.queries import register
from storelens.schemas import AUTHORITY_LEVELS
from storelens.sources import fixtures as fx
from storelens.sources.tables import table

ACTIONS = ("open_drawer", "restart_camera", "write_stock")


def fx_answers(spark, sf_dir):
    e = fx.fx_op_event(spark, sf_dir)
    n = F.col("n")
    task = F.concat(F.lit("task_"), n.cast("string"))
    yes_no = F.when(n % 2 == 0, F.lit("yes")).otherwise(F.lit("no"))
    a = e.where(n % 4 != 0).select(F.concat(F.lit("ans_"), n.cast("string"), F.lit("_a")).alias("answer_id"), "store_id",
                                   task.alias("task_id"), F.lit("gateway").alias("actor"),
                                   F.col("occurred_at").alias("answered_at"), yes_no.alias("confirmed"))
    b = e.where(n % 8 == 1).select(F.concat(F.lit("ans_"), n.cast("string"), F.lit("_b")).alias("answer_id"), "store_id",
                                   task.alias("task_id"), F.lit("gateway").alias("actor"),
                                   F.concat("occurred_at", F.lit("x")).alias("answered_at"), F.lit("no").alias("confirmed"))
    c = e.where(n % 10 == 3).select(F.concat(F.lit("ans_"), n.cast("string"), F.lit("_c")).alias("answer_id"), "store_id",
                                    F.concat(F.lit("task_missing_"), n.cast("string")).alias("task_id"),
                                    F.lit("gateway").alias("actor"), F.col("occurred_at").alias("answered_at"),
                                    F.lit("yes").alias("confirmed"))
    return a.unionByName(b).unionByName(c)


@register("answer_tasks")
def q_answer_tasks(spark, sf_dir):
    tasks, _, _ = state.answer_tasks(fx.fx_task(spark, sf_dir).drop("n"), fx_answers(spark, sf_dir))
    return tasks.select("id", "store_id", "status", F.col("answer.confirmed").alias("answer_confirmed"),
                        F.col("answer.evidence_id").alias("answer_evidence_id"), "answered_at")


@register("answer_tasks_rejected")
def q_answer_tasks_rejected(spark, sf_dir):
    return state.answer_tasks(fx.fx_task(spark, sf_dir).drop("n"), fx_answers(spark, sf_dir))[2]


@register("answer_tasks_evidence")
def q_answer_tasks_evidence(spark, sf_dir):
    return state.answer_tasks(fx.fx_task(spark, sf_dir).drop("n"), fx_answers(spark, sf_dir))[1]


def _answered(spark, sf_dir):
    """(questions, mappings, rejected) after the fleet's setup answers."""
    from storelens.plans.queries import _questions

    mappings, questions, stores = _questions(spark, sf_dir)
    k = F.substring("store_id", 5, 20).cast("bigint")
    is_verify = F.col("key").startswith("verify:")
    current = mappings.select("store_id", F.concat(F.lit("verify:"), F.col("canonical_field")).alias("key"),
                              F.col("source_path").alias("_cur"))
    q = questions.join(current, ["store_id", "key"], "left")
    answer = (F.when(is_verify & (k % 4 == 0), F.lit("yes")).when(is_verify & (k % 4 == 1), F.col("_cur"))
              .when(is_verify & (k % 4 == 2), F.lit("corrected.table.column"))
              .when(is_verify, F.lit("none_of_these"))
              .when(k % 2 == 0, F.lit("shop_export.ItemMaster.ItemCode")).otherwise(F.lit("nodot")))
    answers = q.select("store_id", "key", answer.alias("answer"), F.lit("owner").alias("actor"),
                       F.lit("2026-01-01T00:00:00").alias("answered_at"))
    return state.answer_questions(questions, mappings, answers)


@register("answer_questions")
def q_answer_questions(spark, sf_dir):
    return _answered(spark, sf_dir)[1].select("store_id", "canonical_field", "source_path", "confidence", "verified")


@register("answer_questions_resolved")
def q_answer_questions_resolved(spark, sf_dir):
    return _answered(spark, sf_dir)[0].select("store_id", "key", "resolved", "answer")


@register("answer_questions_rejected")
def q_answer_questions_rejected(spark, sf_dir):
    return _answered(spark, sf_dir)[2]


def fx_actions(spark, sf_dir):
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    i = F.col("event_id")
    req = ev.select(
        F.concat(F.lit("act_"), i.cast("string")).alias("id"),
        F.concat(F.lit("store_"), (F.col("user_id") % 4).cast("string")).alias("store_id"),
        F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (i % 3 + 1).cast("int")).alias("action"),
        F.concat(F.lit("target_"), (F.col("user_id") % 5).cast("string")).alias("target"),
        F.element_at(F.array(*[F.lit(a) for a in AUTHORITY_LEVELS]), (i % 6 + 1).cast("int")).alias("authority"),
        iso_text("ts").alias("requested_at"), i.alias("n"))
    rid = F.col("id").alias("action_id")
    # some decisions name another store's action, and some approvals share an instant
    store = F.when(F.col("n") % 12 == 1, F.lit("store_x")).otherwise(F.col("store_id")).alias("store_id")
    dec = (req.where(F.col("n") % 4 <= 1).select(rid, store, F.lit("approve").alias("decision"), F.lit("boss").alias("actor"),
                                                   F.concat("requested_at", F.lit("a")).alias("decided_at"))
           .unionByName(req.where(F.col("n") % 16 == 0).select(rid, store, F.lit("approve").alias("decision"),
                        F.lit("boss3").alias("actor"), F.concat("requested_at", F.lit("a")).alias("decided_at")))
           .unionByName(req.where(F.col("n") % 4 == 0).select(rid, store, F.lit("execute").alias("decision"),
                        F.lit("executor").alias("actor"), F.concat("requested_at", F.lit("b")).alias("decided_at")))
           .unionByName(req.where(F.col("n") % 4 == 2).select(rid, store, F.lit("execute").alias("decision"),
                        F.lit("executor").alias("actor"), F.concat("requested_at", F.lit("b")).alias("decided_at")))
           .unionByName(req.where(F.col("n") % 8 == 0).select(rid, store, F.lit("approve").alias("decision"),
                        F.lit("boss2").alias("actor"), F.concat("requested_at", F.lit("c")).alias("decided_at"))))
    return req, dec


@register("action_status")
def q_action_status(spark, sf_dir):
    req, dec = fx_actions(spark, sf_dir)
    actions, _ = state.action_status(req.drop("n"), dec)
    return actions.select("id", "store_id", "authority", "initial_status", "status", "approved_by", "approved_at",
                          "executed_at")


@register("action_status_rejected")
def q_action_status_rejected(spark, sf_dir):
    req, dec = fx_actions(spark, sf_dir)
    return state.action_status(req.drop("n"), dec)[1]


@register("open_action_dedupe")
def q_open_action_dedupe(spark, sf_dir):
    req, dec = fx_actions(spark, sf_dir)
    actions, _ = state.action_status(req.drop("n"), dec)
    new = req.where(F.col("n") % 5 == 0).select(
        F.concat(F.lit("new_"), F.col("id")).alias("id"), "store_id", "action",
        F.concat(F.lit("target_"), (F.col("n") % 7).cast("string")).alias("target"), "authority",
        F.concat("requested_at", F.lit("z")).alias("requested_at"))
    return state.open_action_dedupe(actions, new)


def _now(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("now"))


@register("collector_health")
def q_collector_health(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    store = F.concat(F.lit("hb_"), F.col("user_id").cast("string")).alias("store_id")
    i = F.col("event_id")
    hb = ev.where(F.col("event_type") == "error").select(
        store, F.element_at(F.array(*[F.lit(s) for s in ("RUNNING", "stopped", "error", "starting")]),
                            (i % 4 + 1).cast("int")).alias("status"),
        F.element_at(F.array(*[F.lit(s) for s in ("running", "running", "offline")]), (i % 3 + 1).cast("int")).alias(
            "camera_status"),
        F.lit("ok").alias("sql_status"), iso_text("ts").alias("updated_at"), F.lit("secret").alias("password"))
    last = ev.where(F.col("event_type") == "view").select(store, iso_text("ts").alias("last_event_at"))
    now = _now(spark, sf_dir).first()["now"]  # one scalar (the data's clock), not rows
    return health.collector_health(hb, last, now, 30)


@register("cycle_health")
def q_cycle_health(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    kind = (F.when(F.col("event_type") == "purchase", "import").when(F.col("event_type") == "signup", "primed")
            .when(F.col("event_type") == "view", "event").when(F.col("event_type") == "error", "error").otherwise("other"))
    comp = F.element_at(F.array(F.lit("sql"), F.lit("camera_runtime"), F.lit("snapshot")),
                        (F.col("event_id") % 3 + 1).cast("int"))
    log = ev.select(F.concat(F.lit("store_"), (F.col("user_id") % 4).cast("string")).alias("store_id"),
                    F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH").alias("cycle_id"),
                    kind.alias("kind"), F.when(kind == "error", comp).alias("component"))
    return health.cycle_health(log)


@register("rescan_due")
def q_rescan_due(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    k = F.col("c_custkey")
    s = c.join(o, c["c_custkey"] == o["o_custkey"], "left").select(
        F.concat(F.lit("cat_"), k.cast("string")).alias("store_id"),
        (k % 29 != 0).alias("has_profile"),
        F.when(k % 23 == 0, F.lit("garbage")).otherwise(F.date_format("last", "yyyy-MM-dd'T'HH:mm:ss")).alias(
            "last_rescan_at"),
        (k % 17 == 0).alias("force"))
    return health.rescan_due(s, "2001-01-01T00:00:00", 3600 * 24 * 365)
