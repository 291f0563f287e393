"""Event-sourced state folds.

Instead of mutating records in place, every change is an appended fact (an
answer, a decision); current state is a join/aggregate over the log.  Illegal
transitions go to a ``rejected`` output instead of raising.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.schemas import ANSWER_FIELDS

# Action policy and outcome texts of setup answers.
AUTOMATIC_AUTHORITY = ("observe", "local_work")
ACTIVE_ACTION_STATUSES = ("pending_approval", "approved", "allowed")
CORRECTED_TEXT = ("Human corrected proposed mapping `", "` during onboarding; confirmed by ", ".")
MAPPED_TEXT = ("Confirmed by ", " during onboarding.")


def answer_tasks(tasks: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply answers to open tasks.

    ``answers``: answer_id, store_id, task_id, actor, answered_at and the answer
    keys (confirmed, verified, ...); keys without a field of their own are kept
    together as JSON in ``other``.  Returns (tasks after, confirmation evidence,
    rejected answers).  The first answer per open task wins; answers for unknown,
    foreign-store or non-open tasks, and later duplicates, are rejected.  Only answers to
    open tasks are ordered, each task's by itself; those without a task id go
    straight to the rejected ones.
    """
    rejection = lambda df, reason: df.select("answer_id", "store_id", "task_id", F.lit(reason).alias("reason"))
    open_tasks = tasks.where(F.col("status") == "open").select("store_id", F.col("id").alias("task_id")).distinct()
    named = answers.where(F.col("task_id").isNotNull() & F.col("store_id").isNotNull())
    nameless = answers.where(F.col("task_id").isNull() | F.col("store_id").isNull())
    # One window is the answers to one open task.
    order = Window.partitionBy("store_id", "task_id").orderBy("answered_at", "answer_id")
    cand = named.join(open_tasks, ["store_id", "task_id"]).withColumn("_rn", F.row_number().over(order))
    accepted = cand.where(F.col("_rn") == 1)
    rejected = rejection(nameless, "unknown_or_not_open_task").unionByName(
        rejection(named.join(open_tasks, ["store_id", "task_id"], "left_anti"), "unknown_or_not_open_task")).unionByName(
        rejection(cand.where(F.col("_rn") > 1), "task_already_answered"))

    evid = F.concat(F.lit("evd_"), F.sha2(F.concat_ws("|", "store_id", "answer_id"), 256))
    own = ("answer_id", "store_id", "task_id", "actor", "answered_at")
    given = [c for c in answers.columns if c not in own]
    present = [f for f in given if f not in ("evidence_id", "actor")]
    rest = [c for c in given if c not in ANSWER_FIELDS]
    other = F.to_json(F.struct(*[F.col(c) for c in rest])) if rest else F.lit(None).cast("string")
    fixed = [f for f in ANSWER_FIELDS if f not in ("evidence_id", "actor", "other")]
    answer_struct = F.struct(*[
        (F.col(f).cast("string") if f in given else F.lit(None).cast("string")).alias(f) for f in fixed
    ], evid.alias("evidence_id"), F.col("actor").alias("actor"), other.alias("other"))
    acc = accepted.select("task_id", "store_id", "actor", "answered_at", evid.alias("_evid"),
                          answer_struct.alias("_answer"),
                          F.to_json(F.struct(F.col("task_id"), F.struct(*[F.col(f) for f in present]).alias("answer")))
                          .alias("_payload"))
    evidence = acc.select(
        F.col("_evid").alias("id"), "store_id", F.lit("human_confirmation").alias("kind"),
        F.col("actor").alias("source"), F.lit(1.0).alias("confidence"),
        F.col("answered_at").alias("occurred_at"), F.col("_payload").alias("payload"),
    )
    upd = acc.select(F.col("task_id").alias("_id"), F.col("store_id").alias("_s"), "_answer", "answered_at")
    t = tasks.join(upd, (tasks["id"] == upd["_id"]) & (tasks["store_id"] == upd["_s"]), "left")
    hit = F.col("_id").isNotNull()
    cols = [c for c in tasks.columns if c not in ("status", "answer", "answered_at")]
    out = t.select(
        *[tasks[c] for c in cols],
        F.when(hit, F.lit("answered")).otherwise(tasks["status"]).alias("status"),
        (F.when(hit, F.col("_answer")).otherwise(tasks["answer"]) if "answer" in tasks.columns
         else F.col("_answer")).alias("answer"),
        F.col("answered_at"),
    )
    return out, evidence, rejected


def answer_questions(questions: DataFrame, mappings: DataFrame, answers: DataFrame
                     ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply setup answers (``store_id, key, answer, actor``; last answer per key wins).

    verify: yes / true / the proposed path -> verified; another dotted path
    (not none_of_these) -> corrected at 1.0.  map: a dotted path -> new mapping.
    Anything else leaves the question unresolved (rejected output).
    """
    w = Window.partitionBy("store_id", "key").orderBy(F.col("answered_at").desc_nulls_last(), F.col("answer").desc())
    a = answers.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    q = questions.select("store_id", "key").join(a, ["store_id", "key"])
    q = q.withColumn("canonical_field", F.split("key", ":", 2)[1]).withColumn("_kind", F.split("key", ":", 2)[0])
    m = mappings.select("store_id", "canonical_field", F.col("source_path").alias("_cur"))
    q = q.join(m, ["store_id", "canonical_field"], "left")
    ans = F.col("answer").cast("string")
    dotted = ans.contains(".") & (ans != "none_of_these")
    confirm = (F.lower(ans).isin("yes", "true")) | (ans == F.col("_cur"))
    outcome = (
        F.when((F.col("_kind") == "verify") & F.col("_cur").isNotNull() & confirm, F.lit("verified"))
        .when((F.col("_kind") == "verify") & F.col("_cur").isNotNull() & dotted, F.lit("corrected"))
        .when((F.col("_kind") == "map") & dotted, F.lit("mapped"))
        .otherwise(F.lit("rejected"))
    )
    q = q.withColumn("outcome", outcome)
    good = q.where(F.col("outcome") != "rejected")
    rejected = q.where(F.col("outcome") == "rejected").select("store_id", "key", "answer", "actor")

    changes = good.select(
        "store_id", "canonical_field", "outcome",
        F.when(F.col("outcome") == "verified", F.col("_cur")).otherwise(ans).alias("_new_path"), "actor",
    )
    mj = mappings.join(changes, ["store_id", "canonical_field"], "full")
    changed = F.col("outcome").isNotNull()
    reason = (F.when(F.col("outcome") == "corrected",
                     F.concat(F.lit(CORRECTED_TEXT[0]), F.col("source_path"), F.lit(CORRECTED_TEXT[1]), F.col("actor"),
                              F.lit(CORRECTED_TEXT[2])))
              .when(F.col("outcome") == "mapped",
                    F.concat(F.lit(MAPPED_TEXT[0]), F.col("actor"), F.lit(MAPPED_TEXT[1])))
              .otherwise(F.col("reasoning")))
    new_mappings = mj.select(
        "store_id", "canonical_field",
        F.when(changed, F.col("_new_path")).otherwise(F.col("source_path")).alias("source_path"),
        F.when(F.col("outcome").isin("corrected", "mapped"), F.lit(1.0)).otherwise(
            F.col("confidence").cast("double")).alias("confidence"),
        reason.alias("reasoning"),
        F.when(changed, F.lit(True)).otherwise(F.col("verified")).alias("verified"),
    )
    res = good.select("store_id", "key", F.col("answer").alias("_ans"))
    qj = questions.join(res, ["store_id", "key"], "left")
    new_questions = qj.select(
        *[c for c in questions.columns if c not in ("resolved", "answer")],
        (F.col("_ans").isNotNull() | (F.col("resolved") if "resolved" in questions.columns else F.lit(False)))
        .alias("resolved"),
        F.col("_ans").cast("string").alias("answer"),
    )
    return new_questions, new_mappings, rejected


def classify_action(authority) -> F.Column:
    a = F.col(authority) if isinstance(authority, str) else authority
    return (F.when(a == "prohibited", F.lit("denied"))
            .when(a.isin(*AUTOMATIC_AUTHORITY), F.lit("allowed"))
            .otherwise(F.lit("pending_approval")))


def action_status(requests: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current action status from requests and an append-only decision log.

    ``decisions``: action_id, store_id, decision ('approve' | 'execute'), actor,
    decided_at.  The decisions of an action are taken in order of time, approvals
    before executions and then by actor; the first approval of an action that
    was not denied counts, then the first execution after it.  All others are
    rejected, and so are decisions on another store's action.
    Returns (actions, rejected).
    """
    base = requests.withColumn("initial_status", classify_action("authority"))
    own = base.select(F.col("id").alias("action_id"), "store_id", "initial_status")
    # One window is one action's decisions.
    order = Window.partitionBy("action_id", "store_id").orderBy("decided_at", "decision", "actor")
    d = decisions.select("action_id", "store_id", "decision", "actor", "decided_at").withColumn(
        "_n", F.row_number().over(order)).join(own, ["action_id", "store_id"], "left")
    may = (F.col("decision") == "approve") & F.col("initial_status").isin("pending_approval", "allowed")
    whole = Window.partitionBy("action_id", "store_id")
    d = d.withColumn("_approved", F.min(F.when(may, F.col("_n"))).over(whole))
    after = (F.col("decision") == "execute") & (F.col("_n") > F.col("_approved"))
    d = d.withColumn("_executed", F.min(F.when(after, F.col("_n"))).over(whole))
    approves = F.coalesce(F.col("_n") == F.col("_approved"), F.lit(False))
    executes = F.coalesce(F.col("_n") == F.col("_executed"), F.lit(False))
    rejected = d.where(~approves & ~executes).select(
        "action_id", "decision", "actor", "decided_at",
        F.when(F.col("initial_status").isNull(), F.lit("unknown_action"))
        .when(F.col("initial_status") == "denied", F.lit("prohibited_action"))
        .otherwise(F.lit("illegal_transition")).alias("reason"))
    taken = d.where(approves | executes).groupBy("action_id", "store_id").agg(
        F.max(F.when(approves, F.struct("decided_at", "actor"))).alias("_appr"),
        F.max(F.when(executes, F.col("decided_at"))).alias("_exec_t")).withColumnRenamed("store_id", "_store")
    j = base.join(taken, (base["id"] == taken["action_id"]) & (base["store_id"] == taken["_store"]), "left")
    status = (F.when(F.col("_exec_t").isNotNull(), F.lit("executed"))
              .when(F.col("_appr").isNotNull(), F.lit("approved"))
              .otherwise(F.col("initial_status")))
    actions = j.select(
        *[base[c] for c in requests.columns], "initial_status", status.alias("status"),
        F.col("_appr.actor").alias("approved_by"), F.col("_appr.decided_at").alias("approved_at"),
        F.col("_exec_t").alias("executed_at"))
    return actions, rejected


def open_action_dedupe(active: DataFrame, new_requests: DataFrame) -> DataFrame:
    """New requests that do not duplicate an active (store, action, target) request;
    among duplicates in the batch the first (requested_at, id) wins."""
    act = active.where(F.col("status").isin(*ACTIVE_ACTION_STATUSES)).select("store_id", "action", "target")
    fresh = new_requests.join(act, ["store_id", "action", "target"], "left_anti")
    w = Window.partitionBy("store_id", "action", "target").orderBy("requested_at", "id")
    return fresh.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
