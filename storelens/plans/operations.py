"""Compositions of operators: mapping validation, the operational round, audit rows, health actions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.cache import with_rules
from storelens.operators import catalog as co
from storelens.operators import profile as pr
from storelens.operators.health import cycle_health
from storelens.operators.ingest import LEDGER_KEY, facts_to_events, new_evidence, normalize_evidence, prime_ledger
from storelens.operators.state import classify_action, open_action_dedupe
from storelens.operators.proofs import operation_proofs
from storelens.operators.workflows import evaluate_workflows
from storelens.plans.snapshot import operational_snapshot
from storelens.schemas import POLL_ITEM
from storelens.session import cut_lineage

# The action an unhealthy collector raises, and audit action names.
COLLECTOR_ACTION, COLLECTOR_TARGET, COLLECTOR_AUTHORITY = "authorize_start_camera_collector", "local_camera_collector", "system_change"
RESOLVED_BY = "autonomous_aggregate_validator"


# --- validation ----------------------------------------------------------------

def learned_targets(mappings: DataFrame, catalog: DataFrame, role_cands: DataFrame) -> DataFrame:
    """Unverified mappings into the selected SQL source that have a shape check.

    ``role_confidence`` is that of the mapped table for the check's role, 0 where the
    table is no candidate; ``role_cands`` must hold every ranked candidate.
    """
    checks = with_rules(co.mapping_targets(mappings, catalog), list(pr.CHECKED_FIELDS), "checked string, role string")
    targets = checks.where(F.col("checked") == F.col("canonical_field"))
    roles = role_cands.groupBy("store_id", "role", F.col("source_path").alias("table_path")).agg(
        F.max("confidence").cast("double").alias("role_confidence"))
    return targets.join(roles, ["store_id", "role", "table_path"], "left").select(
        "store_id", "canonical_field", "source_path", "table_path", "column", "type",
        F.col("confidence").cast("double").alias("mapping_confidence"),
        F.coalesce("role_confidence", F.lit(0.0)).alias("role_confidence"))


def profile_learned(targets: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One report per target, one aggregation per table.

    ``tables`` are the stores' tables by table path.  A table with ``store_id`` is
    aggregated per store; one without is shared by the stores that map it.  Targets whose
    table or column is absent get a failed report.  Only the distinct (field,
    table, column, type) combinations, that is, the distinct schemas, come to the driver.
    """
    shapes = targets.select("canonical_field", "table_path", "column", "type").distinct().collect()
    reports = []
    for path in sorted({s["table_path"] for s in shapes}):
        df = tables.get(path)
        checks = sorted((s for s in shapes if s["table_path"] == path), key=lambda s: (s["canonical_field"], s["column"]))
        stats = None
        if df is not None:
            aggs: dict[str, Column] = {}
            for s in checks:
                if s["column"] in df.columns:
                    aggs.update(pr._aggs(s["column"], pr._kind_for(s["canonical_field"]), s["type"].lower() in pr.NUMERIC_TYPES))
            counts = [c.alias(n) for n, c in aggs.items()]
            if counts:
                stats = df.groupBy("store_id").agg(*counts) if "store_id" in df.columns else df.agg(*counts).withColumn("_all", F.lit(1))
        for s in checks:
            own = targets.where((F.col("canonical_field") == s["canonical_field"]) & (F.col("table_path") == path)
                                & (F.col("column") == s["column"]) & F.col("type").eqNullSafe(s["type"]))
            if stats is None or s["column"] not in df.columns:
                blank = [f for f in pr.REPORT_SCHEMA.fieldNames() if f not in ("canonical_field", "source_path", "passed", "confidence", "basis")]
                reports.append(own.select(
                    "store_id", "canonical_field", "source_path", F.lit(False).alias("passed"), F.col("mapping_confidence").alias("confidence"),
                    F.lit(pr.BASIS_FAILED).alias("basis"), *[F.lit(None).cast(pr.REPORT_SCHEMA[f].dataType).alias(f) for f in blank]))
                continue
            key = ["store_id"] if "store_id" in df.columns else ["_all"]
            joined = own.withColumn("_all", F.lit(1)).join(stats, key, "left").fillna(0, [c for c in stats.columns if c.startswith("__")])
            report = pr._report(s["column"], pr._kind_for(s["canonical_field"]), s["canonical_field"],
                                s["type"].lower() in pr.NUMERIC_TYPES, F.col("role_confidence"), F.col("mapping_confidence"),
                                f"{path}.{s['column']}")
            reports.append(joined.select("store_id", report.alias("r")).select("store_id", "r.*"))
    out = None
    for r in reports:
        out = r if out is None else out.unionByName(r)
    return out


def resolve_promoted(questions: DataFrame, promoted: DataFrame) -> DataFrame:
    """Verify questions of promoted mappings become resolved, answered with the mapped path."""
    done = promoted.where(F.col("verification_basis").isNotNull()).select(
        "store_id", F.concat(F.lit("verify:"), F.col("canonical_field")).alias("key"), F.col("source_path").alias("_path"))
    j = questions.join(done, ["store_id", "key"], "left")
    hit = F.col("_path").isNotNull()
    return j.select(*[c for c in questions.columns if c not in ("resolved", "answer", "resolved_by")],
                    (hit | F.coalesce("resolved", F.lit(False))).alias("resolved"), F.col("_path").alias("answer"),
                    F.when(hit, F.lit(RESOLVED_BY)).alias("resolved_by"))


def validation_round(mappings: DataFrame, questions: DataFrame, stores: DataFrame, catalog: DataFrame, role_cands: DataFrame,
                     tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Targets, reports, promoted mappings, resolved questions and refreshed readiness."""
    targets = learned_targets(mappings, catalog, role_cands)
    reports = profile_learned(targets, tables)
    promoted = pr.promote_mappings(mappings, reports)
    resolved = resolve_promoted(questions, promoted)
    return {"targets": targets, "reports": reports, "mappings": promoted, "questions": resolved,
            "readiness": co.readiness(promoted, resolved, stores)}


# --- the operational round -------------------------------------------------------

def operational_round(stores: DataFrame, sources: dict[str, Callable[[], DataFrame]], ledger: DataFrame | None,
                      primed: DataFrame | None, now: str, cycle_id: str, backfill: bool = False,
                      steps: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] | None = None) -> dict[str, DataFrame]:
    """One round over every source: prime or ingest, evaluate, log, then the ``steps``.

    ``sources`` give poll items by connector name.  Each is read in an action of its
    own, into the shared checkpoint folder; one that fails, while it is built or while it
    runs, is logged as an error of every store and the others go on.  ``primed`` holds the
    (store_id, connector) pairs that had a first round.  A pair without one only has
    its ids remembered, unless ``backfill`` asks for its history.  ``steps`` (for
    example snapshots and proofs) take what the round has made and give a table each;
    one that fails is logged in the same way and leaves its table out.  Where every source
    fails, nothing is polled and the ledger and the primed pairs stay what they were.
    Returns evidence, events, tasks, rejected items, the new ledger and primed pairs, the
    steps' tables, the log and its health.
    """
    spark = stores.sparkSession
    polls, errors = None, []
    for name, poll in sources.items():
        try:
            df = poll()
            df = df.select("*", F.lit(name).alias("connector")) if "connector" not in df.columns else df
            df = cut_lineage(df)
        except Exception as exc:  # noqa: BLE001 - one source must not stop the round; the log keeps its type
            errors.append((name, type(exc).__name__))
            continue
        polls = df if polls is None else polls.unionByName(df, allowMissingColumns=True)
    failed = lambda: with_rules(stores.select("store_id"), errors, "component string, error string").select(
        "store_id", F.lit("error").alias("kind"), "component")
    log = spark.createDataFrame([], "store_id string, kind string, component string")
    polls = spark.createDataFrame([], POLL_ITEM) if polls is None else polls
    pair = ["store_id", "connector"]
    if backfill:
        known, first = polls, polls.limit(0)
    elif primed is None:
        known, first = polls.limit(0), polls
    else:
        known, first = polls.join(primed.select(*pair), pair, "left_semi"), polls.join(primed.select(*pair), pair, "left_anti")
    baseline, _ = prime_ledger(first, ledger)
    fresh, _ = new_evidence(known, ledger)
    evidence, rejected = normalize_evidence(fresh, now)
    events, tasks = evaluate_workflows(facts_to_events(evidence))
    seen = evidence.select("store_id", F.col("source").alias("connector"), "external_id").unionByName(baseline)
    after = seen if ledger is None else ledger.select(*LEDGER_KEY).unionByName(seen)
    pairs = polls.select(*pair).distinct()
    part = lambda df, kind: df.select("store_id", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("component"))
    log = log.unionByName(part(evidence, "import")).unionByName(part(baseline, "primed")).unionByName(part(events, "event"))
    made = {"evidence": evidence, "events": events, "tasks": tasks, "rejected": rejected, "ledger": after,
            "primed": pairs if primed is None else primed.select(*pair).union(pairs).distinct()}
    for name, step in (steps or {}).items():
        try:
            made[name] = cut_lineage(step(made))
        except Exception as exc:  # noqa: BLE001 - a report must not undo the round; the log keeps its type
            errors.append((name, type(exc).__name__))
    log = log.unionByName(failed()) if errors else log
    return made | {"log": log, "health": cycle_health(log.withColumn("cycle_id", F.lit(cycle_id)))}


def report_steps(window_minutes: int = 15) -> dict[str, Callable[[dict[str, DataFrame]], DataFrame]]:
    """Snapshot and proofs of what a round has made, as ``steps`` of ``operational_round``."""
    def evidence(made: dict[str, DataFrame]) -> DataFrame:
        return made["evidence"].withColumn("payload", F.lit(None).cast("string")) if "payload" not in made["evidence"].columns else made["evidence"]

    def proofs(made: dict[str, DataFrame]) -> DataFrame:
        return operation_proofs(made["events"], evidence(made), made["tasks"], window_minutes)

    return {"snapshot": lambda made: operational_snapshot(evidence(made), made["events"], made["tasks"], None, window_minutes), "proofs": proofs}


# --- audit -------------------------------------------------------------------------

def _audit(df: DataFrame, action: str, actor: Column, target: Column, detail: Column, at: Column) -> DataFrame:
    key = F.concat_ws("|", F.lit(action), F.col("store_id"), target, at)
    return df.select("store_id", F.concat(F.lit("aud_"), F.sha2(key, 256)).alias("id"), F.lit(action).alias("action"), actor.alias("actor"),
                     target.alias("target"), detail.alias("detail"), at.alias("created_at"))


def audit_answers(confirmations: DataFrame) -> DataFrame:
    """A row per accepted answer, from the confirmation evidence of ``answer_tasks``."""
    return _audit(confirmations, "task_answered", F.col("source"), F.get_json_object("payload", "$.task_id"),
                  F.to_json(F.struct(F.col("id").alias("confirmation_evidence_id"))), F.col("occurred_at"))


def audit_actions(actions: DataFrame) -> DataFrame:
    """Rows for requests, approvals and executions, from ``action_status``."""
    requested = _audit(actions, "action_requested", F.lit("engine"), F.col("id"),
                       F.to_json(F.struct("authority", F.col("initial_status").alias("status"))), F.col("requested_at"))
    approved = _audit(actions.where("approved_at is not null"), "action_approved", F.col("approved_by"), F.col("id"), F.lit("{}"), F.col("approved_at"))
    executed = _audit(actions.where("executed_at is not null"), "action_executed", F.lit("executor"), F.col("id"), F.lit("{}"), F.col("executed_at"))
    return requested.unionByName(approved).unionByName(executed)


def audit_events(events: DataFrame) -> DataFrame:
    """A row per evaluated event, from ``evaluate_workflows``."""
    return _audit(events, "event_evaluated", F.lit("engine"), F.col("id"),
                  F.to_json(F.struct("event_type", F.col("task_count").alias("tasks_created"))), F.col("occurred_at"))


def audit_evidence(evidence: DataFrame) -> DataFrame:
    """A row per recorded evidence, from ``normalize_evidence``."""
    return _audit(evidence, "evidence_recorded", F.col("source"), F.col("id"), F.to_json(F.struct("kind", "confidence")), F.col("occurred_at"))


# --- health ------------------------------------------------------------------------

def health_actions(health: DataFrame, active: DataFrame, now: str) -> DataFrame:
    """One authorisation request per store whose collector is not live, unless one is active."""
    text = F.concat(F.lit("Collector state "), F.col("state"), F.lit(": the owner has to allow a start."))
    requests = health.where(~F.col("live_camera_ready")).select(
        F.concat(F.lit("act_"), F.sha2(F.concat_ws("|", "store_id", F.lit(COLLECTOR_ACTION), F.lit(now)), 256)).alias("id"), "store_id",
        F.lit(COLLECTOR_ACTION).alias("action"), F.lit(COLLECTOR_TARGET).alias("target"), text.alias("reason"),
        F.lit(COLLECTOR_AUTHORITY).alias("authority"), F.lit(now).alias("requested_at"))
    return open_action_dedupe(active, requests).withColumn("status", classify_action("authority"))
