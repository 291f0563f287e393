"""Registered compositions: mapping validation, the operational round, audit rows and health actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.operators import catalog as co
from storelens.operators import state
from storelens.operators.records import audit_log
from storelens.plans import operations as ops
from storelens.plans.queries import CYCLE_NOW, _events_with_status, _items, _prior_ledger, _questions, register
from storelens.plans.queries_state import fx_actions, fx_answers, q_collector_health
from storelens.sources import catalog_fixture as cf
from storelens.sources import collector_fixture as cfx
from storelens.sources import collectors as col
from storelens.sources import fixtures as fx

ROUND_ID = "round-1"
SQL_CONNECTOR, CAMERA_CONNECTOR, BROKEN_CONNECTOR = "sqlserver_operational_facts", "local_camera_events", "broken_source"


def _validation(spark, sf_dir):
    mappings, questions, stores = _questions(spark, sf_dir)
    catalog = cf.fx_catalog(spark, sf_dir)
    cands = co.role_candidates(co.score_table_roles(catalog), None)
    return ops.validation_round(mappings, questions, stores, catalog, cands, cf.fx_sql_tables(spark, sf_dir))


@register("validate_mappings")
def q_validate_mappings(spark, sf_dir):
    return _validation(spark, sf_dir)["reports"]


@register("promote_mappings")
def q_promote_mappings(spark, sf_dir):
    """The proposed mappings of every store after the round that checks them."""
    return _validation(spark, sf_dir)["mappings"].select(
        "store_id", "canonical_field", "source_path", "confidence", "reasoning", "verified", "verification_basis")


@register("validation_questions")
def q_validation_questions(spark, sf_dir):
    return _validation(spark, sf_dir)["questions"].select("store_id", "key", "resolved", "answer", "resolved_by")


@register("validation_readiness")
def q_validation_readiness(spark, sf_dir):
    return _validation(spark, sf_dir)["readiness"]


def _round(spark, sf_dir):
    def broken():
        # Fails in its tasks, when the rows are read.
        return spark.range(10).select(
            F.concat(F.lit("store_"), F.col("id")).alias("store_id"), F.lit(BROKEN_CONNECTOR).alias("connector"),
            F.when(F.col("id") >= 0, F.raise_error("the source is down")).cast("string").alias("external_id"))

    stores = spark.range(10).select(F.concat(F.lit("store_"), F.col("id").cast("string")).alias("store_id"))
    pair = lambda n, c: stores.where(F.substring("store_id", 7, 1).cast("int") < n).select("store_id", F.lit(c).alias("connector"))
    sources = {
        SQL_CONNECTOR: lambda: _items(spark, sf_dir),
        CAMERA_CONNECTOR: lambda: col.scan_camera_events(cfx.fx_camera_tables(spark, sf_dir)),
        BROKEN_CONNECTOR: broken,
    }
    primed = pair(7, SQL_CONNECTOR).unionByName(pair(4, CAMERA_CONNECTOR))
    return ops.operational_round(stores, sources, _prior_ledger(spark, sf_dir), primed, CYCLE_NOW, ROUND_ID)


@register("operational_round")
def q_operational_round(spark, sf_dir):
    return _round(spark, sf_dir)["health"]


@register("operational_round_ledger")
def q_operational_round_ledger(spark, sf_dir):
    return _round(spark, sf_dir)["ledger"].groupBy("store_id", "connector").agg(F.count(F.lit(1)).alias("ids"))


@register("operation_audit")
def q_operation_audit(spark, sf_dir):
    _, confirmations, _ = state.answer_tasks(fx.fx_task(spark, sf_dir).drop("n"), fx_answers(spark, sf_dir))
    req, dec = fx_actions(spark, sf_dir)
    actions, _ = state.action_status(req.drop("n"), dec)
    rows = ops.audit_answers(confirmations).unionByName(ops.audit_actions(actions)).unionByName(
        ops.audit_events(_events_with_status(spark, sf_dir)))
    return audit_log(rows)


@register("health_actions")
def q_health_actions(spark, sf_dir):
    health = q_collector_health(spark, sf_dir)
    active = health.where(F.regexp_extract("store_id", "([0-9]+)", 1).cast("int") % 3 == 0).select(
        "store_id", F.lit(ops.COLLECTOR_ACTION).alias("action"), F.lit(ops.COLLECTOR_TARGET).alias("target"),
        F.lit("pending_approval").alias("status"))
    return ops.health_actions(health, active, CYCLE_NOW)
