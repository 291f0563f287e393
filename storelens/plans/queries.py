"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver tables (through the ``fx_*`` projections) so its
work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storelens.operators import facts as facts_ops
from storelens.session import bound_tasks, staged
from storelens.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    """Register a query; it runs with the session zone pinned to UTC (ISO text
    without an offset is read as UTC, matching the oracle) and with bounded tasks."""
    import functools

    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            bound_tasks(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        return fn

    return deco


@register("extract_line_facts")
def q_extract_line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    header, line, product = fx.fx_line_tables(spark, sf_dir)
    return facts_ops.extract_line_facts(header, line, product, facts_ops.fixture_plan())


@register("extract_line_facts_recent")
def q_extract_line_facts_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    header, line, product = fx.fx_line_tables(spark, sf_dir)
    return facts_ops.extract_line_facts(header, line, product, facts_ops.fixture_plan(), limit=5)


@register("nearest_observation")
def q_nearest_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storelens.operators.correlate import nearest_observation

    return nearest_observation(fx.fx_evidence(spark, sf_dir), 15)


def _wf_tasks(spark: SparkSession, sf_dir: str, event_type: str | None) -> DataFrame:
    from storelens.operators.workflows import workflow_tasks

    return workflow_tasks(fx.fx_facts(spark, sf_dir), event_type).drop("answer")


@register("evaluate_workflows")
def q_evaluate_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wf_tasks(spark, sf_dir, None)


def _make_wf(et: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _wf_tasks(spark, sf_dir, et)

    q.__name__ = f"q_wf_{et}"
    return q


for _et in ("receiving", "stock_movement", "damage", "expiry", "attendance", "sale", "purchase", "return", "stock_count"):
    register(f"wf_{_et}")(_make_wf(_et))


@register("wf_unsupported")
def q_wf_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from storelens.operators.workflows import workflow_tasks

    ev = fx.fx_facts(spark, sf_dir).withColumn(
        "event_type", F.when(F.col("k") % 17 == 0, F.lit("inventory_audit")).otherwise(F.col("event_type"))
    )
    return workflow_tasks(ev, "unsupported").drop("answer")


@register("event_status")
def q_event_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storelens.operators.workflows import evaluate_workflows

    events, _ = evaluate_workflows(fx.fx_facts(spark, sf_dir))
    return events.select("id", "store_id", "event_type", "task_count", "status")


def _events_with_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storelens.operators.workflows import evaluate_workflows

    events, _ = evaluate_workflows(fx.fx_facts(spark, sf_dir))
    return events


@register("evidence_counts")
def q_evidence_counts(spark, sf_dir):
    from storelens.operators.evidence import evidence_counts

    return evidence_counts(fx.fx_evidence(spark, sf_dir))


@register("source_freshness")
def q_source_freshness(spark, sf_dir):
    from storelens.operators.evidence import source_freshness

    return source_freshness(fx.fx_all_evidence(spark, sf_dir))


@register("event_counts")
def q_event_counts(spark, sf_dir):
    from storelens.operators.evidence import event_counts

    return event_counts(fx.fx_op_event(spark, sf_dir))


@register("event_status_counts")
def q_event_status_counts(spark, sf_dir):
    from storelens.operators.evidence import event_status_counts

    return event_status_counts(_events_with_status(spark, sf_dir))


@register("open_tasks_by_role")
def q_open_tasks_by_role(spark, sf_dir):
    from storelens.operators.evidence import open_tasks_by_role

    return open_tasks_by_role(fx.fx_task(spark, sf_dir))


@register("corroboration_coverage")
def q_corroboration_coverage(spark, sf_dir):
    from storelens.operators.correlate import nearest_observation
    from storelens.operators.evidence import corroboration_coverage

    ev = fx.fx_evidence(spark, sf_dir)
    return corroboration_coverage(ev, nearest_observation(ev, 15))


@register("latest_source_gap")
def q_latest_source_gap(spark, sf_dir):
    from storelens.operators.evidence import latest_source_gap

    return latest_source_gap(fx.fx_evidence(spark, sf_dir))


@register("operational_snapshot")
def q_operational_snapshot(spark, sf_dir):
    from storelens.plans.snapshot import operational_snapshot

    return operational_snapshot(
        fx.fx_evidence(spark, sf_dir), _events_with_status(spark, sf_dir), fx.fx_task(spark, sf_dir), None, 15
    )


@register("nearest_camera")
def q_nearest_camera(spark, sf_dir):
    from storelens.operators.correlate import nearest_camera

    from pyspark.sql import functions as F

    ev = fx.fx_op_event(spark, sf_dir).select("id", "store_id", "occurred_at")
    return nearest_camera(ev, fx.fx_evidence(spark, sf_dir), 15).select(
        "id", "store_id", "camera_observation_id", F.col("camera_diff_us").alias("camera_time_difference_us"))


@register("link_evidence")
def q_link_evidence(spark, sf_dir):
    from storelens.operators.proofs import link_evidence

    return link_evidence(fx.fx_op_event(spark, sf_dir), fx.fx_all_evidence(spark, sf_dir))


@register("check_evidence_refs")
def q_check_evidence_refs(spark, sf_dir):
    from pyspark.sql import functions as F

    from storelens.operators.proofs import check_evidence_refs

    events = fx.fx_op_event(spark, sf_dir).withColumn(
        "evidence_ids",
        F.when(F.col("n") % 5 == 0, F.col("evidence_ids")).otherwise(
            F.filter("evidence_ids", lambda x: x != "evd_missing")),
    )
    ok, rejected = check_evidence_refs(events, fx.fx_all_evidence(spark, sf_dir))
    return ok.select("id", "store_id", F.lit(True).alias("refs_ok")).unionByName(
        rejected.select("id", "store_id", F.lit(False).alias("refs_ok")))


@register("task_confirmations")
def q_task_confirmations(spark, sf_dir):
    from storelens.operators.proofs import task_confirmations

    return task_confirmations(fx.fx_task(spark, sf_dir), fx.fx_all_evidence(spark, sf_dir)).drop("created_at")


@register("operation_proofs")
def q_operation_proofs(spark, sf_dir):
    from storelens.operators.proofs import operation_proofs, proofs_report

    return proofs_report(operation_proofs(
        fx.fx_op_event(spark, sf_dir), fx.fx_all_evidence(spark, sf_dir), fx.fx_task(spark, sf_dir), 15))


@register("proof_state_counts")
def q_proof_state_counts(spark, sf_dir):
    from storelens.operators.proofs import operation_proofs, proof_state_counts

    return proof_state_counts(operation_proofs(
        fx.fx_op_event(spark, sf_dir), fx.fx_all_evidence(spark, sf_dir), fx.fx_task(spark, sf_dir), 15))


# --- catalog -----------------------------------------------------------------

def _cat(spark, sf_dir):
    from storelens.sources import catalog_fixture as cf

    return cf.fx_catalog(spark, sf_dir), cf.fx_stores(spark, sf_dir), cf.fx_contracts(spark, sf_dir)


def _dbl(df, *cols):
    for c in cols:
        df = df.withColumn(c, df[c].cast("double"))
    return df


def _mappings(spark, sf_dir):
    from storelens.operators import catalog as co

    cat, stores, contracts = _cat(spark, sf_dir)
    scores = co.score_mappings(cat)
    return cat, stores, contracts, scores, co.apply_contracts(co.propose_mappings(scores, stores), contracts)


@register("score_mappings")
def q_score_mappings(spark, sf_dir):
    from storelens.operators import catalog as co

    cat, _, _ = _cat(spark, sf_dir)
    return _dbl(co.score_mappings(cat).select("store_id", "canonical_field", "path", "score"), "score")


@register("mapping_candidates")
def q_mapping_candidates(spark, sf_dir):
    from storelens.operators import catalog as co

    cat, _, _ = _cat(spark, sf_dir)
    return _dbl(co.mapping_candidates(co.score_mappings(cat)).select(
        "store_id", "canonical_field", "rank", "path", "score"), "score")


_MAP_COLS = ("store_id", "canonical_field", "source_path", "confidence", "reasoning", "verified")


@register("propose_mappings")
def q_propose_mappings(spark, sf_dir):
    from storelens.operators import catalog as co

    cat, stores, _ = _cat(spark, sf_dir)
    return _dbl(co.propose_mappings(co.score_mappings(cat), stores).select(*_MAP_COLS), "confidence")


@register("apply_contracts")
def q_apply_contracts(spark, sf_dir):
    return _dbl(_mappings(spark, sf_dir)[4].select(*_MAP_COLS), "confidence")


def _questions(spark, sf_dir):
    from storelens.operators import catalog as co

    cat, stores, contracts, scores, mappings = _mappings(spark, sf_dir)
    return mappings, co.setup_questions(mappings, scores, stores), stores


@register("setup_questions")
def q_setup_questions(spark, sf_dir):
    from pyspark.sql import functions as F

    _, q, _ = _questions(spark, sf_dir)
    return q.select("store_id", "key", "prompt", "reason", F.array_join("options", "|").alias("options"), "resolved")


@register("readiness")
def q_readiness(spark, sf_dir):
    from storelens.operators import catalog as co

    mappings, q, stores = _questions(spark, sf_dir)
    return co.readiness(mappings, q, stores)


def _role_scores(spark, sf_dir):
    from storelens.operators import catalog as co

    cat, stores, contracts = _cat(spark, sf_dir)
    return cat, stores, contracts, co.score_table_roles(cat)


@register("score_table_roles")
def q_score_table_roles(spark, sf_dir):
    from pyspark.sql import functions as F

    rs = _role_scores(spark, sf_dir)[3]
    return _dbl(rs.select("store_id", "role", "source_path", "confidence",
                          F.array_join("evidence", " | ").alias("evidence"), "row_count"), "confidence")


@register("role_candidates")
def q_role_candidates(spark, sf_dir):
    from storelens.operators import catalog as co

    rs = _role_scores(spark, sf_dir)[3]
    return _dbl(co.role_candidates(rs).select("store_id", "role", "rank", "source_path", "confidence", "row_count"),
                "confidence")


def _inferred(spark, sf_dir):
    from storelens.operators import catalog as co

    cat, stores, contracts, rs = _role_scores(spark, sf_dir)
    return co.infer_relationships(co.role_candidates(rs), cat)


@register("infer_relationships")
def q_infer_relationships(spark, sf_dir):
    return _inferred(spark, sf_dir)


@register("all_relationships")
def q_all_relationships(spark, sf_dir):
    from storelens.operators import catalog as co
    from storelens.sources import catalog_fixture as cf

    return co.all_relationships(cf.fx_declared_relationships(spark, sf_dir), _inferred(spark, sf_dir))


@register("capabilities")
def q_capabilities(spark, sf_dir):
    from storelens.operators import catalog as co

    cat, stores, contracts, rs = _role_scores(spark, sf_dir)
    return co.capabilities(co.role_candidates(rs), contracts, stores)


@register("schema_totals")
def q_schema_totals(spark, sf_dir):
    from storelens.operators import catalog as co
    from storelens.sources import catalog_fixture as cf

    cat = cf.fx_catalog(spark, sf_dir)
    rels = co.all_relationships(cf.fx_declared_relationships(spark, sf_dir), _inferred(spark, sf_dir))
    return co.schema_totals(cat, rels, _channels(spark, sf_dir))


def _channels(spark, sf_dir):
    from storelens.sources.collector_fixture import fx_catalog_cameras
    from storelens.sources.collectors import camera_registry

    return camera_registry(fx_catalog_cameras(spark, sf_dir))


@register("rank_databases")
def q_rank_databases(spark, sf_dir):
    from storelens.operators import catalog as co

    cat, stores, contracts, rs = _role_scores(spark, sf_dir)
    cat = cat.join(stores.select("store_id", "server"), "store_id")
    return co.rank_databases(rs, cat, "server")


@register("mapping_targets")
def q_mapping_targets(spark, sf_dir):
    from storelens.operators import catalog as co

    cat, stores, contracts, scores, mappings = _mappings(spark, sf_dir)
    return co.mapping_targets(mappings, cat).select(
        "store_id", "canonical_field", "source_path", "table_path", "column", "type")


# --- ingestion ---------------------------------------------------------------
PRIOR_POLL_BEFORE = "1997-01-01"
CYCLE_NOW = "2026-01-01T00:00:00"


def _items(spark, sf_dir):
    from storelens.operators.ingest import line_fact_items

    header, line, product = fx.fx_line_tables(spark, sf_dir)
    return line_fact_items(facts_ops.extract_line_facts(header, line, product, facts_ops.fixture_plan()))


def _prior_ledger(spark, sf_dir, items=None):
    """Ids of an earlier poll: what the connector had before PRIOR_POLL_BEFORE."""
    from pyspark.sql import functions as F

    from storelens.operators.ingest import prime_ledger

    items = _items(spark, sf_dir) if items is None else items
    return prime_ledger(items.where(F.col("occurred_at") < PRIOR_POLL_BEFORE), None)[1]


def _polled(spark, sf_dir):
    """(items, ledger of the earlier poll); the items are extracted once for both."""
    items = staged(_items(spark, sf_dir))
    return items, _prior_ledger(spark, sf_dir, items)


@register("prime_ledger")
def q_prime_ledger(spark, sf_dir):
    from storelens.operators.ingest import prime_ledger

    return prime_ledger(_items(spark, sf_dir), None)[0]


@register("new_evidence")
def q_new_evidence(spark, sf_dir):
    from storelens.operators.ingest import new_evidence

    return new_evidence(*_polled(spark, sf_dir))[0]


@register("normalize_evidence")
def q_normalize_evidence(spark, sf_dir):
    from storelens.operators.ingest import new_evidence, normalize_evidence

    fresh = new_evidence(*_polled(spark, sf_dir))[0]
    return normalize_evidence(fresh, CYCLE_NOW)[0]


@register("facts_to_events")
def q_facts_to_events(spark, sf_dir):
    from pyspark.sql import functions as F

    from storelens.operators.ingest import facts_to_events, new_evidence, normalize_evidence

    fresh = new_evidence(*_polled(spark, sf_dir))[0]
    ev = facts_to_events(normalize_evidence(fresh, CYCLE_NOW)[0])
    return ev.select("id", "store_id", "event_type", "occurred_at", F.col("evidence_ids")[0].alias("evidence_id"),
                     *[F.col("facts").getField(f).alias(f) for f in (
                         "mapping_verified", "product_id", "quantity", "pack_size", "destination_id",
                         "receiver_confirmed", "source_record_hash")])


@register("operational_cycle")
def q_operational_cycle(spark, sf_dir):
    from storelens.operators.ingest import operational_cycle

    out = operational_cycle(*_polled(spark, sf_dir), CYCLE_NOW)
    return out["tasks"].drop("answer")


# --- shape checks ------------------------------------------------------------

def _targets():
    from storelens.operators.profile import ShapeTarget

    return {
        "identity": ShapeTarget("product.identity", "tpch.part.p_partkey", "p_partkey", "identity", 0.96, 0.98),
        "quantity": ShapeTarget("purchase.quantity", "tpch.lineitem.l_quantity", "l_quantity", "numeric", 0.96, 0.98),
        "pack": ShapeTarget("product.pack_size", "tpch.part.p_size", "p_size", "numeric", 0.96, 0.98),
        "acctbal": ShapeTarget("product.pack_size", "tpch.customer.c_acctbal", "c_acctbal", "numeric", 0.96, 0.98),
        "ptype": ShapeTarget("product.pack_size", "tpch.part.p_type", "p_type", "numeric", 0.96, 0.98, "nvarchar"),
        "destination": ShapeTarget("movement.destination", "tpch.lineitem.l_suppkey", "l_suppkey", "destination", 0.96, 0.98),
    }


def _tables(spark, sf_dir):
    from storelens.sources.tables import table

    return {f"tpch.{n}": table(spark, sf_dir, n) for n in ("part", "lineitem", "customer")}


@register("identity_shape")
def q_identity_shape(spark, sf_dir):
    from storelens.operators.profile import profile_table

    return profile_table(_tables(spark, sf_dir)["tpch.part"], [_targets()["identity"]])


@register("identity_shape_by_store")
def q_identity_shape_by_store(spark, sf_dir):
    from pyspark.sql import functions as F

    from storelens.operators.profile import ShapeTarget, profile_table
    from storelens.sources.tables import table

    # A line's store is its order's, which only the order's customer tells.
    owners = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("store_"), (F.col("o_custkey") % 10).cast("string")).alias("store_id"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey").join(owners.hint("merge"), "l_orderkey")
    t = ShapeTarget("product.identity", "tpch.lineitem.l_orderkey", "l_orderkey", "identity", 0.96, 0.98)
    return profile_table(lines, [t], by=["store_id"])


@register("numeric_shape")
def q_numeric_shape(spark, sf_dir):
    from storelens.operators.profile import profile_table

    tb, tg = _tables(spark, sf_dir), _targets()
    return (profile_table(tb["tpch.lineitem"], [tg["quantity"]])
            .unionByName(profile_table(tb["tpch.part"], [tg["pack"], tg["ptype"]]))
            .unionByName(profile_table(tb["tpch.customer"], [tg["acctbal"]])))


@register("destination_shape")
def q_destination_shape(spark, sf_dir):
    from storelens.operators.profile import profile_table

    return profile_table(_tables(spark, sf_dir)["tpch.lineitem"], [_targets()["destination"]])


@register("profile_mappings")
def q_profile_mappings(spark, sf_dir):
    from storelens.operators.profile import ShapeTarget, profile_mappings

    tg = _targets()
    ghost = ShapeTarget("movement.destination", "tpch.transfers.to_location", "to_location", "destination", 0.96, 0.98)
    return profile_mappings(_tables(spark, sf_dir), [tg["identity"], tg["quantity"], tg["pack"], tg["destination"], ghost])


@register("staff_role_counts")
def q_staff_role_counts(spark, sf_dir):
    from pyspark.sql import functions as F

    from storelens.operators.profile import staff_role_counts
    from storelens.sources.tables import table

    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("store_"), F.col("c_nationkey").cast("string")).alias("store_id"), "c_mktsegment")
    return staff_role_counts(c, "c_mktsegment", by=["store_id"])


@register("resolve_fact_plan")
def q_resolve_fact_plan(spark, sf_dir):
    from storelens.operators import catalog as co
    from storelens.operators.factplan import resolve_fact_plan
    from storelens.sources import catalog_fixture as cf

    cat, stores, contracts, scores, mappings = _mappings(spark, sf_dir)
    cands = co.role_candidates(co.score_table_roles(cat), None)
    rels = co.all_relationships(cf.fx_declared_relationships(spark, sf_dir), co.infer_relationships(cands, cat))
    return resolve_fact_plan(cands, rels, mappings, cat)


@register("learned_line_facts")
def q_learned_line_facts(spark, sf_dir):
    """Catalog to plan to facts: every store's lines by the plan learned from its own catalog."""
    from storelens.session import cut_lineage
    from storelens.sources.catalog_fixture import SHARED_TABLES, fx_sql_tables

    # The learned plans are stored state: resolved once, then read per schema.
    plans = cut_lineage(q_resolve_fact_plan(spark, sf_dir))
    return facts_ops.extract_learned_facts(plans, fx_sql_tables(spark, sf_dir), shared=SHARED_TABLES)


@register("carry_forward_mappings")
def q_carry_forward_mappings(spark, sf_dir):
    from pyspark.sql import functions as F

    from storelens.operators import catalog as co

    cat, stores, contracts, scores, mappings = _mappings(spark, sf_dir)
    k = F.substring("store_id", 5, 20).cast("bigint")
    previous = mappings.withColumn("verified", F.col("verified") | (k % 5 == 0))
    rescanned = cat.where(~((F.col("column") == "GodownNo") & (F.substring("store_id", 5, 20).cast("bigint") % 10 == 0)))
    scores2 = co.score_mappings(rescanned)
    current = co.apply_contracts(co.propose_mappings(scores2, stores), contracts)
    out = co.carry_forward_mappings(current, previous, rescanned)
    return out.select("store_id", "canonical_field", "source_path", F.col("confidence").cast("double").alias("confidence"),
                      "reasoning", "verified")


@register("structural_confidence")
def q_structural_confidence(spark, sf_dir):
    plans = q_resolve_fact_plan(spark, sf_dir)
    return plans.where("plan_ok").select("store_id", "operation", "structural_confidence", "mapping_verified")
