"""Evidence ingestion and the operational cycle.

Poll items (``store_id, connector, external_id, occurred_at, kind, confidence,
payload``) are deduplicated against a seen-ledger keyed by (store, connector,
external_id).  The ledger anti-join is an equi-join on that key.  The ledger is
unbounded: an id is never imported twice, however old it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.scalar import clamp_confidence
from storelens.operators.payload import FLAT_FACTS, as_variant, with_flat_facts
from storelens.schemas import EVIDENCE_KINDS

LEDGER_KEY = ("store_id", "connector", "external_id")


def _first_per_key(items: DataFrame) -> DataFrame:
    """First occurrence per (store, connector, external_id): the smallest by occurred_at text,
    then by every other column.  An aggregation with partial minima, so a key that
    comes in many times is reduced before the shuffle."""
    rest = ["occurred_at", *sorted(c for c in items.columns if c not in LEDGER_KEY and c != "occurred_at")]
    first = items.groupBy(*LEDGER_KEY).agg(F.min(F.struct(*rest)).alias("_first"))
    return first.select(*[F.col(c) if c in LEDGER_KEY else F.col(f"_first.`{c}`").alias(c) for c in items.columns])


def _clean_ids(items: DataFrame) -> DataFrame:
    ext = F.trim(F.coalesce(F.col("external_id").cast("string"), F.lit("")))
    return items.withColumn("external_id", ext).where(F.col("external_id") != "")


def new_evidence(items: DataFrame, ledger: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(new items, updated ledger): items whose id the ledger has not seen, first occurrence wins.

    One aggregation and one anti-join, both on the ledger key.
    """
    first = _first_per_key(_clean_ids(items))
    if ledger is None:
        return first, first.select(*LEDGER_KEY)
    fresh = first.join(ledger.select(*LEDGER_KEY), list(LEDGER_KEY), "left_anti")
    return fresh, ledger.select(*LEDGER_KEY).unionByName(fresh.select(*LEDGER_KEY))


def prime_ledger(items: DataFrame, ledger: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """First cycle: remember every id without emitting evidence.  Returns (primed ids, ledger)."""
    ids = _clean_ids(items).select(*LEDGER_KEY).distinct()
    primed = ids if ledger is None else ids.join(ledger.select(*LEDGER_KEY), list(LEDGER_KEY), "left_anti")
    new_ledger = primed if ledger is None else ledger.select(*LEDGER_KEY).unionByName(primed)
    return primed, new_ledger


def normalize_evidence(items: DataFrame, now: str | Column) -> tuple[DataFrame, DataFrame]:
    """Poll items -> evidence rows; (evidence, rejected).

    kind defaults to observation and must be a known kind; confidence defaults
    to 0.5 and is clamped to 0..1; a blank time becomes ``now``; the evidence
    id is derived from (store, connector, external_id) so re-runs are idempotent.
    A ``payload`` of any shape is kept as the VARIANT ``extra``, and fills the
    typed fact columns that the item doesn't carry itself.
    """
    has_payload = "payload" in items.columns
    if has_payload:
        items = with_flat_facts(items)
    now_col = now if isinstance(now, Column) else F.lit(now)
    kind = F.coalesce(F.nullif(F.trim(F.col("kind")), F.lit("")), F.lit("observation"))
    occurred = F.coalesce(F.nullif(F.trim(F.col("occurred_at").cast("string")), F.lit("")), now_col)
    staged = items.withColumn("_kind", kind)
    ok = staged.where(F.col("_kind").isin(*EVIDENCE_KINDS))
    rejected = staged.where(~F.col("_kind").isin(*EVIDENCE_KINDS)).drop("_kind")
    evid = F.concat(F.lit("evd_"), F.sha2(F.concat_ws("|", F.col("store_id"), F.col("connector"), F.col("external_id")), 256))
    payload_cols = [c for c in items.columns if c not in ("store_id", "connector", "external_id", "occurred_at",
                                                           "kind", "confidence")]
    evidence = ok.select(
        evid.alias("id"),
        "store_id",
        F.col("_kind").alias("kind"),
        F.col("connector").alias("source"),
        clamp_confidence(F.coalesce(F.col("confidence").cast("double"), F.lit(0.5))).alias("confidence"),
        occurred.alias("occurred_at"),
        "external_id",
        *[as_variant(F.col("payload")).alias("extra") if c == "payload" else F.col(c) for c in payload_cols],
    )
    return evidence, rejected


def facts_to_events(evidence: DataFrame) -> DataFrame:
    """purchase_line facts -> receiving events, sale_line -> sale events; others ignored.

    A fact column that the evidence doesn't carry counts as null: evidence of cameras alone gives no events.
    """
    absent = {name: F.lit(None).cast(kind) for name, kind in FLAT_FACTS.items() if name not in evidence.columns}
    evidence = evidence.withColumns(absent) if absent else evidence
    op = F.col("operation_type")
    ev = evidence.where(op.isin("purchase_line", "sale_line"))
    is_purchase = op == "purchase_line"
    facts = F.struct(
        F.coalesce(F.col("mapping_verified"), F.lit(False)).alias("mapping_verified"),
        F.col("product_id").alias("product_id"),
        F.col("quantity").cast("double").alias("quantity"),
        F.when(is_purchase, F.col("pack_size").cast("double")).alias("pack_size"),
        F.when(is_purchase, F.col("destination_id")).alias("destination_id"),
        F.when(is_purchase, F.lit(False)).alias("receiver_confirmed"),
        F.col("source_record_hash").alias("source_record_hash"),
    )
    return ev.select(
        F.concat(F.lit("evt_"), F.sha2(F.col("id"), 256)).alias("id"),
        "store_id",
        F.when(is_purchase, F.lit("receiving")).otherwise(F.lit("sale")).alias("event_type"),
        "occurred_at",
        F.array(F.col("id")).alias("evidence_ids"),
        facts.alias("facts"),
        *(["extra"] if "extra" in evidence.columns else []),
    )


def operational_cycle(items: DataFrame, ledger: DataFrame | None, now: str,
                      known_evidence: DataFrame | None = None) -> dict[str, DataFrame]:
    """ingest -> events -> tasks for newly imported facts only.

    Returns evidence, events (with status/summary), tasks, rejected events and
    the updated ledger.  Events built here reference only the evidence row they
    were built from, so the reference check is satisfied by construction and is
    skipped (re-deriving the evidence just to re-check it would recompute the
    whole ingest); pass ``known_evidence`` to check against a stored table.
    """
    from storelens.operators.proofs import check_evidence_refs
    from storelens.operators.workflows import evaluate_workflows

    fresh, new_ledger = new_evidence(items, ledger)
    evidence, rejected_items = normalize_evidence(fresh, now)
    events = facts_to_events(evidence)
    if known_evidence is not None:
        ok, rejected = check_evidence_refs(events, known_evidence)
    else:
        ok, rejected = events, events.limit(0)
    evaluated, tasks = evaluate_workflows(ok)
    return {
        "evidence": evidence,
        "events": evaluated,
        "tasks": tasks,
        "rejected_events": rejected,
        "rejected_items": rejected_items,
        "ledger": new_ledger,
    }


def line_fact_items(facts: DataFrame, connector: str = "sqlserver_operational_facts") -> DataFrame:
    """extract_line_facts output -> poll items (flat payload columns)."""
    return facts.select(
        "store_id", F.lit(connector).alias("connector"), "external_id", "occurred_at", "kind", "confidence",
        "operation_type", "product_id", "quantity", "pack_size", "destination_id", "source_record_hash",
        "mapping_verified",
    )
