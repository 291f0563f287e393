"""Projections of the driver tables onto the store-operations data model.

These are the ``fx_*`` views of FIXTURES.md §B: deterministic functions of
``events``, ``orders``, ``lineitem``, ``part``, ``customer`` and ``nation`` so that
every operator's work grows with the driver tables.  The DuckDB oracle builds the
same projections in SQL (``storelens/oracle_sql.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.cache import session_cached
from storelens.functions.scalar import clamp_confidence, iso_text
from storelens.schemas import ANSWER_FIELDS
from storelens.functions.cache import frame_cached
from storelens.sources.tables import table

# Fixed fixture vocabularies (FIXTURES.md §B).
EVENT_TYPES = (
    "receiving", "stock_movement", "damage", "expiry", "attendance",
    "sale", "purchase", "return", "stock_count",
)
TASK_ROLES = ("manager", "data_entry_operator", "godown_staff", "shelfer", "receiver", "deo")
LINE_STORES = 10
ANSWER_VALUES = ("yes", "no", "maybe", " True ", "Mismatch")


def _pick(values: tuple[str, ...], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _store(user_id: Column, buckets: int = 4) -> Column:
    return F.concat(F.lit("store_"), (user_id % buckets).cast("string"))


@frame_cached
def fx_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows, one per ``events`` row (ids, kinds, sources, text times)."""
    ev = table(spark, sf_dir, "events")
    et = F.col("event_type")
    kind = (
        F.when(et.isin("view", "click"), "observation")
        .when(et == "purchase", "system_record")
        .when(et == "signup", "human_confirmation")
        .when(et == "error", "manager_decision")
    )
    source = (
        F.when(et == "view", F.concat(F.lit("camera_"), (F.col("event_id") % 3).cast("string")))
        .when(et == "click", "door_sensor")
        .when(et == "purchase", "pos")
        .when(et == "signup", "staff_app")
        .when(et == "error", "manager_app")
    )
    return ev.select(
        F.concat(F.lit("evd_"), F.col("event_id").cast("string")).alias("id"),
        _store(F.col("user_id")).alias("store_id"),
        kind.alias("kind"),
        source.alias("source"),
        clamp_confidence(F.col("value") / 100).alias("confidence"),
        F.when(F.col("event_id") % 50 == 0, F.lit("unknown")).otherwise(iso_text("ts")).alias("occurred_at"),
        F.col("props").alias("payload"),
    )


@frame_cached
def fx_op_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operational events (purchase rows of ``events``) with event type and links."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    n = F.col("event_id")
    evd = F.concat(F.lit("evd_"), n.cast("string"))
    return ev.select(
        F.concat(F.lit("evt_"), n.cast("string")).alias("id"),
        _store(F.col("user_id")).alias("store_id"),
        _pick(EVENT_TYPES, n % 9).alias("event_type"),
        iso_text("ts").alias("occurred_at"),
        F.when(n % 7 == 0, F.lit(None).cast("string")).otherwise(evd).alias("evidence_id"),
        # own evidence twice, a dangling id and, on some events, the next event's evidence (often another store's)
        F.concat(F.when(n % 7 == 0, F.array(F.lit("evd_missing"))).otherwise(F.array(evd, evd, F.lit("evd_missing"))),
                 F.when(n % 9 == 4, F.array(F.concat(F.lit("evd_"), (n + 1).cast("string")))).otherwise(
                     F.array().cast("array<string>"))).alias("evidence_ids"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        n.alias("n"),
    )


def facts_struct(k: Column, n: Column) -> Column:
    """The closed fact set of FIXTURES.md §B as a typed struct."""
    d = lambda x: x.cast("double")
    null_s = F.lit(None).cast("string")
    null_d = F.lit(None).cast("double")
    null_b = F.lit(None).cast("boolean")
    return F.struct(
        F.when(n % 3 == 0, null_b).otherwise(n % 2 == 0).alias("mapping_verified"),
        F.when(k % 10 == 0, F.lit("")).when(k % 10 == 1, null_s).otherwise(F.concat(F.lit("SKU-"), k.cast("string"))).alias("product_id"),
        F.when(k % 3 == 0, null_d).otherwise(d(k % 5)).alias("cartons"),
        F.when(k % 4 == 0, F.lit(0.0)).when(k % 4 == 1, null_d).otherwise(F.lit(12.0)).alias("pack_size"),
        F.when(k % 5 == 0, null_s).otherwise(F.concat(F.lit("GD-"), (k % 5).cast("string"))).alias("destination_id"),
        F.when(k % 2 == 0, F.lit("shelf")).otherwise(F.lit("godown")).alias("destination_type"),
        (k % 6 == 0).alias("receiver_confirmed"),
        F.when(k % 7 == 0, null_s).otherwise(F.lit("GD-A")).alias("from_location"),
        F.when(k % 11 == 0, F.lit("")).otherwise(F.lit("S-1")).alias("to_location"),
        F.when(k % 8 == 0, null_d).otherwise(d(k)).alias("sent_quantity"),
        F.when(k % 9 == 0, null_d).otherwise(d(k - k % 2)).alias("received_quantity"),
        F.when(n % 5 == 0, F.lit(0.0)).when(n % 5 == 1, null_d).otherwise(d(k)).alias("quantity"),
        F.when(n % 4 == 0, null_b).otherwise(n % 4 == 1).alias("human_confirmed"),
        F.when(k % 3 == 0, F.concat(F.lit("staff-"), k.cast("string"))).alias("staff_id"),
        F.when(k % 4 == 0, F.concat(F.lit("B-"), k.cast("string"))).alias("badge_id"),
        F.when(k % 2 == 0, F.lit("camera")).otherwise(F.lit("app")).alias("source"),
        F.when(k % 6 == 1, null_d).otherwise(d(k - 50)).alias("stock_after"),
        F.when(n % 3 == 1, n % 2 == 1).otherwise(null_b).alias("approved"),
        F.when(k % 5 == 1, null_d).otherwise(d(k)).alias("expected_quantity"),
        F.when(k % 7 == 2, null_d).otherwise(d(k + k % 2)).alias("counted_quantity"),
        null_s.alias("source_record_hash"),
    )


@session_cached
def _fx_facts_col() -> Column:
    return facts_struct(F.col("k"), F.col("n"))


@frame_cached
def fx_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_op_event with its typed ``facts`` struct."""
    e = fx_op_event(spark, sf_dir)
    return e.withColumn("facts", _fx_facts_col())


@frame_cached
def fx_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verification task per operational event, open or answered."""
    e = fx_op_event(spark, sf_dir)
    n = F.col("n")
    answered = n % 3 != 0
    null_s = F.lit(None).cast("string")
    answer_values = {
        "confirmed": _pick(ANSWER_VALUES, n % 5),
        "received": F.when((n % 5 == 2) & (n % 2 == 0), F.lit("received")).otherwise(null_s),
        "evidence_id": F.concat(F.lit("cnf_"), n.cast("string")),
        "actor": F.lit("staff_app"),
    }
    answer = F.struct(*[answer_values.get(f, null_s).alias(f) for f in ANSWER_FIELDS])
    return e.select(
        F.concat(F.lit("task_"), n.cast("string")).alias("id"),
        "store_id",
        F.col("id").alias("related_event_id"),
        _pick(TASK_ROLES, n % 6).alias("role"),
        F.when(answered, F.lit("answered")).otherwise(F.lit("open")).alias("status"),
        F.when(answered, answer).alias("answer"),
        "occurred_at",
        F.col("occurred_at").alias("created_at"),
        "n",
    )


@frame_cached
def fx_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows behind task answers (some answers dangle)."""
    t = fx_task(spark, sf_dir).where((F.col("status") == "answered") & (F.col("n") % 11 != 0))
    n = F.col("n")
    return t.select(
        F.concat(F.lit("cnf_"), n.cast("string")).alias("id"),
        "store_id",
        F.when(n % 13 == 0, F.lit("manager_decision")).otherwise(F.lit("human_confirmation")).alias("kind"),
        F.lit("staff_app").alias("source"),
        F.lit(1.0).alias("confidence"),
        "occurred_at",
        F.concat(F.lit('{"task_id": "task_'), n.cast("string"), F.lit('"}')).alias("payload"),
    )


@frame_cached
def fx_all_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx_evidence(spark, sf_dir).unionByName(fx_confirmation(spark, sf_dir))


@frame_cached
def fx_line_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(header, line, product) inputs of the line-fact extraction.

    ``LINE_STORES`` stores, each with a numbering of its own: header 7 and product 10
    are in every store, and are another transaction and another product in each.
    """
    n = F.lit(LINE_STORES)
    store = lambda k: F.concat(F.lit("store_"), k.cast("string")).alias("store_id")
    own = lambda key: [store(F.col(key) % n), F.floor(F.col(key) / n).cast("bigint").alias("header_no")]
    header = table(spark, sf_dir, "orders").select(*own("o_orderkey"), "o_orderdate")
    line = table(spark, sf_dir, "lineitem").select(*own("l_orderkey"), "*")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    size = F.col("p_size")
    product = parts.select(
        store(F.col("k")), "p_partkey", (F.col("p_partkey") * n + F.col("k")).alias("product_no"),
        F.when((size + F.col("k")) % 10 == 0, F.lit(None).cast("int")).otherwise(size).alias("pack_size"))
    return header, line, product
