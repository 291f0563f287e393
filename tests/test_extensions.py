"""Extension surface: sources, provider hook, custom rules, task sink."""

import os
import tempfile

from pyspark.sql import functions as F

from storelens import extensions as ext
from storelens.operators.workflows import WorkflowRule, evaluate_workflows


def test_source_registry_and_custom_rules(spark):
    ext.register_evidence_source("door", lambda s: s.createDataFrame(
        [("s1", "x1", "2026-01-01T00:00:00")], "store_id string, external_id string, occurred_at string"))
    items = ext.poll_all(spark)
    assert items.first()["connector"] == "door"
    rules = ext.with_rules({"inventory_audit": [WorkflowRule(F.lit(True), "auditor", "Audit?", "custom")]})
    ev = spark.createDataFrame([("e", "s1", "inventory_audit", "t")], "id string, store_id string, event_type string, "
                                                                        "occurred_at string")
    _, tasks = evaluate_workflows(ev, rules)
    assert [r["role"] for r in tasks.collect()] == ["auditor"]


def test_task_sink_partitions_by_role(spark):
    tasks = spark.createDataFrame([("t1", "manager"), ("t2", "shelfer")], "id string, role string")
    with tempfile.TemporaryDirectory() as d:
        ext.deliver_tasks(tasks, os.path.join(d, "tasks"))
        names = set(os.listdir(os.path.join(d, "tasks")))
        assert {"role=manager", "role=shelfer"} <= names


def test_a_retried_delivery_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "tasks")
    tasks = lambda *ids: spark.createDataFrame([(i, "manager" if i < "t3" else "shelfer") for i in ids], "id string, role string")
    ext.deliver_tasks(tasks("t1", "t2", "t3"), path)
    ext.deliver_tasks(tasks("t3", "t1", "t2"), path)
    ext.deliver_tasks(tasks("t4"), path)
    ext.deliver_tasks(tasks(), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == ["t1", "t2", "t3", "t4"]
    ext.deliver_tasks(tasks("t5"), path, delivery="batch-7")
    ext.deliver_tasks(tasks("t5"), path, delivery="batch-7")
    assert spark.read.parquet(path).where("role = 'shelfer'").count() == 3


def test_artifacts_of_other_stores_stay(spark, tmp_path):
    from storelens.plans.reports import write_artifacts

    path = str(tmp_path / "artifacts")
    rows = lambda *r: spark.createDataFrame(r, "store_id string, event_id string, text string")
    write_artifacts(rows(("s1", "a", "old"), ("s1", "b", "old"), ("s2", "a", "old")), path)
    write_artifacts(rows(("s1", "a", "new")), path)
    assert sorted((r["store_id"], r["text"]) for r in spark.read.json(path).collect()) == [("s1", "new"), ("s2", "old")]


def test_a_round_goes_on_without_a_source_that_fails_while_it_runs(spark):
    from storelens.plans import operations as ops
    from storelens.plans.queries import _items

    items = _items(spark, "/root/testdata/sf0.001").limit(50)
    stores = items.select("store_id").distinct()
    broken = lambda: items.withColumn("external_id", F.raise_error(F.lit("disk gone")).cast("string"))

    def absent():
        raise FileNotFoundError("no folder")

    def bad_step(made):
        return made["tasks"].select(F.raise_error(F.lit("no report")).alias("x"))

    got = ops.operational_round(stores, {"broken": broken, "sqlserver_operational_facts": lambda: items, "absent": absent}, None, None,
                                "2026-01-01T00:00:00", "r1", backfill=True, steps=ops.report_steps() | {"bad": bad_step})
    assert got["evidence"].count() == 50 and "bad" not in got
    assert {r["errors"] for r in got["health"].collect()} == {"absent=1, bad=1, broken=1"}
    assert got["snapshot"].count() == stores.count() and got["proofs"].count() == got["events"].count()
    none = ops.operational_round(stores, {"absent": absent}, None, None, "2026-01-01T00:00:00", "r2")
    assert {(r["error_count"], r["healthy"]) for r in none["health"].collect()} == {(1, False)}


def test_a_round_goes_on_without_the_source_of_facts(spark):
    from storelens.plans import operations as ops
    from storelens.sources.collectors import scan_camera_events

    stores = spark.createDataFrame([("s1",), ("s2",)], "store_id string")
    seen = spark.createDataFrame([("s1", 1, "c1", "2026-01-01T00:00:00")], "store_id string, event_id long, channel string, started_at string")
    before = spark.createDataFrame([("s2", "facts", "old")], "store_id string, connector string, external_id string")
    primed = spark.createDataFrame([("s1", "camera"), ("s2", "facts")], "store_id string, connector string")

    def facts():
        return stores.select("store_id", F.raise_error(F.lit("no memory")).cast("string").alias("external_id"))

    def run(sources):
        return ops.operational_round(stores, sources, before, primed, "2026-01-01T00:00:00", "r1", steps=ops.report_steps())

    keys = lambda df: {tuple(r) for r in df.collect()}
    got = run({"facts": facts, "camera": lambda: scan_camera_events({"observations": seen})})
    assert keys(got["ledger"]) == {("s2", "facts", "old"), ("s1", "camera", "collector.sqlite3:observations:1")}
    assert got["evidence"].count() == 1 and got["events"].count() == got["tasks"].count() == 0
    assert keys(got["health"].select("store_id", "imported", "events_created", "errors")) == {("s1", 1, 0, "facts=1"), ("s2", 0, 0, "facts=1")}
    assert got["snapshot"].count() == 1 and got["proofs"].count() == 0
    none = run({"facts": facts})
    assert keys(none["ledger"]) == keys(before) and keys(none["primed"]) == keys(primed) and none["evidence"].count() == 0
    assert {r["errors"] for r in none["health"].collect()} == {"facts=1"}


def test_new_event_type_has_its_own_summary(spark):
    from pyspark.sql import functions as F

    from storelens.extensions import with_rules
    from storelens.operators.workflows import WorkflowRule, evaluate_workflows

    rules = with_rules({"price_change": [WorkflowRule(F.col("facts.quantity") > 1, "manager", "Check it.", "Price.")],
                        "audit": [WorkflowRule(F.lit(False), "manager", "Never.", "Never.")]})
    events = spark.createDataFrame([("1", "s", "price_change", (5.0,)), ("2", "s", "audit", (5.0,)), ("3", "s", "other", (5.0,)), ("4", "s", "sale", (None,))],
                                   "id string, store_id string, event_type string, facts struct<quantity:double>").withColumn(
        "occurred_at", F.lit("2026-01-01T10:00:00"))
    out, _ = evaluate_workflows(events, rules, {"audit": ("Audit clean", "Audit open")})
    assert {r["id"]: r["summary"] for r in out.collect()} == {
        "1": "Price change needs 1 verification step(s)", "2": "Audit clean", "3": "Unsupported event routed to manager",
        "4": "Sale needs 1 verification step(s)"}


def test_answers_keep_keys_without_a_field(spark):
    from storelens.operators.state import answer_tasks

    tasks = spark.createDataFrame([("t", "s", "open")], "id string, store_id string, status string")
    answers = spark.createDataFrame([("a", "s", "t", "boss", "1", "yes", "12", "left shelf")],
                                    "answer_id string, store_id string, task_id string, actor string, answered_at string, confirmed string, "
                                    "counted string, note string")
    after, evidence, _ = answer_tasks(tasks, answers)
    got = after.first()["answer"]
    assert got["confirmed"] == "yes" and got["other"] == '{"counted":"12","note":"left shelf"}'
    assert len(evidence.first()["id"]) == 4 + 64


def test_scans_and_pairs_have_no_ceiling(spark):
    from pyspark.sql import functions as F

    from storelens.operators.catalog import infer_relationships
    from storelens.operators.records import recent_top_n
    from storelens.sources import collectors as col

    facts = spark.range(1500).select(F.lit("s").alias("store_id"), F.col("id").alias("fact_key"), F.lit("t").alias("occurred_at"),
                                     F.lit("sale").alias("fact_type"), F.lit("p").alias("product_sku"), F.lit(1.0).alias("quantity"),
                                     F.lit("d").alias("document_id"), F.lit("l").alias("line_id"))
    items = col.scan_system_facts(facts)
    assert items.count() == 1500 and col.newest(items, 7).count() == 7
    assert recent_top_n(facts, ["store_id"], [F.col("fact_key")], 1200).count() == 1200
    n = 20  # 20 tables share one identifier: 190 pairs
    catalog = spark.range(n).select(
        F.lit("s").alias("store_id"), F.lit("db").alias("source"), F.lit(0).alias("source_pos"), F.lit("sqlserver").alias("source_kind"),
        F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("table"), F.col("id").cast("int").alias("table_pos"),
        F.lit("ProductId").alias("column"), F.lit(0).alias("column_pos"), F.lit("int").alias("type"), F.lit(False).alias("primary_key"),
        F.lit(1).cast("bigint").alias("row_count"))
    cands = catalog.select("store_id", F.concat(F.lit("role"), F.col("table_pos").cast("string")).alias("role"),
                           F.concat_ws(".", "source", "table").alias("source_path"), F.lit(1).alias("rank"))
    assert infer_relationships(cands, catalog).count() == n * (n - 1) // 2


def test_answers_without_a_task_are_rejected_before_any_order(spark):
    from storelens.operators.state import answer_tasks

    tasks = spark.createDataFrame([("t1", "s", "open"), ("t2", "s", "answered")], "id string, store_id string, status string")
    answers = spark.createDataFrame(
        [("a1", "s", "t1", "m", "2026-01-02", "yes"), ("a0", "s", "t1", "m", "2026-01-03", "no"), ("a2", "s", None, "m", "2026-01-01", "yes"),
         ("a3", "s", "t2", "m", "2026-01-01", "yes"), ("a4", None, "t1", "m", "2026-01-01", "yes"), ("a5", "s", "t9", "m", "2026-01-01", "yes")],
        "answer_id string, store_id string, task_id string, actor string, answered_at string, confirmed string")
    after, evidence, rejected = answer_tasks(tasks, answers)
    assert {r["id"]: r["status"] for r in after.collect()} == {"t1": "answered", "t2": "answered"} and evidence.count() == 1
    assert sorted((r["answer_id"], r["reason"]) for r in rejected.collect()) == [
        ("a0", "task_already_answered"), *[(a, "unknown_or_not_open_task") for a in ("a2", "a3", "a4", "a5")]]


def test_lists_of_free_text_name_a_bounded_number_of_values(spark):
    from storelens.operators import evidence as ev

    counts = spark.range(200).select(F.lit("s").alias("store_id"), F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("kind"),
                                     (F.col("id") + 1).alias("count"))
    text = ev.counts_text(counts, "kind", "t").first()["t"].split(", ")
    assert len(text) == ev.VALUES_SHOWN + 1 and text[0] == "v150=151" and text[-1] == f"(150 others)={sum(range(1, 151))}"
    few = ev.counts_text(counts.where("count <= 3"), "kind", "t").first()["t"]
    assert few == "v000=1, v001=2, v002=3"
