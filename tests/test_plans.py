"""Physical-plan properties of registered queries (no Python on the row path,
no unbounded cartesian products, pruned scans) and the watermark dedupe stream."""

import pytest

import __spark_entry__ as entry

from conftest import SF_SMALL

LAZY_KEYS = ["extract_line_facts", "extract_line_facts_recent", "nearest_observation", "nearest_camera",
             "operation_proofs", "operational_snapshot", "evaluate_workflows", "score_mappings", "score_table_roles",
             "infer_relationships", "readiness", "profile_mappings", "scan_camera_events", "camera_registry",
             "latest_records", "answer_tasks", "action_status", "collector_health", "flatten_catalog", "parse_timestamp"]
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


@pytest.mark.parametrize("key", LAZY_KEYS)
def test_plan_is_jvm_only(spark, key):
    plan = entry.queries()[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for bad in PYTHON_NODES:
        assert bad not in plan, (key, bad)
    # fixed rule tables are applied per row by exploding a literal array: no cross joins at all
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, key


def test_line_facts_limit_is_taken_as_given(spark):
    from storelens.operators import facts
    from storelens.sources import fixtures as fx

    lines = [*fx.fx_line_tables(spark, SF_SMALL), facts.fixture_plan()]
    per = lambda limit: {tuple(r[:2]): r[2] for r in facts.extract_line_facts(
        *lines, limit=limit).groupBy("store_id", "operation_type").count().collect()}
    every = per(None)
    assert max(every.values()) > 100
    assert per(500) == {k: min(n, 500) for k, n in every.items()}
    for limit in (0, -1):
        with pytest.raises(ValueError):
            facts.extract_line_facts(*lines, limit=limit)


def test_stores_with_equal_ids_keep_their_own_facts(spark):
    from pyspark.sql import functions as F

    from storelens.operators import facts

    header = spark.createDataFrame([("A", 1, "2026-01-01 08:00:00"), ("B", 1, "2026-01-02 08:00:00")], "store string, id int, at string").withColumn(
        "at", F.to_timestamp("at"))
    line = spark.createDataFrame([("A", 1, 1, 10, 5.0), ("B", 1, 1, 10, 7.0)], "shop string, header int, no int, product int, qty double")
    product = spark.createDataFrame([("A", 10, "tea"), ("B", 10, "rice")], "owner string, id int, name string")
    plan = dict(header_id="id", header_store="store", date_col="at", line_header="header", line_id="no", line_product="product", quantity_col="qty",
                product_key="id", product_identity="name", operation=F.lit("sale"))
    got = facts.extract_line_facts(header, line, product, facts.FactPlan(**plan, line_store="shop", product_store="owner")).collect()
    assert sorted((r["store_id"], r["product_id"], r["quantity"], r["occurred_at"][:10]) for r in got) == [
        ("A", "tea", 5.0, "2026-01-01"), ("B", "rice", 7.0, "2026-01-02")]
    one = product.where("owner = 'A'")
    shared = facts.extract_line_facts(header, line, one, facts.FactPlan(**plan, line_store="shop", product_store=None)).collect()
    assert sorted((r["store_id"], r["product_id"], r["quantity"]) for r in shared) == [("A", "tea", 5.0), ("B", "tea", 7.0)]
    with pytest.raises(TypeError):
        facts.FactPlan(**plan)


def test_learned_tables_need_a_store(spark):
    from storelens.operators import facts
    from storelens.plans.queries import q_resolve_fact_plan
    from storelens.sources.catalog_fixture import SHARED_TABLES, fx_sql_tables

    plans, tables = q_resolve_fact_plan(spark, SF_SMALL), fx_sql_tables(spark, SF_SMALL)
    with pytest.raises(ValueError, match="Products"):
        facts.extract_learned_facts(plans, tables)
    headers = tables["store_sql.dbo.Receipts"]
    assert headers.select("ReceiptId").distinct().count() < headers.count() == headers.select("store_id", "ReceiptId").distinct().count()
    assert facts.extract_learned_facts(plans, tables, shared=SHARED_TABLES).count() > 0


def test_schemas_are_stacked_before_the_join(spark):
    """Two schemas, one with text ids, are one join of headers, lines and products."""
    from storelens.operators import facts

    shape = dict.fromkeys(facts.PLAN_SHAPE)
    plan = lambda store, prefix, **extra: {"store_id": store, "plan_ok": True, "structural_confidence": 0.8, "mapping_verified": True, **shape,
                                           "operation": "sale", "header_table": f"{prefix}.h", "line_table": f"{prefix}.l", "product_table": f"{prefix}.p",
                                           "header_id_col": "id", "line_header_col": "h", "line_product_col": "p", "product_key_col": "id",
                                           "date_col": "at", "quantity_col": "q", "product_identity_col": "sku", "line_id_col": "no"} | extra
    schema = "store_id string, plan_ok boolean, structural_confidence double, mapping_verified boolean, " + ", ".join(f"{c} string" for c in facts.PLAN_SHAPE)
    rows = [plan("A", "x"), plan("B", "x"), plan("C", "y", pack_size_col="pack"), plan("D", "x", operation=None) | {"plan_ok": False}]
    plans = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    make = lambda data, ddl: spark.createDataFrame(data, ddl)
    tables = {
        "x.h": make([("A", 1, "2026-01-01"), ("B", 1, "2026-01-02")], "store_id string, id int, at string"),
        "x.l": make([("A", 1, 1, 5, 2.0), ("B", 1, 1, 5, 3.0)], "store_id string, h int, no int, p int, q double"),
        "x.p": make([("A", 5, "tea"), ("B", 5, "rice")], "store_id string, id int, sku string"),
        "y.h": make([("C", "1", "2026-01-03")], "store_id string, id string, at string"),
        "y.l": make([("C", "1", "a", 5, "4"), ("C", "9", "a", 5, "4")], "store_id string, h string, no string, p int, q string"),
        "y.p": make([("C", 5, "oil", "12 pcs")], "store_id string, id int, sku string, pack string"),
    }
    found = facts.extract_learned_facts(plans, tables)
    assert sorted((r["store_id"], r["product_id"], r["quantity"], r["occurred_at"][:10]) for r in found.collect()) == [
        ("A", "tea", 2.0, "2026-01-01"), ("B", "rice", 3.0, "2026-01-02"), ("C", "oil", 4.0, "2026-01-03")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3


def test_scan_prunes_columns(spark):
    df = entry.queries()["extract_line_facts"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_extendedprice" not in plan  # unused columns never read


def test_dedupe_stream_within_watermark(spark, tmp_path):
    from storelens.streaming.ingest import dedupe_stream

    schema = "store_id string, connector string, external_id string, event_time timestamp"
    rows = [("s", "c", "x1", "2026-01-01 10:00:00"), ("s", "c", "x1", "2026-01-01 10:00:05"),
            ("s", "c", "x2", "2026-01-01 10:01:00")]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "store_id string, connector string, external_id string, event_time string") \
        .selectExpr("store_id", "connector", "external_id", "cast(event_time as timestamp) as event_time") \
        .coalesce(1).write.parquet(str(src))
    stream = dedupe_stream(spark.readStream.schema(schema).parquet(str(src)))
    q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_top_n_limits_before_the_shuffle(spark):
    plan = entry.queries()["extract_line_facts_recent"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_new_evidence_is_one_aggregation_and_one_anti_join(spark):
    from pyspark.sql import functions as F

    from storelens.operators.ingest import new_evidence

    ledger = spark.range(2000).select(F.lit("s").alias("store_id"), F.lit("c").alias("connector"),
                                      F.col("id").cast("string").alias("external_id"))
    batch = spark.createDataFrame([("s", "c", "1", "t"), ("s", "c", "x", "u"), ("s", "c", "x", "t"), ("s", "c", " ", "t")],
                                  "store_id string, connector string, external_id string, occurred_at string")
    fresh, after = new_evidence(batch, ledger)
    plan = fresh._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 1 and "Window" not in plan, plan
    assert [(r["external_id"], r["occurred_at"]) for r in fresh.collect()] == [("x", "t")] and after.count() == 2001
