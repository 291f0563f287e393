"""Plans whose cost per task and on the driver must not follow the tables."""

import glob
import os
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from conftest import SF_SMALL
from storelens.operators import catalog as co
from storelens.operators import facts
from storelens.plans.queries import QUERIES
from storelens.operators.proofs import operation_proofs
from storelens.session import ROW_GROUP_BYTES, TASK_BOUNDS, bound_tasks, staged, table_options, use_state_store
from storelens.sources import catalog_fixture as cf
from storelens.sources import fixtures as fx
from storelens.streaming import correlation as corr
from storelens.streaming import ingest


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fact_joins_send_no_table_through_the_driver(spark):
    header, line, product = fx.fx_line_tables(spark, SF_SMALL)
    for limit in (None, 5):
        assert "Broadcast" not in _plan(facts.extract_line_facts(header, line, product, facts.fixture_plan(), limit=limit))


def test_identity_shape_by_store_reads_the_orders(spark, tmp_path):
    """A line without an order has no store; the others belong to the store of the order's customer."""
    orders = spark.createDataFrame([(k, 7 if k < 6 else 3) for k in range(12)], "o_orderkey long, o_custkey long")
    lines = spark.createDataFrame([(k,) for k in range(15) for _ in range(2)], "l_orderkey long")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = QUERIES["identity_shape_by_store"](spark, str(tmp_path)).collect()
    assert {(r["store_id"], r["row_count"], r["uniqueness_ratio"]) for r in rows} == {("store_7", 12, 0.5), ("store_3", 12, 0.5)}


def test_interval_join_meets_neighbours_in_time_only(spark):
    minute = 60_000_000
    placed = lambda rows: spark.createDataFrame(rows, "id string, store_id string, occurred_us long")
    records = placed([(f"r{i}", s, i * 7 * minute - 30) for i in range(40) for s in ("a", "b")]
                     + [("alone", "a", 9000 * minute), ("twice", "a", 0), ("twice", "a", 0), ("none", None, 0)])
    observations = placed([(f"o{i}", "a", i * 15 * minute) for i in range(-2, 20)] + [("z", None, 0), ("o0b", "a", 0)])
    joined = corr.interval_join(records, observations, 15, 60)
    assert "_stretch" in _plan(joined)
    left, right, w = records.collect(), observations.collect(), 15 * minute
    want = set()
    for r in left:
        near = [(abs(o.occurred_us - r.occurred_us), o.occurred_us, o.id) for o in right
                if o.store_id is not None and o.store_id == r.store_id and abs(o.occurred_us - r.occurred_us) <= w]
        best = min(near) if near else (None, None, None)
        want.add((r.store_id, r.id, r.occurred_us, best[2], best[1], best[0]))
    got = [tuple(r) for r in joined.collect()]
    assert len(got) == len(want) and set(got) == want


def test_a_name_in_every_store_is_scored_in_many_tasks(spark):
    rows = spark.range(400).select(
        F.concat(F.lit("s"), "id").alias("store_id"), F.lit("api").alias("source"), F.lit(0).alias("source_pos"),
        F.lit("products").alias("table"), F.lit(0).alias("table_pos"), F.lit("sku").alias("column"), F.lit(0).alias("column_pos"))
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        scores = co.score_mappings(rows)
        tasks = [r["count"] for r in scores.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(tasks) == 400 * len(co.CANONICAL_FIELDS) and max(tasks) < sum(tasks) / 3


def test_a_file_of_customers_becomes_catalogs_in_many_tasks(spark, tmp_path, monkeypatch):
    """Also where nothing reads what the orders add, so that their join is left out."""
    monkeypatch.setattr(cf, "STORES_PER_TASK", 100, raising=False)
    own = spark.newSession()
    customers = own.range(900).select(F.col("id").alias("c_custkey"), F.lit("c").alias("c_name"), F.lit("X").alias("c_mktsegment"))
    customers.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    own.createDataFrame([(1, 5)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    cat = cf.fx_catalog(own, str(tmp_path))
    declared, contracts = cf.fx_declared_relationships(own, str(tmp_path)), cf.fx_contracts(own, str(tmp_path))
    for made in (cat.select("store_id", "column").distinct(), declared, contracts):
        assert "Exchange hashpartitioning(c_custkey" in _plan(made)
    for made in (cat, declared, contracts):
        tasks = [r["n"] for r in made.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert len(tasks) > 3 and max(tasks) < sum(tasks) / 3
    assert cat.select("store_id").distinct().count() == 900


def test_bounds_leave_what_the_session_states(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "77m")
    bound_tasks(own)
    assert own.conf.get("spark.sql.autoBroadcastJoinThreshold") == "77m"
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    assert own.conf.get(key) == TASK_BOUNDS[key]


def test_state_stores_of_an_executor_share_bounded_memory(spark):
    own = spark.newSession()
    use_state_store(own)
    of = "spark.sql.streaming.stateStore.rocksdb."
    assert own.conf.get(of + "boundedMemoryUsage") == "true" and int(own.conf.get(of + "maxMemoryUsageMB", "500")) <= 500


def _shuffle_files(spark) -> set[str]:
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for d in manager.localDirsString() for f in glob.glob(os.path.join(d, "*", "shuffle_*"))}


def test_a_stream_keeps_no_shuffle_files_and_writes_compressed_tables(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    items = spark.range(2000).select(
        F.concat(F.lit("s"), F.col("id") % 3).alias("store_id"), F.lit("c").alias("connector"), F.col("id").cast("string").alias("external_id"),
        F.lit("2026-01-01T10:00:00").alias("occurred_at"), F.lit("system_record").alias("kind"), F.lit(0.5).alias("confidence"),
        F.lit("sale_line").alias("operation_type"))
    items.write.parquet(src)
    before = _shuffle_files(spark)
    stream = ingest.operational_stream(spark, spark.readStream.schema(items.schema).parquet(src), state, "2026-01-03T00:00:00")
    stream.awaitTermination()
    assert spark.read.parquet(os.path.join(state, "tasks")).where("batch_id = 0").inputFiles()
    assert not _shuffle_files(spark) - before
    for table in ("items", "evidence", "events", "tasks"):
        files = glob.glob(os.path.join(state, table, "batch_id=0", "*.parquet"))
        assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_the_codec_that_a_session_states_is_kept(spark):
    own = spark.newSession()
    assert table_options(own) == {"compression": "zstd", "parquet.block.size": str(ROW_GROUP_BYTES)}
    own.conf.set("spark.sql.parquet.compression.codec", "gzip")
    assert table_options(own)["compression"] == "gzip"


def test_staged_rows_are_the_same_and_free_their_shuffles(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("t"))
    made = rows.groupBy("k", "t").agg(F.count("*").alias("n"))
    before = _shuffle_files(spark)
    back = staged(made)
    assert back.columns == made.columns and not _shuffle_files(spark) - before
    assert sorted(map(str, back.collect())) == sorted(map(str, made.collect()))


def test_polled_items_are_extracted_once_and_dealt_by_key_once(spark):
    """Neither the earlier poll's ledger nor the new evidence joins the lines again."""
    for query in ("new_evidence", "normalize_evidence", "facts_to_events", "operational_cycle"):
        plan = _plan(QUERIES[query](spark, SF_SMALL))
        assert "lineitem" not in plan and plan.count("Exchange hashpartitioning") == 2, plan


def test_proofs_deal_the_events_by_id_once(spark):
    """The two joins by id alone share a partitioning; the one by (id, store) comes after them."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        events = fx.fx_op_event(spark, SF_SMALL)
        plan = _plan(operation_proofs(events, fx.fx_all_evidence(spark, SF_SMALL), fx.fx_task(spark, SF_SMALL)))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(re.findall(r"Exchange hashpartitioning\(id#\d+, \d+\)", plan)) == 1, plan


def test_a_record_meets_few_observations_however_dense_they_are(spark):
    """What the interval join compares a record with are ends of buckets and its finest bucket; the nearest is among them."""
    minute, n = 60_000_000, 6000
    placed = lambda rows: spark.createDataFrame(rows, "id string, store_id string, occurred_us long")
    stamps = [(i * 7919 * 7919) % (90 * minute) - 30 * minute for i in range(n)]
    observations = placed([(f"o{i % 997}_{i}", "a", t) for i, t in enumerate(stamps)] + [("tie1", "a", 5 * minute), ("tie0", "a", 5 * minute)])
    records = placed([(f"r{i}", "a", i * minute + i * i * 31) for i in range(-20, 50)] + [("same", "a", 5 * minute), ("early", "a", -200 * minute)])
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    rungs = corr.ladder(observations.where(half == 0)).unionByName(corr.ladder(observations.where(half == 1)))  # two batches
    got = {(r["system_record_id"], r["observation_id"], r["time_difference_us"]) for r in corr.interval_join(records, rungs, 15, 60).collect()}
    want, near = set(), observations.collect()
    for r in records.collect():
        best = min(((abs(o.occurred_us - r.occurred_us), o.occurred_us, o.id) for o in near if abs(o.occurred_us - r.occurred_us) <= 15 * minute),
                   default=(None, None, None))
        want.add((r.id, best[2], best[0]))
    assert got == want
    joined = corr.interval_join(records, rungs, 15, 60)
    assert joined.count() == 72
    assert corr.ladder(observations).where(F.col("_level") == 1).count() <= 2 * 8 * 8
