"""Shape checks, streaming idempotence and the skew-safe sequence."""

import os
import tempfile

from pyspark.sql import functions as F

from storelens.operators.profile import ShapeTarget, profile_table
from storelens.operators.records import sequence_within


def test_identity_and_pack_shapes(spark):
    df = spark.range(30034).select(
        (F.col("id") % 30005).alias("code"),
        F.when(F.col("id") < 8451, F.when(F.col("id") == 0, 12).otherwise(0)).alias("pack"))
    ident = ShapeTarget("product.identity", "s.t.code", "code", "identity", 0.96, 0.98)
    pack = ShapeTarget("product.pack_size", "s.t.pack", "pack", "numeric", 0.96, 0.98, "int")
    r = {x["canonical_field"]: x for x in profile_table(df, [ident, pack]).collect()}
    assert r["product.identity"]["passed"] and r["product.identity"]["uniqueness_ratio"] == 0.999
    assert not r["product.pack_size"]["passed"] and r["product.pack_size"]["nonnull_ratio"] == 0.2814


def test_sequence_is_gapless_with_a_hot_store(spark):
    n = 5000
    df = spark.range(n).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")))
        .alias("store_id"), F.format_string("%08d", "id").alias("created_at"), F.col("id").cast("string").alias("id"))
    seq = sequence_within(df, "store_id", ["created_at", "id"], num_partitions=8)
    got = seq.groupBy("store_id").agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi"),
                                      F.count(F.lit(1)).alias("n"), F.countDistinct("sequence").alias("d")).collect()
    for r in got:
        assert r["lo"] == 1 and r["hi"] == r["n"] == r["d"]
    # the hot store is split over several range partitions, and order is respected
    hot = seq.where("store_id = 'hot'").orderBy("sequence").select("created_at").collect()
    assert [x[0] for x in hot] == sorted(x[0] for x in hot)


def test_operational_stream_is_idempotent(spark):
    from storelens.streaming.ingest import operational_stream

    schema = ("store_id string, connector string, external_id string, occurred_at string, kind string, "
              "confidence double, operation_type string, product_id string, quantity double, pack_size double, "
              "destination_id string, source_record_hash string, mapping_verified boolean")
    rows1 = [("s", "c", f"x{i}", f"2026-01-01T10:0{i}:00", "system_record", 0.8, "purchase_line", "P", 1.0, 12.0,
              "G", "h", False) for i in range(5)]
    rows2 = rows1[:3] + [("s", "c", "x9", "2026-01-01T11:00:00", "system_record", 0.8, "sale_line", "", None,
                          None, None, "h", False)]
    with tempfile.TemporaryDirectory() as d:
        src, state = os.path.join(d, "in"), os.path.join(d, "state")
        spark.createDataFrame(rows1, schema).coalesce(1).write.parquet(src)
        stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        operational_stream(spark, stream(), state, "2026-01-02T00:00:00").awaitTermination()
        spark.createDataFrame(rows2, schema).coalesce(1).write.mode("append").parquet(src)
        operational_stream(spark, stream(), state, "2026-01-02T00:00:00").awaitTermination()
        operational_stream(spark, stream(), state, "2026-01-02T00:00:00").awaitTermination()  # restart: no-op
        ev = spark.read.parquet(os.path.join(state, "evidence"))
        assert ev.count() == 6 and ev.select("external_id").distinct().count() == 6
        tasks = spark.read.parquet(os.path.join(state, "tasks"))
        assert tasks.where("event_type = 'sale'").count() == 2  # mapping unverified + incomplete line


def test_stream_fills_blank_times_per_batch_and_keeps_them(spark, tmp_path):
    from storelens.streaming.ingest import operational_stream

    schema = ("store_id string, connector string, external_id string, occurred_at string, kind string, "
              "confidence double, operation_type string, product_id string, quantity double, pack_size double, "
              "destination_id string, source_record_hash string, mapping_verified boolean")
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    row = lambda i: ("s", "c", i, "", "system_record", 0.8, "sale_line", "P", 1.0, None, None, "h", True)
    for i in ("x1", "x2"):
        spark.createDataFrame([row(i)], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        operational_stream(spark, stream, state).awaitTermination()
    times = {r["external_id"]: r["occurred_at"] for r in spark.read.parquet(os.path.join(state, "evidence")).collect()}
    assert times["x1"] < times["x2"]


def test_stream_correlation_equals_batch_for_any_order(spark, tmp_path):
    import random

    from storelens.operators.correlate import nearest_observation
    from storelens.streaming import correlation as st

    rng = random.Random(11)
    stamp = lambda m: f"2026-01-{1 + m // 1440:02d}T{m % 1440 // 60:02d}:{m % 60:02d}:00"
    rows = [(f"e{i}", f"s{i % 2}", rng.choice(["system_record", "observation", "other"]), stamp(rng.randrange(3 * 1440)) if i % 17 else "unknown")
            for i in range(400)]
    schema = "id string, store_id string, kind string, occurred_at string"
    want = sorted(map(tuple, nearest_observation(spark.createDataFrame(rows, schema), 15).select(
        "store_id", "system_record_id", "observation_id", "time_difference_us").collect()))
    assert want
    for k in range(2):
        rng.shuffle(rows)
        src, state = str(tmp_path / f"in{k}"), str(tmp_path / f"state{k}")
        for part in range(3):
            spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        st.stream_correlation(spark, stream, state, 15).awaitTermination()
        assert sorted(map(tuple, st.correlated(spark, state).collect())) == want


def test_stream_batch_opens_only_the_days_around_its_rows(spark, tmp_path):
    from storelens.streaming import tables as st

    history = str(tmp_path / "history")
    days = spark.range(40).select(F.col("id").alias("day"), F.col("id").cast("string").alias("id"))
    st.write_batch(days, history, 0, "day")
    near = st.folders(spark, history, "day", [9, 10, 11, 99])
    assert sorted(r["day"] for r in near.collect()) == [9, 10, 11] and len(near.inputFiles()) == 3
