"""Audit log and current tables kept batch by batch."""

import random

from pyspark.sql import functions as F

from storelens.operators import records as rec
from storelens.streaming import records as kept


def _actions(spark, rows):
    return spark.createDataFrame(rows, "store_id string, id string, created_at string")


def test_appended_audit_equals_renumbering(spark, tmp_path):
    path, rng = str(tmp_path / "audit"), random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", "b"]) if t else "a", f"id{t:03d}", f"2026-01-{1 + t // 20:02d}T{t % 20:02d}") for t in range(200)]
    for batch, at in enumerate(range(0, 200, 50)):
        kept.append_audit(spark, path, _actions(spark, rows[at:at + 50]), batch)
    kept.append_audit(spark, path, _actions(spark, rows[150:]), 3)  # tried again
    kept.append_audit(spark, path, _actions(spark, []), 4)
    kept.append_audit(spark, path, _actions(spark, [("a", "z", "2020"), ("new", "z", "2020")]), 5)
    want = sorted(map(tuple, rec.audit_log(_actions(spark, rows)).collect()))
    got = sorted(map(tuple, kept.read_audit(spark, path).select("store_id", "id", "created_at", "sequence").collect()))
    n = sum(r[0] == "a" for r in rows)
    assert got == sorted([*want, ("a", "z", "2020", n + 1), ("new", "z", "2020", 1)])
    # Earlier rows are not read: without them the next batch is numbered all the same.
    kept._delete(spark, f"{path}/log")
    kept.append_audit(spark, path, _actions(spark, [("a", "zz", "2021")]), 6)
    assert [r["sequence"] for r in kept.read_audit(spark, path).collect()] == [n + 2]
    assert len(kept._children(spark, f"{path}/counters", "batch_id")) <= 3


VERSION = "id string, version long, value string, deleted boolean"


def test_current_table_equals_the_fold_of_all_versions(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(40)}" if i % 29 else None, rng.randrange(60), f"v{i}" if i % 7 else None, rng.random() < 0.2) for i in range(400)]
    versions = spark.createDataFrame(rows, VERSION)
    want = sorted(map(str, rec.latest_records(versions).collect()))
    for order in (1, 2):
        path = str(tmp_path / f"t{order}")
        rng.shuffle(rows)
        for batch, at in enumerate(range(0, 400, 100)):
            kept.upsert_current(spark, path, spark.createDataFrame(rows[at:at + 100], VERSION), batch, buckets=8)
        kept.upsert_current(spark, path, spark.createDataFrame(rows[300:], VERSION), 3, buckets=8)
        assert sorted(map(str, kept.read_current(spark, path, versions.schema).collect())) == want
    assert kept.read_current(spark, str(tmp_path / "none"), versions.schema).count() == 0


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    versions = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("id"), F.lit(1).cast("long").alias("version"), F.lit("v").alias("value"),
                                        F.lit(False).alias("deleted"))
    assert len(kept.upsert_current(spark, path, versions, 0)) == kept.BUCKETS
    touched = kept.upsert_current(spark, path, spark.createDataFrame([("k7", 2, "w", False), ("k7", 0, "x", False), ("k9", 0, "y", True)], VERSION), 1)
    assert 1 <= len(touched) <= 2
    now = {b: gs for b, gs in kept._generations(spark, path, kept._children(spark, path, "bucket"), None).items()}
    assert {b for b, gs in now.items() if gs[-1] == 1} == set(touched)
    rows = {r["id"]: r["value"] for r in kept.read_current(spark, path, versions.schema).collect()}
    assert len(rows) == 5000 and rows["k7"] == "w" and rows["k9"] == "v"
