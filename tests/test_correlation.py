"""Nearest-in-time correlation: reference example, brute-force property, plan shape."""

from datetime import datetime, timedelta, timezone

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storelens.operators.correlate import nearest_observation, nearest_within
from storelens.plans.snapshot import operational_snapshot


def _evidence(spark, rows):
    return spark.createDataFrame(rows, "id string, store_id string, kind string, source string, occurred_at string")


def test_snapshot_example(spark):
    ev = _evidence(spark, [
        ("obs-1", "shop_1", "observation", "camera", "2026-07-16T10:00:00+05:30"),
        ("sys-1", "shop_1", "system_record", "pos", "2026-07-16T10:05:00+05:30"),
        ("sys-2", "shop_1", "system_record", "purchase", "2026-07-16T12:00:00+05:30"),
    ])
    m = nearest_observation(ev, 15).collect()
    assert len(m) == 1
    assert m[0]["system_record_id"] == "sys-1" and m[0]["observation_id"] == "obs-1"
    assert m[0]["time_difference_seconds"] == 300.0
    assert m[0]["claim"] == "temporal_cooccurrence_only" and m[0]["verified"] is False
    events = spark.createDataFrame([("e1", "shop_1", "sale", "needs_verification")],
                                   "id string, store_id string, event_type string, status string")
    tasks = spark.createDataFrame([("t1", "shop_1", "manager", "open")], "id string, store_id string, role string, status string")
    ready = spark.createDataFrame([("shop_1", False, 2)], "store_id string, ready boolean, unresolved_questions int")
    snap = operational_snapshot(ev, events, tasks, ready, 15).collect()[0]
    assert snap["corroborated_system_records"] == 1
    assert snap["uncorroborated_system_records"] == 1
    assert snap["open_tasks_by_role"] == "manager=1"
    assert snap["state"] == "needs_attention"
    assert "never-copy" not in str(snap.asDict())
    assert "Store setup has 2 unresolved confirmation(s)." in snap["attention"]


def _brute(left, right, w):
    out = {}
    for lid, lk, lt in left:
        if lt is None:
            out[lid] = None
            continue
        best = None
        for rid, rk, rt in right:
            if rk != lk or rt is None:
                continue
            d = abs(lt - rt)
            if d <= w and (best is None or (d, rt, rid) < best):
                best = (d, rt, rid)
        out[lid] = None if best is None else best[2]
    return out


times = st.one_of(st.none(), st.integers(min_value=0, max_value=5_000))


@settings(max_examples=10, deadline=None)
@given(
    left=st.lists(st.tuples(st.sampled_from(["a", "b"]), times), min_size=1, max_size=25),
    right=st.lists(st.tuples(st.sampled_from(["a", "b"]), times), min_size=0, max_size=40),
    w=st.sampled_from([1, 7, 100, 1024, 2500]),
)
def test_nearest_within_equals_brute_force(spark, left, right, w):
    lrows = [(f"l{i}", k, t) for i, (k, t) in enumerate(left)]
    rrows = [(f"r{i:03d}", k, t) for i, (k, t) in enumerate(right)]
    ldf = spark.createDataFrame(lrows, "id string, k string, t long")
    rdf = spark.createDataFrame(rrows, "rid string, k string, t long") if rrows else \
        spark.createDataFrame([], "rid string, k string, t long")
    got = {r["id"]: r["match_id"] for r in nearest_within(
        ldf, rdf, key="k", left_us="t", right_id="rid", right_us="t", window_us=w).collect()}
    assert got == _brute(lrows, rrows, w)


def test_nearest_plan_has_no_nested_loop_or_python(spark):
    base = datetime(2026, 1, 1, tzinfo=timezone.utc)
    rows = [(f"e{i}", "s", "observation" if i % 2 else "system_record", "cam",
             (base + timedelta(seconds=37 * i)).isoformat()) for i in range(200)]
    plan = nearest_observation(_evidence(spark, rows), 15)._jdf.queryExecution().executedPlan().toString()
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan
    assert nearest_observation(_evidence(spark, rows), 15).count() == 100


def test_hot_instant_is_reduced_before_windows(spark):
    # many rows at one instant in one store collapse to one instant per side
    rows = [(f"o{i}", "s", "observation", "cam", "2026-01-01T00:00:00") for i in range(300)]
    rows += [(f"s{i}", "s", "system_record", "pos", "2026-01-01T00:00:01") for i in range(300)]
    m = nearest_observation(_evidence(spark, rows), 15)
    got = m.groupBy("observation_id").count().collect()
    assert len(got) == 1 and got[0]["observation_id"] == "o0" and got[0]["count"] == 300
    assert m.where(F.col("time_difference_us") != 1_000_000).count() == 0


def test_dense_bucket_takes_linear_time(spark):
    """All instants lie in one fine bucket; with a frame evaluated anew per row, 40,000 would cost 16 times 10,000."""
    import time

    def run(n):
        at = spark.range(n).select(F.lit("s").alias("k"), (F.col("id") * 2).alias("t"), F.col("id").cast("string").alias("id"))
        right = at.select("k", (F.col("t") + 1).alias("t"), F.col("id").alias("rid"))
        began = time.perf_counter()
        m = nearest_within(at, right, key="k", left_us="t", right_id="rid", right_us="t", window_us=1024 * 200_000)
        assert m.where("match_diff_us = 1").count() == n
        return time.perf_counter() - began

    run(1000)
    small, large = min(run(10_000) for _ in range(2)), run(40_000)
    assert large < 8 * small
