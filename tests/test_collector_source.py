"""The collector data source and payloads of any shape."""

import json
import os

from pyspark.sql import functions as F

from storelens.operators import ingest, payload
from storelens.operators.workflows import evaluate_workflows
from storelens.plans.reports import write_artifacts
from storelens.sources import collector_source as src


def _drop(root, store, connector, seq, lines, name="a.json"):
    folder = os.path.join(root, f"store_id={store}", f"connector={connector}", f"seq={seq}")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write("".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) + "\n" for x in lines))


def _read(spark, root, **options):
    src.register_collector_source(spark)
    return spark.read.format(src.FORMAT).options(**options).load(str(root))


def test_lines_become_items(spark, tmp_path):
    _drop(tmp_path, "s%201", "cam", 1, [
        {"external_id": "1", "occurred_at": "2026-01-01", "kind": "observation", "confidence": 0.5, "zone": "é", "store_id": "forged"},
        {"external_id": 7, "confidence": True, "payload": {"a": [1, None]}, "b": {}}, "not json\n", "\n", "[1]\n", {"payload": "text"}, '{"external_id": "last"}'])
    rows = _read(spark, tmp_path).collect()
    assert {(r["store_id"], r["connector"], r["seq"]) for r in rows} == {("s 1", "cam", 1)}
    got = [(r["external_id"], r["kind"], r["confidence"], r["payload"] if r["payload"] in (None, "not json", "[1]") else json.loads(r["payload"])) for r in rows]
    assert got == [("1", "observation", 0.5, {"zone": "é"}), ("7", None, None, {"a": [1, None], "b": {}}), (None, None, None, "not json"),
                   (None, None, None, "[1]"), (None, None, None, {"payload": "text"}), ("last", None, None, None)]


def test_ranges_give_every_line_once(spark, tmp_path):
    lines = [{"external_id": str(i), "note": "é" * (i % 50)} for i in range(400)]
    _drop(tmp_path, "s", "c", 0, lines)
    for size in (1, 37, 1000):
        if size == 1 and len(lines) > 40:
            _drop(tmp_path / "few", "s", "c", 0, lines[:10])
            assert sorted(int(r["external_id"]) for r in _read(spark, tmp_path / "few", range_bytes="7").collect()) == list(range(10))
            continue
        df = _read(spark, tmp_path, range_bytes=str(size * 10))
        assert sorted(int(r["external_id"]) for r in df.collect()) == list(range(400))


def test_conditions_choose_folders(spark, tmp_path):
    for store in ("a", "b", "c"):
        for connector in ("x", "y"):
            _drop(tmp_path, store, connector, 3, [{"external_id": store + connector}])
    os.makedirs(tmp_path / "store_id=broken" / "connector=x" / "seq=1" / "folder.json")
    df = _read(spark, tmp_path).where(F.col("store_id").isin("a", "c", "none") & (F.col("connector") == "y") & F.col("external_id").isNotNull())
    assert sorted(r["external_id"] for r in df.collect()) == ["ay", "cy"]
    reader = src._BatchReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([src.EqualTo(("connector",), "y"), src.In(("store_id",), ("a", "b")), src.EqualTo(("store_id",), "b"),
                                    src.EqualTo(("kind",), "observation")]))
    assert left == [src.EqualTo(("kind",), "observation")] and [(p.store_id, p.connector) for p in reader.partitions()] == [("b", "y")]
    assert _read(spark, tmp_path / "absent").count() == 0


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    src.register_collector_source(spark)
    root, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.format(src.FORMAT).load(root)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(
            availableNow=True).start().awaitTermination()
        return sorted(r["external_id"] for r in spark.read.parquet(out).collect())

    _drop(root, "a", "x", 1, [{"external_id": "1"}])
    _drop(root, "a", "x", 4, [{"external_id": "2"}])
    assert run() == ["1", "2"]
    _drop(root, "a", "x", 5, [{"external_id": "3"}])
    _drop(root, "b", "x", 0, [{"external_id": "joined"}])
    assert run() == ["1", "2", "3", "joined"] and run() == ["1", "2", "3", "joined"]


def test_unknown_keys_survive_the_cycle(spark, tmp_path):
    schema = "store_id string, connector string, external_id string, occurred_at string, kind string, confidence double, payload string"
    body = '{"operation_type": "sale_line", "product_id": "P", "quantity": 4, "lot": {"no": 9007199254740993, "tags": ["a"]}, "note": "n"}'
    rows = [("s", "c", str(i), "2026-01-01T10:00:00", "system_record", 0.9, p) for i, p in enumerate(
        [body, "not json", None, " ", '{"operation_type": 5, "quantity": "many"}', "[1, 2]"])]
    items = spark.createDataFrame(rows, schema)
    evidence, _ = ingest.normalize_evidence(ingest.new_evidence(items, None)[0], "now")
    got = {r["external_id"]: r for r in evidence.select("external_id", "quantity", "operation_type", F.to_json("extra").alias("extra"),
                                                        payload.unknown_keys(F.col("extra")).alias("unknown")).collect()}
    assert json.loads(got["0"]["extra"]) == json.loads(body) and got["0"]["quantity"] == 4.0 and got["0"]["unknown"] == ["lot", "note"]
    assert got["1"]["extra"] == '"not json"' and got["2"]["extra"] is None and got["3"]["extra"] is None and got["5"]["extra"] == "[1,2]"
    assert got["4"]["quantity"] is None and got["4"]["operation_type"] == "5" and got["1"]["unknown"] == []
    events, tasks = evaluate_workflows(ingest.facts_to_events(evidence))
    event = events.select("facts.quantity", F.variant_get("extra", "$.lot.no", "long").alias("no")).collect()
    assert [(r["quantity"], r["no"]) for r in event] == [(4.0, 9007199254740993)] and tasks.count() == 1
    path = str(tmp_path / "events")
    write_artifacts(payload.as_json(events.select("store_id", "id", "extra")), path)
    assert json.loads(spark.read.json(path).first()["extra"]) == json.loads(body)
    from storelens.streaming.ingest import operational_stream

    inbox, state = str(tmp_path / "in"), str(tmp_path / "state")
    items.coalesce(1).write.parquet(inbox)
    operational_stream(spark, spark.readStream.schema(schema).parquet(inbox), state, "now").awaitTermination()
    kept = spark.read.parquet(os.path.join(state, "events")).select(F.to_json("extra").alias("extra")).collect()
    assert [json.loads(r["extra"]) for r in kept] == [json.loads(body)]
