"""Workflow routing re-expressed from the reference's examples."""

from storelens.operators.workflows import evaluate_workflows

FACTS = ("product_id string, cartons double, pack_size double, destination_id string, receiver_confirmed boolean, "
         "from_location string, to_location string, sent_quantity double, quantity double, source string, "
         "stock_after double, counted_quantity double, expected_quantity double, approved boolean, human_confirmed boolean")


def _events(spark, rows):
    return spark.createDataFrame(rows, f"id string, store_id string, event_type string, occurred_at string, facts struct<{FACTS.replace(' string', ':string').replace(' double', ':double').replace(' boolean', ':boolean')}>")


def _f(**kw):
    names = [c.split()[0] for c in FACTS.split(", ")]
    return tuple(kw.get(n) for n in names)


def test_receiving_routes_to_deo_and_godown(spark):
    ev = _events(spark, [("e1", "s", "receiving", "t",
                          _f(product_id="SKU-1", cartons=1.0, pack_size=24.0, receiver_confirmed=False))])
    events, tasks = evaluate_workflows(ev)
    assert {r["role"] for r in tasks.collect()} == {"data_entry_operator", "godown_staff"}
    e = events.collect()[0]
    assert e["status"] == "needs_verification" and e["summary"] == "Receiving needs 2 verification step(s)"


def test_every_other_type_creates_tasks(spark):
    rows = [
        ("m", "s", "stock_movement", "t", _f(from_location="GD", to_location="S1", sent_quantity=10.0)),
        ("d", "s", "damage", "t", _f(quantity=2.0)),
        ("a", "s", "attendance", "t", _f(source="camera")),
        ("sa", "s", "sale", "t", _f(product_id="SKU", quantity=1.0, stock_after=-1.0)),
        ("p", "s", "purchase", "t", _f(cartons=2.0)),
        ("r", "s", "return", "t", _f(quantity=1.0)),
        ("c", "s", "stock_count", "t", _f(counted_quantity=18.0, expected_quantity=20.0)),
        ("x", "s", "expiry", "t", _f(quantity=2.0)),
    ]
    events, tasks = evaluate_workflows(_events(spark, rows))
    counts = {r["related_event_id"]: r["count"] for r in tasks.groupBy("related_event_id").count().collect()}
    assert set(counts) == {r[0] for r in rows}
    variance = tasks.where("related_event_id = 'c'").collect()[0]
    assert variance["question"] == "Review stock variance: system 20, physical 18."
    assert variance["required_authority"] == "official_record"


def test_unsupported_event_goes_to_manager(spark):
    events, tasks = evaluate_workflows(_events(spark, [("u", "s", "inventory_audit", "t", _f())]))
    t = tasks.collect()
    assert len(t) == 1 and t[0]["role"] == "manager"
    assert events.collect()[0]["summary"] == "Unsupported event routed to manager"
