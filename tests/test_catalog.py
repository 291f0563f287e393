"""Catalog learning on the reference's example schemas (re-expressed as rows)."""

import pytest

from storelens.operators import catalog as co

LEGACY = [("old_pos_sql", "Mst_Itm", ["Item_No", "Itm_Name", "CtnFactor"]),
          ("old_pos_sql", "Pur_Dtl_26", ["ItmRef", "QntyRcvd", "LoosePc", "GoDown_No"]),
          ("old_pos_sql", "Cctv_Map", ["Feed_Channel", "AreaText"]),
          ("old_pos_sql", "Emp_Mst", ["EmpNo", "EmpDuty", "Badge_No"]),
          ("old_pos_sql", "Bill_Dtl", ["ItmRef", "BillQty"])]
MODERN = [("operations_api", "products", ["product_code", "units_per_case"]),
          ("operations_api", "receipts", ["received_qty", "destination_id"]),
          ("operations_api", "camera_channels", ["camera_zone"]),
          ("operations_api", "staff", ["staff_role", "staff_id"]),
          ("operations_api", "sales", ["sale_qty"])]


def _catalog(spark, store, tables):
    rows = [(store, src, 0, "x", tab, tp, col, cp, "varchar", False, 10)
            for tp, (src, tab, cols) in enumerate(tables) for cp, col in enumerate(cols)]
    return spark.createDataFrame(rows, "store_id string, source string, source_pos int, source_kind string, "
                                       "table string, table_pos int, column string, column_pos int, type string, "
                                       "primary_key boolean, row_count long")


@pytest.fixture(scope="module")
def learned(spark):
    cat = _catalog(spark, "legacy", LEGACY).unionByName(_catalog(spark, "modern", MODERN))
    stores = spark.createDataFrame([("legacy", False), ("modern", False)], "store_id string, requires_confirmation boolean")
    scores = co.score_mappings(cat)
    mappings = co.propose_mappings(scores, stores)
    questions = co.setup_questions(mappings, scores, stores)
    ready = co.readiness(mappings, questions, stores)
    roles = co.role_candidates(co.score_table_roles(cat))
    return {r["store_id"]: r for r in ready.collect()}, mappings, questions, roles


def _m(mappings, store):
    return {r["canonical_field"]: (r["source_path"].split(".", 1)[1], float(r["confidence"]), r["verified"])
            for r in mappings.where(f"store_id = '{store}'").collect()}


def test_legacy_proposals_and_questions(learned):
    ready, mappings, questions, _ = learned
    m = _m(mappings, "legacy")
    assert "product.identity" not in m
    assert m["purchase.quantity"] == ("Bill_Dtl.BillQty", 0.66, False)
    assert m["product.pack_size"] == ("Mst_Itm.CtnFactor", 0.66, False)
    assert m["movement.destination"] == ("Pur_Dtl_26.GoDown_No", 0.66, False)
    assert m["camera.zone"] == ("Cctv_Map.AreaText", 0.86, False)
    assert m["staff.role"] == ("Emp_Mst.EmpDuty", 0.86, False)
    assert m["sale.quantity"] == ("Bill_Dtl.BillQty", 0.98, True)
    keys = sorted(r["key"] for r in questions.where("store_id = 'legacy'").collect())
    assert len(keys) == 6 and sum(k.startswith("map:") for k in keys) == 1
    assert not ready["legacy"]["ready"]


def test_modern_is_ready_without_questions(learned):
    ready, mappings, questions, _ = learned
    m = _m(mappings, "modern")
    assert m["product.identity"] == ("products.product_code", 0.98, True)
    assert m["purchase.quantity"] == ("receipts.received_qty", 0.98, True)
    assert questions.where("store_id = 'modern'").count() == 0
    assert ready["modern"]["ready"] and ready["modern"]["checks_passed"] == 5


def test_role_candidates(learned):
    *_, roles = learned
    top = {(r["store_id"], r["role"]): (r["source_path"].split(".", 1)[1], float(r["confidence"]))
           for r in roles.where("rank = 1").collect()}
    assert top[("legacy", "sale_line")] == ("Bill_Dtl", 0.74)
    assert top[("legacy", "staff_directory")] == ("Emp_Mst", 0.74)
    assert top[("legacy", "camera_registry")] == ("Cctv_Map", 0.74)
    assert top[("modern", "staff_directory")] == ("staff", 0.96)
    assert top[("modern", "purchase_line")] == ("receipts", 0.6)


def test_destination_prefers_to_over_form(spark):
    cat = _catalog(spark, "d", [("legacy", "StockTransfer", ["GoDownForm", "GoDownTo"])])
    stores = spark.createDataFrame([("d", False)], "store_id string, requires_confirmation boolean")
    m = co.propose_mappings(co.score_mappings(cat), stores).where("canonical_field = 'movement.destination'").first()
    assert m["source_path"].endswith("GoDownTo")


def test_contracts_verify(spark):
    cat = _catalog(spark, "modern", MODERN)
    stores = spark.createDataFrame([("modern", True)], "store_id string, requires_confirmation boolean")
    contracts = spark.createDataFrame(
        [("modern", "operations_api", "camera.zone", "camera_channels", "camera_zone", "authorized_connector_contract", 0),
         ("modern", "operations_api", "staff.role", "staff", "staff_role", "authorized_connector_contract", 1)],
        "store_id string, source string, canonical_field string, table string, column string, authority string, "
        "contract_pos int")
    scores = co.score_mappings(cat)
    m = co.apply_contracts(co.propose_mappings(scores, stores), contracts)
    q = {r["key"] for r in co.setup_questions(m, scores, stores).collect()}
    assert "verify:camera.zone" not in q and "verify:staff.role" not in q
    assert "verify:product.identity" in q  # confirmation required, no contract
    caps = co.capabilities(co.role_candidates(co.score_table_roles(cat)), contracts, stores).first()
    assert "staff_directory" not in caps["unknowns"].split(",")


def test_rule_tables_are_the_fixed_ones():
    """The oracles build their SQL from these tables, so what is in them is pinned here."""
    import hashlib
    import json

    from storelens.operators import catalog as co

    pinned = {"CANONICAL_FIELDS": "00ebf4f7e4460c87", "ROLE_RULES": "dc5c255b5c3449bb", "READINESS_GROUPS": "f7263fba8300b046"}
    for name, digest in pinned.items():
        assert hashlib.sha256(json.dumps(getattr(co, name)).encode()).hexdigest()[:16] == digest, name
