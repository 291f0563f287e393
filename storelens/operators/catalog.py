"""Catalog scoring, ranking and inference.

Input is the flat column catalog: one row per (store, source, table, column)
with document positions.  Scoring crosses the catalog with small fixed rule
tables (9 canonical fields, 12 table roles) that are broadcast with a proven
size bound; token tests are higher-order functions, never Python UDFs.  Scores
use DECIMAL arithmetic so thresholds and two-decimal rounding are exact.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.functions.cache import with_rules
from storelens.functions.scalar import normalize_name

# ---------------------------------------------------------------------------
# Canonical fields (order matters), their vocabularies and labels.
# (name, tokens, table_tokens, weak_tokens, column_groups, required, label)
# ---------------------------------------------------------------------------
CANONICAL_FIELDS = [
    ("product.identity",
     ["productid", "productcode", "itemcode", "sku", "pcode", "prodid"],
     ["product", "item", "sku", "catalog"], [], [], True, "Product/SKU identity"),
    ("purchase.quantity",
     ["quantity", "qty", "pieces", "pcs", "purchaseqty", "receivedqty"],
     ["purchase", "receipt", "receiving", "inward", "goodsreceived"], [], [], True, "Purchase/receiving quantity"),
    ("product.pack_size",
     ["packsize", "unitspercase", "pcspercarton", "conversion", "packing", "factor"],
     ["product", "item", "stock", "purchase", "catalog"], [],
     [["carton", "cartoon", "case", "box"], ["pcs", "piece", "unit"]], True, "Carton/pack/piece conversion"),
    ("movement.destination",
     ["destination", "destinationid", "dest", "godown", "warehouse", "location", "locationid"],
     ["movement", "transfer", "stock", "godown", "warehouse", "shelf", "receipt"],
     ["location", "locationid"], [], True, "Godown/shelf destination"),
    ("camera.zone",
     ["camerazone", "cameraname", "cameraid", "channel", "camchannel", "zone", "zonename", "area", "role", "streamid"],
     ["camera", "cctv", "channel", "stream", "zone"],
     ["channel", "cameraid", "streamid"], [], True, "Camera channel and monitored zone"),
    ("staff.role",
     ["staffrole", "role", "designation", "duty", "jobtitle"],
     ["staff", "employee", "worker", "user", "role", "emp"], [], [], True, "DEO/staff task routing"),
    ("sale.quantity",
     ["saleqty", "soldqty", "unitsold", "billqty"],
     ["sale", "bill", "invoice", "pos"], [], [], False, "POS sale quantity"),
    ("damage.quantity",
     ["damageqty", "damagedunits", "wastage", "brokenqty"],
     ["damage", "stock", "item", "product"], [], [], False, "Damage quantity"),
    ("attendance.identity",
     ["badgeid", "staffid", "employeeid", "attendanceid"],
     ["attendance", "staff", "employee", "worker", "emp"], [], [], False, "Attendance identity"),
]
GENERIC_NAMES = ["id", "name", "role", "unit", "qty", "quantity"]
REPORT_TABLE_TOKENS = ["report", "rpt", "temp", "config", "setting", "form"]
DESTINATION_SUFFIX_PLUS = ["to", "dest", "destination"]
DESTINATION_SUFFIX_MINUS = ["from", "form", "source"]

# Table roles: (role, table tokens, column-signature groups, positive, negative)
ROLE_RULES = [
    ("product_catalog", ["product", "item", "sku", "catalog"],
     [["itemid", "productid", "itemcode", "productcode", "sku"], ["itemname", "productname", "description", "name"]],
     ["master", "mas", "mst", "catalog"], []),
    ("sale_header", ["sale", "invoice", "bill", "checkout", "pos"],
     [["saledate", "invoicedate", "billdate", "date"], ["netamt", "total", "grossamt", "amount"]],
     ["header", "hdr"], ["detail", "dtl", "line"]),
    ("sale_line", ["sale", "invoice", "bill", "checkout", "pos"],
     [["qty", "quantity", "soldqty"], ["itemid", "productid", "itemcode", "sku"]],
     ["detail", "dtl", "line"], []),
    ("purchase_header", ["purchase", "receipt", "receiving", "inward", "goodsreceived"],
     [["purchasedate", "receiptdate", "receiveddate", "date"], ["netamt", "total", "grossamt", "amount"]],
     ["header", "hdr"], ["detail", "dtl", "line"]),
    ("purchase_line", ["purchase", "receipt", "receiving", "inward", "goodsreceived"],
     [["qty", "quantity", "receivedqty"], ["itemid", "productid", "itemcode", "sku"]],
     ["detail", "dtl", "line"], []),
    ("inventory_stock", ["stock", "inventory", "onhand"],
     [["qty", "quantity", "onhand", "balance"], ["itemid", "productid", "itemcode", "sku"]],
     ["stock", "inventory"], []),
    ("stock_movement", ["movement", "transfer", "issue", "dispatch", "godown", "warehouse", "shelf"],
     [["qty", "quantity", "units"], ["destination", "source", "location", "godown", "warehouse", "shelf"]],
     ["movement", "transfer", "issue", "dispatch"], []),
    ("damage_expiry", ["damage", "expiry", "expired", "waste", "stock", "inventory"],
     [["damageqty", "expiryqty", "wastage", "brokenqty", "expdate"]],
     ["damage", "expiry", "waste"], []),
    ("staff_directory", ["staff", "employee", "worker", "user", "emp"],
     [["staffid", "employeeid", "userid", "empid", "uid"], ["role", "designation", "duty", "jobtitle"]],
     ["staff", "employee", "worker", "emp"], []),
    ("attendance", ["attendance", "shift", "punch", "timesheet"],
     [["staffid", "employeeid", "userid", "empid", "uid"], ["inat", "outat", "checkin", "checkout", "status", "shift"]],
     ["attendance", "punch", "timesheet"], []),
    ("camera_registry", ["camera", "cctv", "channel", "stream"],
     [["channel", "cameraid", "streamid"], ["role", "zone", "location", "name"]],
     ["camera", "cctv", "channel"], []),
    ("camera_events", ["camera", "event", "observation", "detection"],
     [["eventid", "observationid", "detectionid"], ["startedat", "endedat", "occurredat", "timestamp"],
      ["channel", "cameraid", "streamid"]],
     ["event", "observation", "detection"], []),
]
# Roles whose absence is reported as an unknown capability (in this order).
REQUIRED_ROLES = ["product_catalog", "purchase_header", "purchase_line", "sale_header", "sale_line",
                  "inventory_stock", "camera_registry", "camera_events", "staff_directory"]
CAPABILITY_THRESHOLDS = {"staff_directory": "0.80", "attendance": "0.80"}
DEFAULT_CAPABILITY_THRESHOLD = "0.60"
# Roles that rank a candidate database.
IMPORTANT_SQL_ROLES = ["product_catalog", "purchase_header", "purchase_line", "sale_header", "sale_line",
                       "inventory_stock", "stock_movement"]
# Readiness groups: (key, label, fields)
READINESS_GROUPS = [
    ("purchase_mapping", "Purchase and product mapping", ["product.identity", "purchase.quantity"]),
    ("pack_conversion", "Carton/pack/piece conversion", ["product.pack_size"]),
    ("locations", "Godown and shelf destinations", ["movement.destination"]),
    ("camera", "Camera source and zone purpose", ["camera.zone"]),
    ("routing", "DEO and staff role routing", ["staff.role"]),
]
# Fixed texts.
REASON_LEXICAL = "Matched normalized column name and canonical vocabulary."
REASON_PROVIDER = "Highest lexical and sample-type match; human verification required."
REASON_CONTRACT = "Verified by an authorized connector semantic contract, not lexical inference."
REASON_CARRIED = "Previously confirmed mapping remains present after schema rescan."
REASON_NO_INFERENCE = "The engine could not infer this required meaning safely."
AUTHORIZED = "authorized_connector_contract"
# ---------------------------------------------------------------------------

DEC = T.DecimalType(6, 4)
#: Shares into which the columns of one name are dealt when scores are joined back.
NAME_SHARES = 16


def _d(x: str) -> Column:
    return F.lit(Decimal(x)).cast(DEC)


def with_paths(catalog: DataFrame) -> DataFrame:
    """Add path, table_path, normalized and normalized_table."""
    return catalog.withColumns({
        "table_path": F.concat_ws(".", "source", "table"),
        "path": F.concat_ws(".", "source", "table", "column"),
        "normalized": normalize_name("column"),
        "normalized_table": normalize_name("table"),
    })


CANONICAL_DDL = ("canonical_field string, field_pos int, tokens array<string>, table_tokens array<string>, "
                 "weak_tokens array<string>, column_groups array<array<string>>, required boolean, label string")
ROLE_DDL = ("role string, role_pos int, table_tokens array<string>, groups array<array<string>>, "
            "positive array<string>, negative array<string>")


def canonical_rows() -> list[tuple]:
    return [(name, i, toks, ttoks, weak, groups, req, label)
            for i, (name, toks, ttoks, weak, groups, req, label) in enumerate(CANONICAL_FIELDS)]


def role_rows() -> list[tuple]:
    return [(r, i, t, g, p, n) for i, (r, t, g, p, n) in enumerate(ROLE_RULES)]


def _any_in(tokens: Column, text: Column, min_len: int = 0) -> Column:
    if min_len:
        return F.exists(tokens, lambda t: (F.length(t) >= min_len) & text.contains(t))
    return F.exists(tokens, lambda t: text.contains(t))


def _ends_any(text: Column, suffixes: list[str]) -> Column:
    out = None
    for s in suffixes:
        c = text.endswith(s)
        out = c if out is None else (out | c)
    return out


def _report_table(ntable: Column) -> Column:
    out = ntable.startswith("sys")
    for t in REPORT_TABLE_TOKENS:
        out = out | ntable.contains(t)
    return out


def score_mappings(catalog: DataFrame) -> DataFrame:
    """Every column x canonical field with a lexical score in [0, 0.98] (DECIMAL)."""
    cols = with_paths(catalog)
    # Scores depend only on (column name, table name): score each distinct pair
    # once (names repeat across a fleet) against the 9 fixed rules (a literal
    # array exploded per name, no join) and join the scores back.
    names = cols.select("normalized", "normalized_table").distinct()
    j = with_rules(names, canonical_rows(), CANONICAL_DDL)
    name, ntable = F.col("normalized"), F.col("normalized_table")
    table_match = _any_in(F.col("table_tokens"), ntable, 3)
    generic_blocked = name.isin(*GENERIC_NAMES) & ~table_match
    exact = F.array_contains("tokens", name)
    contained = _any_in(F.col("tokens"), name, 3)
    grouped = (F.size("column_groups") > 0) & F.forall(
        "column_groups", lambda g: F.exists(g, lambda t: name.contains(t)))
    column_score = (
        F.when(exact, F.when(F.array_contains("weak_tokens", name), _d("0.62")).otherwise(_d("0.78")))
        .when(contained, F.when(_any_in(F.col("weak_tokens"), name), _d("0.58")).otherwise(_d("0.66")))
        .when(grouped, _d("0.76"))
    )
    is_dest = F.col("canonical_field") == "movement.destination"
    score = (
        column_score
        + F.when(table_match, _d("0.20")).otherwise(_d("0"))
        + F.when(is_dest & _ends_any(name, DESTINATION_SUFFIX_PLUS), _d("0.16")).otherwise(_d("0"))
        - F.when(is_dest & _ends_any(name, DESTINATION_SUFFIX_MINUS), _d("0.30")).otherwise(_d("0"))
        - F.when(_report_table(ntable), _d("0.28")).otherwise(_d("0"))
    )
    final = F.when(generic_blocked | column_score.isNull(), _d("0")).otherwise(
        F.least(F.greatest(score, _d("0")), _d("0.98"))).cast(DEC)
    scored = j.select("normalized", "normalized_table", "canonical_field", "field_pos", "required", "label",
                      final.alias("score"))
    # A fleet has few names, each in most stores: a name's columns are dealt by store to NAME_SHARES tasks.
    scored = scored.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(NAME_SHARES - 1))))
    cols = cols.withColumn("_share", F.pmod(F.hash("store_id"), F.lit(NAME_SHARES)))
    return cols.join(scored, ["normalized", "normalized_table", "_share"]).select(
        "store_id", "canonical_field", "field_pos", "path", "source", "table", "column", "table_path",
        "source_pos", "table_pos", "column_pos", "required", "label", "score",
    )


def _doc_order() -> list[Column]:
    return [F.col("source_pos"), F.col("table_pos"), F.col("column_pos")]


def mapping_candidates(scores: DataFrame, limit: int = 5) -> DataFrame:
    """Top ``limit`` positive candidates per (store, field); ties keep document order."""
    w = Window.partitionBy("store_id", "canonical_field").orderBy(F.col("score").desc(), *_doc_order())
    return (
        scores.where(F.col("score") > 0)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= limit)
    )


def propose_mappings(scores: DataFrame, stores: DataFrame, provider=None) -> DataFrame:
    """Best mapping per (store, field).

    Below 0.80 the ``provider`` re-chooses among the top 5; the default provider
    keeps the first candidate at 0.65.  ``provider`` is a function
    ``(canonical Column, candidates array<string> Column) -> struct<path, score, reason>``
    so custom rankers stay Column expressions (or a pandas_udf).
    """
    cands = mapping_candidates(scores, 5)
    top = cands.groupBy("store_id", "canonical_field").agg(
        F.min(F.struct("rank", "path", "score", "field_pos", "required", "label")).alias("best"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("candidates"),
    )
    best_score = F.col("best.score")
    if provider is None:
        chosen = F.struct(F.col("candidates")[0].alias("path"), _d("0.65").alias("score"),
                          F.lit(REASON_PROVIDER).alias("reason"))
    else:
        chosen = provider(F.col("canonical_field"), F.col("candidates"))
    low = best_score < _d("0.80")
    path = F.when(low & chosen["path"].isNotNull(), chosen["path"]).otherwise(F.col("best.path"))
    conf = F.when(low & chosen["path"].isNotNull(), F.greatest(best_score, chosen["score"].cast(DEC))).otherwise(best_score)
    reason = F.when(low & chosen["path"].isNotNull(), chosen["reason"]).otherwise(F.lit(REASON_LEXICAL))
    j = top.join(stores.select("store_id", "requires_confirmation").hint("merge"), "store_id", "left")
    return j.select(
        "store_id", "canonical_field",
        F.col("best.field_pos").alias("field_pos"),
        path.alias("source_path"),
        F.round(conf, 2).cast(T.DecimalType(4, 2)).alias("confidence"),
        reason.alias("reasoning"),
        ((conf >= _d("0.95")) & ~F.coalesce(F.col("requires_confirmation"), F.lit(False))).alias("verified"),
    )


def apply_contracts(mappings: DataFrame, contracts: DataFrame) -> DataFrame:
    """A proposal equal to an authorized connector contract becomes verified at 1.0."""
    c = contracts.where(
        (F.col("authority") == AUTHORIZED) & F.col("canonical_field").isNotNull()
        & F.col("table").isNotNull() & F.col("column").isNotNull()
    ).select("store_id", "canonical_field", F.concat_ws(".", "source", "table", "column").alias("_cpath"),
             F.coalesce(F.col("contract_pos"), F.lit(0)).alias("_cpos"))
    # the last contract for a field wins
    last = c.groupBy("store_id", "canonical_field").agg(F.max(F.struct("_cpos", "_cpath"))["_cpath"].alias("_cpath"))
    j = mappings.join(last, ["store_id", "canonical_field"], "left")
    hit = F.col("_cpath").isNotNull() & (F.col("_cpath") == F.col("source_path"))
    return j.select(
        *[c for c in mappings.columns if c not in ("confidence", "reasoning", "verified")],
        F.when(hit, F.lit(Decimal("1.00")).cast(T.DecimalType(4, 2))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(hit, F.lit(REASON_CONTRACT)).otherwise(F.col("reasoning")).alias("reasoning"),
        F.when(hit, F.lit(True)).otherwise(F.col("verified")).alias("verified"),
    )


def carry_forward_mappings(mappings: DataFrame, previous: DataFrame, catalog: DataFrame) -> DataFrame:
    """Previously verified mappings whose path still exists replace or add a field."""
    paths = with_paths(catalog).select("store_id", F.col("path").alias("source_path")).distinct()
    kept = (
        previous.where(F.col("verified") == True)  # noqa: E712
        .join(paths, ["store_id", "source_path"], "left_semi")
        .select("store_id", "canonical_field", F.col("source_path").alias("_prev_path"))
    )
    j = mappings.join(kept, ["store_id", "canonical_field"], "full")
    restored = F.col("_prev_path").isNotNull()
    field_pos = F.coalesce(F.col("field_pos"), F.lit(len(CANONICAL_FIELDS)))
    return j.select(
        "store_id", "canonical_field", field_pos.alias("field_pos"),
        F.when(restored, F.col("_prev_path")).otherwise(F.col("source_path")).alias("source_path"),
        F.when(restored, F.lit(Decimal("1.00")).cast(T.DecimalType(4, 2))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(restored, F.lit(REASON_CARRIED)).otherwise(F.col("reasoning")).alias("reasoning"),
        F.when(restored, F.lit(True)).otherwise(F.col("verified")).alias("verified"),
    )


def setup_questions(mappings: DataFrame, scores: DataFrame, stores: DataFrame) -> DataFrame:
    """One question per store and required field that is missing or unverified."""
    cands = mapping_candidates(scores, 5).groupBy("store_id", "canonical_field").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("candidates"))
    required = [(n, i, lab) for i, (n, _t, _tt, _w, _g, req, lab) in enumerate(CANONICAL_FIELDS) if req]
    grid = with_rules(stores.select("store_id"), required, "canonical_field string, field_pos int, label string")
    j = (grid.join(mappings.select("store_id", "canonical_field", "source_path", "confidence", "verified"),
                   ["store_id", "canonical_field"], "left")
         .join(cands, ["store_id", "canonical_field"], "left"))
    missing = F.col("source_path").isNull()
    label = F.lower(F.col("label"))
    options = F.array_distinct(F.concat(F.coalesce(F.col("candidates"), F.array().cast("array<string>")),
                                        F.array(F.col("source_path"), F.lit("none_of_these"))))
    return j.where(missing | ~F.col("verified")).select(
        "store_id",
        F.concat(F.when(missing, F.lit("map:")).otherwise(F.lit("verify:")), F.col("canonical_field")).alias("key"),
        "field_pos",
        F.when(missing, F.concat(F.lit("Which source field represents "), label, F.lit("?")))
        .otherwise(F.concat(F.lit("Does `"), F.col("source_path"), F.lit("` represent "), label, F.lit("?")))
        .alias("prompt"),
        F.when(missing, F.lit(REASON_NO_INFERENCE)).otherwise(
            F.concat(F.lit("Proposed at confidence "), F.format_string("%.2f", F.col("confidence").cast("double")),
                     F.lit("; important meanings require confirmation."))).alias("reason"),
        F.when(missing, F.array().cast("array<string>")).otherwise(options).alias("options"),
        F.lit(False).alias("resolved"),
    )


def readiness(mappings: DataFrame, questions: DataFrame, stores: DataFrame) -> DataFrame:
    """Five readiness checks per store; ready = all passed and no unresolved question."""
    grid = with_rules(stores.select("store_id"), readiness_rows(), READINESS_DDL)
    j = grid.join(mappings.select("store_id", "canonical_field", "verified"), ["store_id", "canonical_field"], "left")
    per_check = j.groupBy("store_id", "check_key", "check_pos").agg(
        F.array_sort(F.collect_list(F.when(~F.coalesce(F.col("verified"), F.lit(False)),
                                           F.struct("field_order", "canonical_field")))).alias("missing"))
    per_check = per_check.select(
        "store_id", "check_pos",
        (F.size("missing") == 0).alias("passed"),
        F.concat(F.col("check_key"), F.lit(":"), F.when(F.size("missing") == 0, F.lit("Verified")).otherwise(
            F.concat(F.lit("Awaiting: "), F.array_join(F.transform("missing", lambda m: m["canonical_field"]), ", ")))
        ).alias("detail"),
    )
    unresolved = questions.where(~F.col("resolved")).groupBy("store_id").agg(
        F.count(F.lit(1)).alias("unresolved_questions"))
    agg = per_check.groupBy("store_id").agg(
        F.sum(F.col("passed").cast("int")).cast("int").alias("checks_passed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("check_pos", "detail"))), lambda x: x["detail"]),
                     " | ").alias("detail"),
    )
    out = agg.join(unresolved, "store_id", "left").fillna(0, ["unresolved_questions"])
    return out.select(
        "store_id",
        ((F.col("checks_passed") == len(READINESS_GROUPS)) & (F.col("unresolved_questions") == 0)).alias("ready"),
        F.col("unresolved_questions").cast("bigint").alias("unresolved_questions"),
        "checks_passed",
        "detail",
    )


READINESS_DDL = "check_key string, check_pos int, label string, canonical_field string, field_order int"


def readiness_rows() -> list[tuple]:
    return [(k, i, lab, f, j) for i, (k, lab, fs) in enumerate(READINESS_GROUPS) for j, f in enumerate(fs)]


# --- table roles -------------------------------------------------------------

def table_profiles(catalog: DataFrame) -> DataFrame:
    """One row per (store, table): normalized column set (bounded by the schema)."""
    c = with_paths(catalog)
    return c.groupBy("store_id", "source", "source_pos", "table", "table_pos", "table_path", "normalized_table").agg(
        F.collect_set("normalized").alias("columns"),
        F.max("row_count").alias("row_count"),
    )


def score_table_roles(catalog: DataFrame, keep_threshold: str = "0.50") -> DataFrame:
    """Table x role confidence (2 dp, clamp 0..0.96) with evidence; keeps >= 0.50."""
    profiles = table_profiles(catalog).withColumn("columns", F.array_sort("columns"))
    # Role scores depend only on (table name, column-name set): score distinct shapes once.
    shapes = profiles.select("normalized_table", "columns").distinct()
    t = with_rules(shapes, role_rows(), ROLE_DDL)  # 12 fixed rules per distinct shape, no join
    ntable, cols = F.col("normalized_table"), F.col("columns")
    tmatch = _any_in(F.col("table_tokens"), ntable)
    matched = F.size(F.filter("groups", lambda g: F.exists(cols, lambda c: F.exists(g, lambda tok: c.contains(tok)))))
    n_groups = F.size("groups")
    pos, neg, rep = _any_in(F.col("positive"), ntable), _any_in(F.col("negative"), ntable), _report_table(ntable)
    raw = (
        F.when(tmatch, _d("0.38")).otherwise(_d("0"))
        + F.when(n_groups > 0, (F.lit(Decimal("0.44")).cast(T.DecimalType(10, 6)) * matched / n_groups)).otherwise(_d("0"))
        + F.when(pos, _d("0.14")).otherwise(_d("0"))
        - F.when(neg, _d("0.22")).otherwise(_d("0"))
        - F.when(rep, _d("0.28")).otherwise(_d("0"))
    )
    conf = F.round(F.least(F.greatest(raw, _d("0")), _d("0.96")), 2).cast(T.DecimalType(4, 2))
    evidence = F.array_compact(F.array(
        F.when(tmatch, F.lit("table name matches the operational vocabulary")),
        F.when(matched > 0, F.concat(matched.cast("string"), F.lit("/"), n_groups.cast("string"),
                                     F.lit(" expected column signatures matched"))),
        F.when(pos, F.lit("table shape modifier supports this role")),
        F.when(neg, F.lit("table shape modifier conflicts with this role")),
        F.when(rep, F.lit("report/configuration shape reduces operational confidence")),
    ))
    scored = t.select("normalized_table", "columns", "role", "role_pos", conf.alias("confidence"),
                      evidence.alias("evidence")).where(F.col("confidence") >= F.lit(Decimal(keep_threshold)))
    out = profiles.join(scored, ["normalized_table", "columns"])
    return out.select(
        "store_id", "role", "role_pos", F.col("table_path").alias("source_path"), "source_pos", "table_pos",
        "confidence", "evidence", "row_count",
    )


def role_candidates(role_scores: DataFrame, limit: int | None = 5) -> DataFrame:
    """Top ``limit`` tables (None: all, ranked) per (store, role) by (confidence, row_count) desc, document order."""
    w = Window.partitionBy("store_id", "role").orderBy(
        F.col("confidence").desc(), F.coalesce(F.col("row_count"), F.lit(0)).desc(), "source_pos", "table_pos")
    ranked = role_scores.withColumn("rank", F.row_number().over(w))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def infer_relationships(cands: DataFrame, catalog: DataFrame) -> DataFrame:
    """Shared-identifier joins among the top-2 candidate tables of every role.

    Pairs are (left < right by table path) within one store; the schema bounds
    the pair count, and the equi-join key includes the store.
    """
    top2 = cands.where(F.col("rank") <= 2).select("store_id", F.col("source_path").alias("table_path")).distinct()
    c = with_paths(catalog).where(
        (F.length("normalized") >= 5) & (F.col("normalized").endswith("id") | F.col("normalized").endswith("code")))
    # one column per normalized name and table (the last one in document order)
    c = c.groupBy("store_id", "table_path", "normalized").agg(
        F.max(F.struct("column_pos", "column", "primary_key")).alias("c"))
    c = c.join(top2, ["store_id", "table_path"], "left_semi")
    left = c.select("store_id", F.col("table_path").alias("from_table"), "normalized",
                    F.col("c.column").alias("from_column"), F.col("c.primary_key").alias("lpk"))
    right = c.select("store_id", F.col("table_path").alias("to_table"), "normalized",
                     F.col("c.column").alias("to_column"), F.col("c.primary_key").alias("rpk"))
    pairs = left.join(right, ["store_id", "normalized"]).where(F.col("from_table") < F.col("to_table"))
    has_key = F.coalesce(F.col("lpk"), F.lit(False)) | F.coalesce(F.col("rpk"), F.lit(False))
    w = Window.partitionBy("store_id", "from_table", "to_table").orderBy(has_key.desc(), "normalized")
    best = pairs.withColumn("_k", has_key).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    w2 = Window.partitionBy("store_id").orderBy("from_table", "to_table")
    best = best.withColumn("pair_rank", F.row_number().over(w2))
    return best.select(
        "store_id",
        F.lit("inferred_shared_identifier").alias("kind"),
        "from_table", "from_column", "to_table", "to_column",
        F.when(F.col("_k"), F.lit(0.82)).otherwise(F.lit(0.64)).alias("confidence"),
        F.lit(False).alias("verified"),
        "pair_rank",
    )


def all_relationships(declared: DataFrame, inferred: DataFrame) -> DataFrame:
    """Declared (tables qualified by source) union inferred relationships."""
    d = declared.select(
        "store_id", "kind",
        F.concat_ws(".", "source", "from_table").alias("from_table"), "from_column",
        F.concat_ws(".", "source", "to_table").alias("to_table"), "to_column",
        F.col("confidence").cast("double").alias("confidence"), F.lit(False).alias("verified"))
    return d.unionByName(inferred.drop("pair_rank"))


def capabilities(cands: DataFrame, contracts: DataFrame, stores: DataFrame) -> DataFrame:
    """Observed capabilities (sorted) and unknown required roles per store."""
    best = cands.where(F.col("rank") == 1)
    thr = F.create_map(*[F.lit(x) for kv in CAPABILITY_THRESHOLDS.items() for x in (kv[0], Decimal(kv[1]))])
    thr_col = F.coalesce(F.element_at(thr, F.col("role")), F.lit(Decimal(DEFAULT_CAPABILITY_THRESHOLD)))
    observed = best.where(F.col("confidence") >= thr_col).select("store_id", "role")
    contracted = contracts.where(
        (F.col("canonical_field") == "staff.role") & (F.col("authority") == AUTHORIZED)
    ).select("store_id", F.lit("staff_directory").alias("role"))
    caps = observed.unionByName(contracted).distinct()
    agg = caps.groupBy("store_id").agg(F.array_sort(F.collect_list("role")).alias("caps"))
    j = stores.select("store_id").join(agg, "store_id", "left")
    caps_col = F.coalesce(F.col("caps"), F.array().cast("array<string>"))
    required = F.array(*[F.lit(r) for r in REQUIRED_ROLES])
    return j.select(
        "store_id",
        F.array_join(caps_col, ",").alias("capabilities"),
        F.array_join(F.filter(required, lambda r: ~F.array_contains(caps_col, r)), ",").alias("unknowns"),
    )


def schema_totals(catalog: DataFrame, relationships: DataFrame | None = None, channels: DataFrame | None = None) -> DataFrame:
    """Discovered table / column / relationship / camera channel counts per store."""
    c = with_paths(catalog)
    t = c.groupBy("store_id").agg(
        F.countDistinct("table_path").alias("table_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.countDistinct("source").alias("source_count"),
    )
    if relationships is not None:
        r = relationships.groupBy("store_id").agg(F.count(F.lit(1)).alias("relationship_count"))
        t = t.join(r, "store_id", "left").fillna(0, ["relationship_count"])
    if channels is not None:
        c = channels.groupBy("store_id").agg(F.count(F.lit(1)).alias("camera_channel_count"))
        t = t.join(c, "store_id", "left").fillna(0, ["camera_channel_count"])
    return t


def rank_databases(role_scores: DataFrame, catalog: DataFrame, group_col: str = "server") -> DataFrame:
    """Score each candidate database and pick the best per ``group_col``.

    score = 10 * sum(strong role confidence) + 5 * #strong + min(tables, 500)/100
            + min(columns, 20000)/10000 over the important roles (strong >= 0.60).
    ``role_scores`` must carry ``group_col``; databases are ``store_id`` rows.
    """
    best = role_candidates(role_scores, 1).where(F.col("role").isin(*IMPORTANT_SQL_ROLES))
    strong = best.where(F.col("confidence") >= F.lit(Decimal("0.60")))
    s = strong.groupBy("store_id").agg(
        F.sum("confidence").alias("strength"), F.count(F.lit(1)).alias("strong_roles"),
        F.array_join(F.array_sort(F.collect_list("role")), ",").alias("operational_roles"))
    totals = schema_totals(catalog).join(catalog.select("store_id", group_col).distinct(), "store_id")
    j = totals.join(s, "store_id", "left").fillna(0, ["strong_roles"])
    score = (
        F.coalesce(F.col("strength"), F.lit(Decimal(0))).cast(T.DecimalType(12, 4)) * 10
        + F.col("strong_roles") * 5
        + F.least(F.col("table_count"), F.lit(500)).cast(T.DecimalType(12, 4)) / 100
        + F.least(F.col("column_count"), F.lit(20000)).cast(T.DecimalType(12, 4)) / 10000
    )
    j = j.withColumn("score", F.round(score, 3).cast(T.DecimalType(12, 3))).withColumn(
        "eligible", F.col("strong_roles") > 0)
    return _select_best(j, group_col, "store_id").select(
        group_col, F.col("store_id").alias("database"), F.col("score").cast("double").alias("score"), "eligible",
        "table_count", "column_count", F.coalesce(F.col("operational_roles"), F.lit("")).alias("operational_roles"),
        "selected")


def rank_collectors(channels: DataFrame, event_tables: DataFrame, group_col: str = "store_id") -> DataFrame:
    """score = 10 * channels + 5 * event tables; eligible if channels > 0; best per group."""
    ch = channels.groupBy(group_col, "root").agg(F.count(F.lit(1)).alias("camera_channels"))
    et = event_tables.groupBy(group_col, "root").agg(F.count(F.lit(1)).alias("event_tables"))
    j = ch.join(et, [group_col, "root"], "full").fillna(0, ["camera_channels", "event_tables"])
    j = j.withColumn("score", F.col("camera_channels") * 10 + F.col("event_tables") * 5).withColumn(
        "eligible", F.col("camera_channels") > 0)
    return _select_best(j, group_col, "root")


def _select_best(ranked: DataFrame, group_col: str, name: str) -> DataFrame:
    """Marks the eligible row of each group with the highest score (ties: smallest name).

    The winner is an aggregation with partial sums, joined back, so a group that
    holds most rows is never sorted in one task.
    """
    best = ranked.where("eligible").groupBy(F.col(group_col).alias("_group")).agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.col(name).alias("name"))).alias("_best"))
    joined = ranked.join(best, ranked[group_col].eqNullSafe(best["_group"]), "left")
    selected = F.coalesce(F.col("eligible") & (F.col(name) == F.col("_best.name")), F.lit(False))
    return joined.withColumn("selected", selected).drop("_group", "_best")


def mapping_targets(mappings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Unverified mappings into the store's one SQL source, with their (table, column, type)."""
    from storelens.operators.factplan import selected_sql_source

    own = catalog.join(selected_sql_source(catalog), ["store_id", "source"], "left_semi")
    c = with_paths(own).select("store_id", F.col("path").alias("source_path"), "table_path", "table", "column",
                                   "type", "primary_key")
    return mappings.where(~F.col("verified")).join(c, ["store_id", "source_path"])


def select_source(sources: DataFrame, server: Column | str, database: Column | str) -> DataFrame:
    """Per store: the SQL Server source matching (server, database) case-insensitively,
    else the first SQL Server source in document order."""
    srv = F.lower(server if isinstance(server, Column) else F.lit(server))
    db = F.lower(database if isinstance(database, Column) else F.lit(database))
    s = sources.where(F.col("kind") == "sqlserver")
    exact = (F.lower(F.coalesce(F.col("source_server"), F.lit(""))) == srv) & (
        F.lower(F.coalesce(F.col("source_database"), F.lit(""))) == db)
    w = Window.partitionBy("store_id").orderBy(exact.desc(), "source_pos")
    return s.withColumn("exact_match", exact).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
