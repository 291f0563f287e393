"""Resolve a fact-extraction plan per (store, operation) from learned metadata
(SURVEY §2.4 ``resolve_fact_plan`` / ``structural_confidence``).

Everything is an aggregation or a join over catalog-sized tables (roles,
relationships, mappings, columns), one plan row per store and operation; a store
without a reliable plan gets ``plan_ok = false`` and the reason.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.operators.catalog import with_paths

OPERATIONS = ("purchase", "sale")
MIN_ROLE = Decimal("0.80")
MIN_JOIN = 0.80
DEFAULT_QUANTITY_CONFIDENCE = 0.78

# Column names by signature, exact names in order of preference and contained tokens.
DATE_NAMES, DATE_TOKENS = ("transactiondate", "businessdate", "date"), ("date", "createdat", "occurredat")
TIME_NAMES, TIME_TOKENS = ("transactiontime", "time"), ("time",)
QUANTITY_NAMES, QUANTITY_TOKENS = ("qty", "quantity", "soldqty", "receivedqty"), ("quantity",)
LINE_ID_NAMES, LINE_ID_TOKENS = ("lineid", "detailid"), ("dtlid", "lineid")
DESTINATION_NAMES = ("destinationid", "locationid", "godownid", "gowdownid", "warehouseid", "shelfid")
DESTINATION_TOKENS = ("destination", "location", "godown", "gowdown", "warehouse", "shelf")
# Why a store has no plan.
NO_SOURCE = "the store has no SQL source"
NO_TABLES = "no header, line and product tables are known well enough"
NO_JOINS = "no join of the plan's tables is known well enough"
NO_COLUMNS = "a date, quantity, product identity or line identity column is missing"


def signatures(op: str) -> dict[str, tuple[tuple[str, ...], tuple[str, ...]]]:
    """(exact names in preference order, contained tokens) per column signature."""
    return {
        "date": ((f"{op}date", *DATE_NAMES), DATE_TOKENS),
        "time": ((f"{op}time", *TIME_NAMES), TIME_TOKENS),
        "quantity": (QUANTITY_NAMES, QUANTITY_TOKENS),
        "line_id": ((f"{op}dtlid", *LINE_ID_NAMES), LINE_ID_TOKENS),
        "destination": (DESTINATION_NAMES, DESTINATION_TOKENS),
    }


def _signature_key(exact: tuple[str, ...], contains: tuple[str, ...]) -> Column:
    """(preference, position, column) of a column that matches, else null; the smallest wins."""
    n = F.col("normalized")
    rank = F.array_position(F.array(*map(F.lit, exact)), n)
    token = F.lit(False)
    for t in contains:
        token = token | n.contains(t)
    level = F.when(rank > 0, rank.cast("int")).when(token, F.lit(len(exact) + 1))
    return F.when(level.isNotNull(), F.struct(level.alias("level"), F.col("column_pos").alias("pos"), F.col("column").alias("column")))


def table_signatures(cols: DataFrame) -> DataFrame:
    """One row per (store, table): its column of every signature and operation, and its key column."""
    picks = [F.min(_signature_key(*sig))["column"].alias(f"{op}_{name}") for op in OPERATIONS for name, sig in signatures(op).items()]
    key = F.min(F.when(F.col("primary_key"), F.struct("column_pos", "column")))["column"].alias("key_column")
    return cols.groupBy("store_id", "table_path").agg(*picks, key)


def selected_sql_source(catalog: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(store_id, source): the store's one SQL source.

    With ``wanted`` (store_id, server, database) the source whose server and
    database match wins, else the first SQL source in document order.
    """
    sql = catalog.where(F.col("source_kind") == "sqlserver")
    exact = F.lit(1)
    if wanted is not None:
        want = wanted.select("store_id", F.lower("server").alias("_server"), F.lower("database").alias("_database"))
        sql = sql.join(want, "store_id", "left")
        match = (F.lower("source_server") == F.col("_server")) & (F.lower("source_database") == F.col("_database"))
        exact = F.when(F.coalesce(match, F.lit(False)), 0).otherwise(1)
    return sql.groupBy("store_id").agg(F.min(F.struct(exact.alias("e"), "source_pos", "source"))["source"].alias("source"))


def _directed(relationships: DataFrame) -> DataFrame:
    """Both directions of every trusted relationship; the smallest ``rank`` of a table pair is preferred."""
    r = relationships.where(F.col("confidence") >= MIN_JOIN)
    rank = F.struct((-F.col("confidence")).alias("c"), "from_table", "from_column", "to_table", "to_column")

    def way(a: str, b: str) -> DataFrame:
        return r.select("store_id", F.col(f"{a}_table").alias("left_table"), F.col(f"{b}_table").alias("right_table"),
                        F.struct(rank.alias("rank"), F.col(f"{a}_column").alias("left"), F.col(f"{b}_column").alias("right"),
                                 "confidence").alias("j"))

    return way("from", "to").unionByName(way("to", "from")).groupBy("store_id", "left_table", "right_table").agg(
        F.min("j").alias("j"))


def resolve_fact_plan(role_cands: DataFrame, relationships: DataFrame, mappings: DataFrame,
                      catalog: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """One plan row per (store, operation), over the store's one SQL source.

    ``role_cands`` must hold every ranked candidate, not the top few: a later
    table may be the first usable one.  Roles, mappings and signatures are each
    reduced to one row per store or table before they are joined.
    """
    stores = catalog.select("store_id").distinct()
    source = selected_sql_source(catalog, wanted)
    cols = with_paths(catalog).join(source, ["store_id", "source"], "left_semi")
    tables = cols.select("store_id", F.col("table_path").alias("source_path")).distinct()
    usable = role_cands.where((F.col("confidence") >= F.lit(MIN_ROLE)) & (F.coalesce(F.col("row_count"), F.lit(0)) > 0)).join(
        tables, ["store_id", "source_path"], "left_semi")
    pick = F.struct("rank", "source_path", F.col("confidence").cast("double").alias("confidence"))
    roles = [f"{op}_{part}" for op in OPERATIONS for part in ("header", "line")] + ["product_catalog"]
    best = usable.groupBy("store_id").agg(*[F.min(F.when(F.col("role") == r, pick)).alias(r) for r in roles])
    known = mappings.join(cols.select("store_id", F.col("path").alias("source_path"), "table_path", "column"), ["store_id", "source_path"])
    mapped = F.struct("table_path", "column", F.col("confidence").cast("double").alias("confidence"), "verified")
    fields = {"identity": "product.identity", "pack": "product.pack_size", **{op: f"{op}.quantity" for op in OPERATIONS}}
    by_field = known.groupBy("store_id").agg(
        *[F.min(F.when(F.col("canonical_field") == f, mapped)).alias(f"{n}_mapping") for n, f in fields.items()])
    base = stores.join(source, "store_id", "left").join(best, "store_id", "left").join(by_field, "store_id", "left")

    def side(op: str) -> Column:
        return F.struct(F.lit(op).alias("operation"), F.col(f"{op}_header").alias("header"), F.col(f"{op}_line").alias("line"),
                        F.col("product_catalog").alias("product"), F.col(f"{op}_mapping").alias("quantity"))

    plans = base.select("store_id", F.col("source").isNotNull().alias("has_source"), "identity_mapping", "pack_mapping",
                        F.explode(F.array(*[side(op) for op in OPERATIONS])).alias("p")).select(
        "store_id", "has_source", "identity_mapping", "pack_mapping", "p.*",
        F.col("p.header.source_path").alias("header_table"), F.col("p.line.source_path").alias("line_table"),
        F.col("p.product.source_path").alias("product_table"))
    found = table_signatures(cols)
    of_op = lambda name: F.when(F.col("operation") == "purchase", F.col(f"purchase_{name}")).otherwise(F.col(f"sale_{name}"))
    header = found.select("store_id", F.col("table_path").alias("header_table"),
                          *[f"{op}_{n}" for op in OPERATIONS for n in ("date", "time")])
    line = found.select("store_id", F.col("table_path").alias("line_table"), "key_column",
                        *[f"{op}_{n}" for op in OPERATIONS for n in ("quantity", "line_id", "destination")])
    directed = _directed(relationships)
    joins = lambda a, b, out: directed.select("store_id", F.col("left_table").alias(a), F.col("right_table").alias(b), F.col("j").alias(out))
    plans = (plans.join(header, ["store_id", "header_table"], "left").join(line, ["store_id", "line_table"], "left")
             .join(joins("header_table", "line_table", "hj"), ["store_id", "header_table", "line_table"], "left")
             .join(joins("line_table", "product_table", "pj"), ["store_id", "line_table", "product_table"], "left"))

    on = lambda mapping, table: F.when(F.col(f"{mapping}.table_path") == F.col(table), F.col(mapping))
    quantity, identity, pack = on("quantity", "line_table"), on("identity_mapping", "product_table"), on("pack_mapping", "product_table")
    quantity_col = F.coalesce(quantity["column"], of_op("quantity"))
    line_id = F.coalesce(F.col("key_column"), of_op("line_id"))
    structural = F.least(F.col("header.confidence"), F.col("line.confidence"), F.col("product.confidence"),
                         F.col("hj.confidence"), F.col("pj.confidence"), identity["confidence"],
                         F.coalesce(quantity["confidence"], F.lit(DEFAULT_QUANTITY_CONFIDENCE)))
    reason = (
        F.when(~F.col("has_source"), F.lit(NO_SOURCE))
        .when(F.col("header_table").isNull() | F.col("line_table").isNull() | F.col("product_table").isNull(), F.lit(NO_TABLES))
        .when(F.col("hj").isNull() | F.col("pj").isNull(), F.lit(NO_JOINS))
        .when(of_op("date").isNull() | quantity_col.isNull() | identity["column"].isNull() | line_id.isNull(), F.lit(NO_COLUMNS))
    )
    verified = (F.coalesce(identity["verified"], F.lit(False)) & F.coalesce(quantity["verified"], F.lit(False))
                & (pack["column"].isNull() | F.coalesce(pack["verified"], F.lit(False))))
    return plans.select(
        "store_id", "operation", reason.isNull().alias("plan_ok"), reason.alias("reason"),
        "header_table", "line_table", "product_table",
        F.col("hj.left").alias("header_id_col"), F.col("hj.right").alias("line_header_col"),
        F.col("pj.left").alias("line_product_col"), F.col("pj.right").alias("product_key_col"),
        of_op("date").alias("date_col"), of_op("time").alias("time_col"),
        quantity_col.alias("quantity_col"), identity["column"].alias("product_identity_col"),
        pack["column"].alias("pack_size_col"), line_id.alias("line_id_col"),
        of_op("destination").alias("destination_col"),
        F.when(reason.isNull(), structural).alias("structural_confidence"),
        F.when(reason.isNull(), verified).alias("mapping_verified"),
    )
