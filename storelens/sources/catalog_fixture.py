"""Schema catalogs of a fleet of stores, derived from the driver tables.

Every ``customer`` is a store; its schema follows one of three templates
(``c_custkey % 3``): a messy legacy export, a clean JSON API and a SQL Server
database with keys, foreign keys, a report table and a transfer table.  Row counts
come from the store's orders, so catalog work grows with the data.  Every fourth
SQL Server store (by key) also has a JSON API, listed before its database.  The
templates are made-up stores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.functions.cache import frame_cached
from storelens.sources.tables import table

# ---------------------------------------------------------------------------
# Fixed template values: (template, source, kind, table, column, type, primary_key)
# ---------------------------------------------------------------------------
TEMPLATE_COLUMNS = [
    (0, "shop_export", "sql_server_schema_export", "ItemMaster", "ItemCode", "varchar", False),
    (0, "shop_export", "sql_server_schema_export", "ItemMaster", "ItemLabel", "varchar", False),
    (0, "shop_export", "sql_server_schema_export", "ItemMaster", "PackFactor", "integer", False),
    (0, "shop_export", "sql_server_schema_export", "InwardRows", "ItemCodeRef", "varchar", False),
    (0, "shop_export", "sql_server_schema_export", "InwardRows", "QtyIn", "decimal", False),
    (0, "shop_export", "sql_server_schema_export", "InwardRows", "LooseUnits", "integer", False),
    (0, "shop_export", "sql_server_schema_export", "InwardRows", "GodownNo", "varchar", False),
    (0, "shop_export", "sql_server_schema_export", "CctvFeeds", "ChannelNo", "varchar", False),
    (0, "shop_export", "sql_server_schema_export", "CctvFeeds", "AreaName", "varchar", False),
    (0, "shop_export", "sql_server_schema_export", "EmpRecords", "EmpCode", "varchar", False),
    (0, "shop_export", "sql_server_schema_export", "EmpRecords", "DutyTitle", "varchar", False),
    (0, "shop_export", "sql_server_schema_export", "EmpRecords", "BadgeCode", "varchar", False),
    (0, "shop_export", "sql_server_schema_export", "BillRows", "ItemCodeRef", "varchar", False),
    (0, "shop_export", "sql_server_schema_export", "BillRows", "BillQty", "integer", False),
    (1, "shop_api", "json_schema", "catalog_items", "sku_code", "string", False),
    (1, "shop_api", "json_schema", "catalog_items", "pieces_per_box", "integer", False),
    (1, "shop_api", "json_schema", "receipt_lines", "receipt_qty", "integer", False),
    (1, "shop_api", "json_schema", "receipt_lines", "item_code", "string", False),
    (1, "shop_api", "json_schema", "receipt_lines", "location_id", "string", False),
    (1, "shop_api", "json_schema", "camera_streams", "zone_name", "string", False),
    (1, "shop_api", "json_schema", "crew", "duty_role", "string", False),
    (1, "shop_api", "json_schema", "crew", "staff_id", "string", False),
    (1, "shop_api", "json_schema", "checkout_lines", "sold_units", "integer", False),
    (2, "store_sql", "sqlserver", "dbo.Products", "ProductId", "int", True),
    (2, "store_sql", "sqlserver", "dbo.Products", "SKU", "nvarchar", False),
    (2, "store_sql", "sqlserver", "dbo.Products", "ProductName", "nvarchar", False),
    (2, "store_sql", "sqlserver", "dbo.Products", "UnitsPerCase", "int", False),
    (2, "store_sql", "sqlserver", "dbo.Receipts", "ReceiptId", "int", True),
    (2, "store_sql", "sqlserver", "dbo.Receipts", "ReceiptDate", "datetime", False),
    (2, "store_sql", "sqlserver", "dbo.Receipts", "TotalAmount", "money", False),
    (2, "store_sql", "sqlserver", "dbo.ReceiptLines", "LineId", "int", True),
    (2, "store_sql", "sqlserver", "dbo.ReceiptLines", "ReceiptId", "int", False),
    (2, "store_sql", "sqlserver", "dbo.ReceiptLines", "ProductId", "int", False),
    (2, "store_sql", "sqlserver", "dbo.ReceiptLines", "Quantity", "decimal", False),
    (2, "store_sql", "sqlserver", "dbo.ReceiptLines", "DestinationId", "nvarchar", False),
    (2, "store_sql", "sqlserver", "dbo.SaleHeader", "SaleId", "int", True),
    (2, "store_sql", "sqlserver", "dbo.SaleHeader", "SaleDate", "datetime", False),
    (2, "store_sql", "sqlserver", "dbo.SaleHeader", "NetAmt", "money", False),
    (2, "store_sql", "sqlserver", "dbo.SaleLines", "SaleDtlId", "int", True),
    (2, "store_sql", "sqlserver", "dbo.SaleLines", "SaleId", "int", False),
    (2, "store_sql", "sqlserver", "dbo.SaleLines", "ProductId", "int", False),
    (2, "store_sql", "sqlserver", "dbo.SaleLines", "SoldQty", "int", False),
    (2, "store_sql", "sqlserver", "dbo.StockTransfer", "TransferId", "int", True),
    (2, "store_sql", "sqlserver", "dbo.StockTransfer", "GoDownForm", "int", False),
    (2, "store_sql", "sqlserver", "dbo.StockTransfer", "GoDownTo", "int", False),
    (2, "store_sql", "sqlserver", "dbo.StockTransfer", "Quantity", "int", False),
    (2, "store_sql", "sqlserver", "dbo.sysReportTemp", "ReportId", "int", False),
    (2, "store_sql", "sqlserver", "dbo.sysReportTemp", "Quantity", "int", False),
    (2, "store_sql", "sqlserver", "dbo.Staff", "StaffId", "int", True),
    (2, "store_sql", "sqlserver", "dbo.Staff", "StaffRole", "nvarchar", False),
    (2, "store_sql", "sqlserver", "dbo.CameraChannels", "Channel", "int", True),
    (2, "store_sql", "sqlserver", "dbo.CameraChannels", "Zone", "nvarchar", False),
    (2, "store_sql", "sqlserver", "dbo.CameraEvents", "EventId", "int", True),
    (2, "store_sql", "sqlserver", "dbo.CameraEvents", "Channel", "int", False),
    (2, "store_sql", "sqlserver", "dbo.CameraEvents", "StartedAt", "datetime", False),
    (2, "store_sql", "sqlserver", "dbo.CameraEvents", "SnapshotPath", "nvarchar", False),
]
# Declared foreign keys of template 2: (from_table, from_column, to_table, to_column)
TEMPLATE_FKS = [
    (2, "store_sql", "dbo.ReceiptLines", "ReceiptId", "dbo.Receipts", "ReceiptId"),
    (2, "store_sql", "dbo.ReceiptLines", "ProductId", "dbo.Products", "ProductId"),
    (2, "store_sql", "dbo.SaleLines", "SaleId", "dbo.SaleHeader", "SaleId"),
    (2, "store_sql", "dbo.SaleLines", "ProductId", "dbo.Products", "ProductId"),
]
# Connector semantic contracts of template 1 (only on even stores).
TEMPLATE_CONTRACTS = [
    (1, "shop_api", "camera.zone", "camera_streams", "zone_name", "authorized_connector_contract"),
    (1, "shop_api", "staff.role", "crew", "duty_role", "authorized_connector_contract"),
]
# ---------------------------------------------------------------------------

N_TEMPLATES = 3
#: Stores that one task makes into catalogs.
STORES_PER_TASK = 20_000

_TEMPLATE_SCHEMA = T.StructType([
    T.StructField("template", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_kind", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("primary_key", T.BooleanType()),
    T.StructField("table_pos", T.IntegerType()),
    T.StructField("column_pos", T.IntegerType()),
])


def template_rows() -> list[tuple]:
    """Template columns with document positions (table order, column order)."""
    rows, table_pos, col_pos = [], {}, {}
    for tpl, src, kind, tab, col, typ, pk in TEMPLATE_COLUMNS:
        tkey = (tpl, src, tab)
        if tkey not in table_pos:
            table_pos[tkey] = sum(1 for k in table_pos if k[:2] == (tpl, src))
        col_pos[tkey] = col_pos.get(tkey, -1) + 1
        rows.append((tpl, src, kind, tab, col, typ, pk, table_pos[tkey], col_pos[tkey]))
    return rows


@frame_cached
def fx_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One store per customer: template, confirmation policy, SQL server identity."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    tpl = (F.col("c_custkey") % N_TEMPLATES).cast("int")
    return c.select(
        F.concat(F.lit("cat_"), F.col("c_custkey").cast("string")).alias("store_id"),
        F.col("c_name").alias("name"),
        tpl.alias("template"),
        F.when(tpl == 2, True).when(tpl == 1, F.col("c_custkey") % 2 == 0).otherwise(False).alias("requires_confirmation"),
        F.concat(F.lit("sql"), (F.col("c_custkey") % 7).cast("string")).alias("server"),
        F.lit("operations").alias("database"),
        F.col("c_custkey"),
    )


def _dealt(stores: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stores`` dealt by key before each becomes a catalog: a compressed file of many customers is one task.

    The count of parts is stated: parts merged by their size, which is that of the bare stores, are
    one task again, and the dealing of a join goes with the join where nobody reads what it adds.
    """
    parts = -(-table(spark, sf_dir, "customer").count() // STORES_PER_TASK)
    return stores.repartition(max(parts, 1), "c_custkey")


def _templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(template_rows(), _TEMPLATE_SCHEMA)


@frame_cached
def fx_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat column catalog of every store (store x template columns)."""
    stores = fx_stores(spark, sf_dir)
    orders = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("n_orders"))
    )
    both = (F.col("template") == 2) & (F.col("c_custkey") % 4 == 0)
    one = lambda pos, tpl: F.struct(F.lit(pos).alias("source_pos"), tpl.cast("int").alias("template"))
    sources = F.when(both, F.array(one(0, F.lit(1)), one(1, F.lit(2)))).otherwise(F.array(one(0, F.col("template"))))
    stores = stores.select("store_id", "c_custkey", F.explode(sources).alias("s")).select("store_id", "c_custkey", "s.*")
    stores = _dealt(stores.join(orders.hint("merge"), "c_custkey", "left"), spark, sf_dir)
    # The template table is a fixed constant of under 100 rows: a broadcast with a proven bound.
    cat = stores.join(F.broadcast(_templates(spark)), "template")
    return cat.select(
        "store_id",
        "source",
        "source_pos",
        "source_kind",
        "table",
        "table_pos",
        "column",
        "column_pos",
        "type",
        "primary_key",
        (F.coalesce(F.col("n_orders"), F.lit(0)) * (F.col("table_pos") + 1)).cast("bigint").alias("row_count"),
    )


@frame_cached
def fx_declared_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores = _dealt(fx_stores(spark, sf_dir), spark, sf_dir).select("store_id", "template")
    fks = spark.createDataFrame(
        TEMPLATE_FKS, "template int, source string, from_table string, from_column string, to_table string, to_column string"
    )
    return stores.join(F.broadcast(fks), "template").select(
        "store_id", "source", "from_table", "from_column", "to_table", "to_column",
        F.lit("declared_foreign_key").alias("kind"), F.lit(1.0).alias("confidence"),
    )


@frame_cached
def fx_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores = _dealt(fx_stores(spark, sf_dir).where(F.col("c_custkey") % 2 == 0), spark, sf_dir).select("store_id", "template")
    cs = spark.createDataFrame(
        [(*c, i) for i, c in enumerate(TEMPLATE_CONTRACTS)],
        "template int, source string, canonical_field string, table string, column string, authority string, contract_pos int",
    )
    return stores.join(F.broadcast(cs), "template").drop("template")


#: Tables of ``fx_sql_tables`` that serve all stores.
SHARED_TABLES = frozenset({"store_sql.dbo.Products"})


def fx_sql_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables behind the SQL Server template, projected from the driver tables by table path.

    Headers and lines carry their store, which numbers its headers by itself: many stores
    have a header of the same number.  The product table is shared by the fleet (``SHARED_TABLES``).
    """
    o = table(spark, sf_dir, "orders")
    p = table(spark, sf_dir, "part")
    li = table(spark, sf_dir, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    store = F.concat(F.lit("cat_"), F.col("o_custkey").cast("string")).alias("store_id")
    number = lambda key: F.col(key) - F.col("o_custkey")
    line = lambda status: li.where(F.col("l_linestatus") == status)
    return {
        "store_sql.dbo.Products": p.select(
            F.col("p_partkey").alias("ProductId"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("SKU"),
            F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("UnitsPerCase")),
        "store_sql.dbo.Receipts": o.select(store, number("o_orderkey").alias("ReceiptId"), F.col("o_orderdate").alias("ReceiptDate")),
        "store_sql.dbo.ReceiptLines": line("O").select(
            store, F.col("l_linenumber").alias("LineId"), number("l_orderkey").alias("ReceiptId"), F.col("l_partkey").alias("ProductId"),
            F.col("l_quantity").alias("Quantity"), F.col("l_suppkey").alias("DestinationId")),
        "store_sql.dbo.SaleHeader": o.select(store, number("o_orderkey").alias("SaleId"), F.col("o_orderdate").alias("SaleDate")),
        "store_sql.dbo.SaleLines": line("F").select(
            store, F.col("l_linenumber").alias("SaleDtlId"), number("l_orderkey").alias("SaleId"), F.col("l_partkey").alias("ProductId"),
            F.col("l_quantity").alias("SoldQty")),
    }
