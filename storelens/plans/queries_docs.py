"""Registered schema-document queries."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from storelens.plans.queries import register
from storelens.session import ensure_checkpoint_dir
from storelens.sources import catalog_docs as cd
from storelens.sources import catalog_fixture as cf
from storelens.sources.tables import table


def _docs(spark, sf_dir, catalog=None):
    cat = catalog if catalog is not None else cf.fx_catalog(spark, sf_dir)
    return cd.catalog_docs(cat, cf.fx_stores(spark, sf_dir), cf.fx_declared_relationships(spark, sf_dir),
                           cf.fx_contracts(spark, sf_dir))


@register("flatten_catalog")
def q_flatten_catalog(spark, sf_dir):
    flat = cd.flatten_catalog(_docs(spark, sf_dir))
    return flat.withColumn("samples", F.array_join("samples", "|"))


@register("sanitize_catalog")
def q_sanitize_catalog(spark, sf_dir):
    s = cd.sanitize_catalog(_docs(spark, sf_dir))
    tables = F.flatten(F.transform("sources", lambda x: x["tables"]))
    cols = F.flatten(F.transform(tables, lambda t: t["columns"]))
    return s.select(
        "store_id",
        F.array_join(F.transform(tables, lambda t: t["name"]), ",").alias("tables"),
        F.size(cols).alias("column_count"),
        F.lit(",".join(sorted(f.name for f in s.schema["sources"].dataType.elementType["tables"].dataType
                              .elementType["columns"].dataType.elementType.fields))).alias("column_fields"),
    )


@register("scan_schema_docs")
def q_scan_schema_docs(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    bad = F.substring("store_id", 5, 20).cast("bigint") % 50 == 0
    docs = docs.withColumn("name", F.when(bad, F.lit(None).cast("string")).otherwise(F.col("name")))
    path = os.path.join(ensure_checkpoint_dir(spark), "schema_docs", os.path.basename(sf_dir.rstrip("/")))
    cd.write_schema_docs(docs, path)
    ok, rejected = cd.scan_schema_docs(spark, path)
    flat = cd.flatten_catalog(ok).groupBy("store_id").agg(
        F.countDistinct("table").alias("table_count"), F.count(F.lit(1)).alias("column_count"))
    return ok.select("store_id", F.lit(True).alias("valid")).join(flat, "store_id").unionByName(
        rejected.select("store_id", F.lit(False).alias("valid"), F.lit(None).cast("bigint").alias("table_count"),
                        F.lit(None).cast("bigint").alias("column_count")))


@register("merge_catalogs")
def q_merge_catalogs(spark, sf_dir):
    cat = cf.fx_catalog(spark, sf_dir)
    a = _docs(spark, sf_dir, cat.where(F.col("table_pos") % 2 == 0))
    b = _docs(spark, sf_dir, cat.where(F.col("table_pos") % 2 == 1)).withColumn(
        "requires_mapping_confirmation", F.lit(False))
    merged, _ = cd.merge_catalogs(a, b)
    tables = F.flatten(F.transform("sources", lambda x: x["tables"]))
    return merged.select(
        "store_id", F.size("sources").alias("source_count"), F.size(tables).alias("table_count"),
        F.size(F.flatten(F.transform(tables, lambda t: t["columns"]))).alias("column_count"),
        "requires_mapping_confirmation")


def fx_metadata(spark, sf_dir):
    cat = cf.fx_catalog(spark, sf_dir).where(F.col("source_kind") == "sqlserver")
    parts = F.split("table", r"\.")
    base = cat.select("store_id", parts[0].alias("schema_name"), parts[1].alias("table_name"),
                      (F.col("column_pos") + 1).alias("column_id"), F.col("column").alias("column_name"),
                      F.col("type").alias("data_type"), F.lit(4).alias("max_length"), F.lit(10).alias("precision"),
                      F.lit(0).alias("scale"), (~F.col("primary_key")).alias("is_nullable"),
                      F.lit(0).alias("is_ms_shipped"), "primary_key", "row_count")
    shipped = base.select("store_id").distinct().select(
        "store_id", F.lit("dbo").alias("schema_name"), F.lit("sysdiagrams").alias("table_name"),
        F.lit(1).alias("column_id"), F.lit("name").alias("column_name"), F.lit("sysname").alias("data_type"),
        F.lit(256).alias("max_length"), F.lit(0).alias("precision"), F.lit(0).alias("scale"),
        F.lit(False).alias("is_nullable"), F.lit(1).alias("is_ms_shipped"), F.lit(False).alias("primary_key"),
        F.lit(0).cast("bigint").alias("row_count"))
    allc = base.unionByName(shipped)
    cols = allc.drop("primary_key", "row_count")
    pks = allc.where("primary_key").select("store_id", "schema_name", "table_name", "column_name")
    tabs = allc.select("store_id", "schema_name", "table_name", "row_count").distinct()
    half = F.floor(F.col("row_count") / 2)
    parts_df = tabs.select("store_id", "schema_name", "table_name", F.explode(F.array(
        F.struct(F.lit(1).alias("index_id"), half.alias("rows")),
        F.struct(F.lit(1).alias("index_id"), (F.col("row_count") - half).alias("rows")),
        F.struct(F.lit(2).alias("index_id"), F.col("row_count").cast("bigint").alias("rows")))).alias("p")
    ).select("store_id", "schema_name", "table_name", "p.index_id", "p.rows")
    rels = cf.fx_declared_relationships(spark, sf_dir)
    fparts, tparts = F.split("from_table", r"\."), F.split("to_table", r"\.")
    fks = rels.select("store_id", F.concat(F.lit("FK_"), F.regexp_replace("from_table", r"\.", "_"), F.lit("_"),
                                           F.col("from_column")).alias("constraint_name"),
                      fparts[0].alias("from_schema"), fparts[1].alias("from_table"), "from_column",
                      tparts[0].alias("to_schema"), tparts[1].alias("to_table"), "to_column")
    return cols, pks, parts_df, fks


@register("catalog_from_metadata")
def q_catalog_from_metadata(spark, sf_dir):
    catalog, _ = cd.catalog_from_metadata(*fx_metadata(spark, sf_dir))
    return catalog.select("store_id", "table", "table_pos", "column", "column_pos", "type", "primary_key",
                          "row_count", "nullable")


@register("catalog_relationships")
def q_catalog_relationships(spark, sf_dir):
    return cd.catalog_from_metadata(*fx_metadata(spark, sf_dir))[1]


def fx_system_tables(spark, sf_dir):
    """The same metadata as rows of a database's own system tables, with ids."""
    cols, pks, parts, fks = fx_metadata(spark, sf_dir)
    oid = lambda schema, name: F.xxhash64(schema, name).alias("object_id")
    own = lambda df: df.withColumn("object_id", F.xxhash64("schema_name", "table_name"))
    c = own(cols)
    key = own(pks).join(c.select("store_id", "object_id", "column_name", "column_id"), ["store_id", "object_id", "column_name"])
    end = lambda o, k: c.select("store_id", F.col("object_id").alias(o), F.col("column_name").alias(f"{k}_column"), F.col("column_id").alias(f"{k}_id"))
    f = fks.select("store_id", "constraint_name", "from_column", "to_column", F.xxhash64("constraint_name").alias("constraint_object_id"),
                   F.xxhash64("from_schema", "from_table").alias("parent_object_id"), F.xxhash64("to_schema", "to_table").alias("referenced_object_id"))
    f = f.join(end("parent_object_id", "from"), ["store_id", "parent_object_id", "from_column"]).join(
        end("referenced_object_id", "to"), ["store_id", "referenced_object_id", "to_column"])
    return {
        "schemas": cols.select("store_id", F.xxhash64("schema_name").alias("schema_id"), F.col("schema_name").alias("name")).distinct(),
        "tables": cols.select("store_id", oid("schema_name", "table_name"), F.xxhash64("schema_name").alias("schema_id"),
                              F.col("table_name").alias("name"), "is_ms_shipped").distinct(),
        "columns": c.select("store_id", "object_id", "column_id", F.col("column_name").alias("name"), F.xxhash64("data_type").alias("user_type_id"),
                            "max_length", "precision", "scale", "is_nullable"),
        "types": cols.select("store_id", F.xxhash64("data_type").alias("user_type_id"), F.col("data_type").alias("name")).distinct(),
        "indexes": c.select("store_id", "object_id").distinct().select("store_id", "object_id", F.explode(F.array(
            F.struct(F.lit(1).alias("index_id"), F.lit(True).alias("is_primary_key")),
            F.struct(F.lit(2).alias("index_id"), F.lit(False).alias("is_primary_key")))).alias("i")).select("store_id", "object_id", "i.*"),
        "index_columns": key.select("store_id", "object_id", F.lit(1).alias("index_id"), "column_id").unionByName(
            c.where("column_id = 1").select("store_id", "object_id", F.lit(2).alias("index_id"), "column_id")),
        "partitions": own(parts).select("store_id", "object_id", "index_id", "rows"),
        "foreign_keys": f.select("store_id", F.col("constraint_object_id").alias("object_id"), F.col("constraint_name").alias("name")).distinct(),
        "foreign_key_columns": f.select("store_id", "constraint_object_id", "parent_object_id", F.col("from_id").alias("parent_column_id"),
                                        "referenced_object_id", F.col("to_id").alias("referenced_column_id")),
    }


@register("system_catalog")
def q_system_catalog(spark, sf_dir):
    catalog, _ = cd.catalog_from_metadata(*cd.metadata_from_system_tables(fx_system_tables(spark, sf_dir)))
    return catalog.select("store_id", "table", "table_pos", "column", "column_pos", "type", "primary_key",
                          "row_count", "nullable")


@register("system_catalog_relationships")
def q_system_catalog_relationships(spark, sf_dir):
    return cd.catalog_from_metadata(*cd.metadata_from_system_tables(fx_system_tables(spark, sf_dir)))[1]


@register("sample_rows")
def q_sample_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return cd.sample_rows(o, "dbo.orders", ["o_orderkey"], 5).withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@register("select_source")
def q_select_source(spark, sf_dir):
    from storelens.operators.catalog import select_source

    st = cf.fx_stores(spark, sf_dir)
    sources = st.select("store_id", F.lit("shop_api").alias("name"), F.lit("json_schema").alias("kind"),
                        F.lit(None).cast("string").alias("source_server"), F.lit(None).cast("string").alias("source_database"),
                        F.lit(-1).alias("source_pos"), "c_custkey", "server").unionByName(st.select("store_id", F.lit("archive_sql").alias("name"), F.lit("sqlserver").alias("kind"),
                        F.col("server").alias("source_server"), F.lit("archive").alias("source_database"),
                        F.lit(0).alias("source_pos"), "c_custkey", "server")).unionByName(
        st.select("store_id", F.lit("store_sql").alias("name"), F.lit("sqlserver").alias("kind"),
                  F.col("server").alias("source_server"), F.lit("operations").alias("source_database"),
                  F.lit(1).alias("source_pos"), "c_custkey", "server"))
    want_db = F.when(F.col("c_custkey") % 2 == 0, F.lit("OPERATIONS")).otherwise(F.lit("missing"))
    chosen = select_source(sources, F.upper(F.col("server")), want_db)
    return chosen.select("store_id", "name", "exact_match")
