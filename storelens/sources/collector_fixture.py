"""Collector tables derived from the driver tables (camera events, labels, SQL facts, configs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.scalar import iso_text
from storelens.functions.cache import frame_cached
from storelens.sources.tables import table

CAMERA_ROLES = ("receiving", "shelf", "godown")


def _store(c="user_id", n=4):
    return F.concat(F.lit("store_"), (F.col(c) % n).cast("string")).alias("store_id")


@frame_cached
def fx_camera_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    ev = table(spark, sf_dir, "events")
    return {
        "observations": ev.where(F.col("event_type") == "view").select(
            _store(), F.col("event_id").alias("EventId"), (F.col("user_id") % 8).alias("Camera_Channel"),
            iso_text("ts").alias("Started_At"), F.col("event_type").alias("Detector"),
            F.floor("value").cast("int").alias("Max_People"), F.lit("/private/frame.jpg").alias("SnapshotPath")),
        "detections": ev.where(F.col("event_type") == "click").select(
            _store(), F.col("event_id").alias("detection_id"), (F.col("user_id") % 8).alias("channel"),
            iso_text("ts").alias("occurred_at"), F.lit("yolo").alias("model")),
        "audit": ev.where(F.col("event_type") == "error").select(
            _store(), "event_id", iso_text("ts").alias("created_at")),
    }


@frame_cached
def fx_verified_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    return ev.select(
        _store(), "event_id", F.concat(F.lit("confirm_"), F.col("event_type")).alias("action"),
        F.concat(F.lit("SKU-"), (F.col("event_id") % 97).cast("string")).alias("product_sku"),
        F.floor("value").cast("double").alias("quantity"),
        F.concat(F.lit("zone_"), (F.col("user_id") % 3).cast("string")).alias("source_zone"),
        F.concat(F.lit("shelf_"), (F.col("event_id") % 5).cast("string")).alias("destination_shelf"),
        iso_text("ts").alias("verified_at"), F.col("user_id").alias("staff_uid"),
        F.lit("Private Person").alias("staff_name"), F.lit("private note").alias("notes"),
    )


@frame_cached
def fx_sql_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                      F.col("l_quantity").cast("bigint").cast("string"),
                      F.floor(F.col("l_extendedprice") * 100).cast("string"))
    return li.select(
        _store("l_suppkey", 10), key.alias("fact_key"), F.col("l_linestatus").alias("fact_type"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("occurred_at"),
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("line_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("product_sku"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"),
        F.lit("private product name").alias("product_name"),
    )


@frame_cached
def fx_catalog_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One camera configuration per catalog store, with key % 4 channels."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    n = (F.col("c_custkey") % 4).cast("int")
    some = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(
        F.concat(F.lit("CH"), i.cast("string")).alias("channel"), F.concat(F.lit("cam"), i.cast("string")).alias("name"),
        F.lit("shelf").alias("role"), F.lit(True).alias("enabled"), F.lit("secret").alias("password")))
    cams = F.when(n > 0, some).otherwise(
        F.array().cast("array<struct<channel:string,name:string,role:string,enabled:boolean,password:string>>"))
    return c.select(F.concat(F.lit("cat_"), F.col("c_custkey").cast("string")).alias("store_id"), F.lit("device.json").alias("doc_path"),
                    F.to_json(F.struct(cams.alias("cameras"))).alias("doc"))


@frame_cached
def fx_camera_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")

    def cams(n):
        roles = F.array(*[F.lit(r) for r in CAMERA_ROLES])
        real = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(
            F.concat(F.lit("CH"), i.cast("string")).alias("channel"),
            F.concat(F.lit("cam"), i.cast("string")).alias("name"),
            F.element_at(roles, (i % 3 + 1).cast("int")).alias("role"),
            (i % 2 == 0).alias("enabled"), F.lit("secret").alias("password")))
        real = F.when(n > 0, real).otherwise(
            F.array().cast("array<struct<channel:string,name:string,role:string,enabled:boolean,password:string>>"))
        junk = F.array(F.struct(F.lit(None).cast("string").alias("channel"), F.lit("no-channel").alias("name"),
                                F.lit(None).cast("string").alias("role"), F.lit(None).cast("boolean").alias("enabled"),
                                F.lit("secret").alias("password")))
        return F.concat(junk, real)

    a = s.select(F.concat(F.lit("sup_"), k.cast("string")).alias("store_id"), F.lit("a_device.json").alias("doc_path"),
                 F.to_json(F.struct(cams((k % 4).cast("int")).alias("cameras"),
                                    F.when(k % 2 == 0, F.lit("10.0.0.5")).alias("dvr_ip"),
                                    F.lit("rtsp://user:pass@cam").alias("rtsp_url"))).alias("doc"))
    b = s.select(F.concat(F.lit("sup_"), k.cast("string")).alias("store_id"), F.lit("b_config.json").alias("doc_path"),
                 F.to_json(F.struct(cams((k % 3).cast("int")).alias("cameras"),
                                    F.lit("Supplier store").alias("store_name"))).alias("doc"))
    return a.unionByName(b)
