"""Registered projections of the scalar helpers over driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.functions import scalar as S
from storelens.plans.queries import register
from storelens.sources import fixtures as fx
from storelens.sources.tables import table


@register("normalize_name")
def q_normalize_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.normalize_name("p_name").alias("normalized"))


def timestamp_text_variants(ts, event_id):
    """Twelve shapes: naive, Z, +05:30, date, basic form, 'unknown', time only, year only,
    year and month, week date, space and comma, and a zone name."""
    v = event_id % 12
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    shifted = F.from_utc_timestamp(ts.cast("timestamp"), "+05:30")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(ts).cast("string"), 2, "0"), F.lit("-"), (F.weekday(ts) + 1).cast("string"))
    return (
        F.when(v == 0, S.iso_text(ts))
        .when(v == 1, F.concat(iso, F.lit("Z")))
        .when(v == 2, F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+05:30")))
        .when(v == 3, F.date_format(ts, "yyyy-MM-dd"))
        .when(v == 4, F.date_format(ts, "yyyyMMdd'T'HHmmss"))
        .when(v == 6, F.date_format(ts, "HH:mm:ss"))
        .when(v == 7, F.date_format(ts, "yyyy"))
        .when(v == 8, F.date_format(ts, "yyyy-MM"))
        .when(v == 9, week)
        .when(v == 10, F.date_format(ts, "yyyy-MM-dd HH:mm:ss,SSS"))
        .when(v == 11, F.concat(iso, F.lit(" Europe/Paris")))
        .otherwise(F.lit("unknown"))
    )


@register("parse_timestamp")
def q_parse_timestamp(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    text = timestamp_text_variants(F.col("ts"), F.col("event_id"))
    return ev.select("event_id", text.alias("text"), S.to_micros(S.parse_timestamp(text)).alias("occurred_us"))


@register("compose_occurred_at")
def q_compose_occurred_at(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    v = F.col("o_orderkey") % 4
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    t_full = F.concat(d, F.lit("T10:15:00"))
    date_text = F.when(v == 3, F.lit("")).otherwise(d)
    time_text = F.when(v == 0, t_full).when(v == 1, F.lit("10:15:00.123")).when(v == 2, F.lit(None)).otherwise(F.lit("09:00:00"))
    return o.select("o_orderkey", S.compose_occurred_at(date_text, time_text).alias("occurred_at"))


@register("to_number")
def q_to_number(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    v = F.col("l_orderkey") % 8
    whole = F.col("l_quantity").cast("int").cast("string")
    text = (F.when(v == 0, F.lit("")).when(v == 1, F.lit("abc")).when(v == 2, whole)
            .when(v == 3, F.concat(whole, F.lit("d"))).when(v == 4, F.concat(whole, F.lit(".5F")))
            .when(v == 5, F.concat(whole, F.lit("_000"))).when(v == 6, F.concat(whole, F.lit("e3")))
            .otherwise(F.concat(F.lit(" "), F.format_string("%.2f", F.col("l_extendedprice")), F.lit(" "))))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("text"),
                     S.to_number(text).alias("value"))


@register("record_hash16")
def q_record_hash16(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    text = F.when(F.col("l_linenumber") % 2 == 0, F.lit("0")).otherwise(F.col("l_linenumber").cast("string"))
    return li.select("l_orderkey", "l_linenumber",
                     S.record_hash16("l_orderkey", text, F.col("l_orderkey") % 3, F.col("l_orderkey") % 2 == 0).alias("hash16"))


@register("record_hash20")
def q_record_hash20(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    line = F.when(F.col("l_linenumber") == 1, F.lit(None)).otherwise(F.col("l_linenumber"))
    return li.select("l_orderkey", "l_linenumber",
                     S.record_hash20(F.lit("purchase"), F.col("l_orderkey"), line).alias("hash20"))


ROLE_VARIANTS = ("staff", "Shelf Staff", " godown ", "Data-Entry-Operator", "", "ProductManager")


@register("normalize_role")
def q_normalize_role(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.element_at(F.array(*[F.lit(x) for x in ROLE_VARIANTS]), (k % 6 + 1).cast("int"))).otherwise(
        F.col("c_mktsegment"))
    return c.select("c_custkey", raw.alias("raw"), S.normalize_role(raw).alias("role"))


@register("confirmation_value")
def q_confirmation_value(spark, sf_dir):
    t = fx.fx_task(spark, sf_dir).where(F.col("status") == "answered")
    return t.select(F.col("id").alias("task_id"), S.confirmation_value("answer").alias("confirmation"))


@register("clamp_confidence")
def q_clamp_confidence(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", S.clamp_confidence(F.col("value") / 100 - 1).alias("confidence"))


@register("ratio4")
def q_ratio4(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n"),
                                    F.count(F.lit(1)).alias("d"))
    return g.select("l_suppkey", "n", "d", S.ratio4("n", "d").alias("ratio"))


@register("json_value_type")
def q_json_value_type(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    v = F.col("event_id") % 4
    text = (F.when(v == 0, F.get_json_object("props", "$.k")).when(v == 1, F.lit("true"))
            .when(v == 2, F.concat(F.get_json_object("props", "$.k"), F.lit(".5")))
            .otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))))
    return ev.select("event_id", text.alias("value"), S.json_value_type(text).alias("json_type"))


@register("base_units")
def q_base_units(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    text = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("*"), F.col("l_linenumber").cast("string"),
                    F.lit("+"), (F.col("l_suppkey") % 5).cast("string"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                     S.base_units(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_suppkey") % 5).alias("units"),
                     S.base_units_from_text(text).alias("units_from_text"))


@register("summarize_facts")
def q_summarize_facts(spark, sf_dir):
    e = fx.fx_facts(spark, sf_dir)
    f = F.col("facts")
    m = F.create_map(F.lit("product_id"), F.coalesce(f["product_id"], F.lit("None")),
                     F.lit("destination_id"), F.coalesce(f["destination_id"], F.lit("None")),
                     F.lit("quantity"), S.fmt_number(f["quantity"]),
                     F.lit("value"), S.fmt_number(f["quantity"] * 1234567.25))
    return e.select("id", S.summarize_facts(F.col("event_type"), m).alias("summary"))
