"""Evidence, event and task aggregations.

All per-store outputs are ``groupBy`` aggregations with partial (map-side)
aggregation.  Kinds, event types, roles, states and sources are free text, so
list-valued outputs name at most ``VALUES_SHOWN`` of a store's values and add up the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.scalar import parse_timestamp, to_micros
from storelens.schemas import EVIDENCE_KINDS


#: Values of a free-text column that a store's list names.
VALUES_SHOWN = 50


def _unknown(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit("unknown"))


def evidence_counts(evidence: DataFrame) -> DataFrame:
    """Evidence rows per (store, kind)."""
    return evidence.groupBy("store_id", _unknown("kind").alias("kind")).agg(F.count(F.lit(1)).alias("count"))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("store_id", _unknown("event_type").alias("event_type")).agg(F.count(F.lit(1)).alias("count"))


def event_status_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("store_id", _unknown("status").alias("status")).agg(F.count(F.lit(1)).alias("count"))


def open_tasks_by_role(tasks: DataFrame) -> DataFrame:
    return (
        tasks.where(F.col("status") == "open")
        .groupBy("store_id", _unknown("role").alias("role"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def source_freshness(evidence: DataFrame) -> DataFrame:
    """Per (store, source): count, sorted distinct kinds, text of the latest instant.

    ``latest_at`` keeps the original text of the greatest parseable instant; on
    equal instants the smallest (text, id) wins.  Unparseable times are ignored.
    Kinds outside the data model are told as ``other``.
    """
    kind = F.when(_unknown("kind").isin(*EVIDENCE_KINDS, "unknown"), _unknown("kind")).otherwise(F.lit("other"))
    us = to_micros(parse_timestamp(F.col("occurred_at")))
    key = F.when(us.isNotNull(), F.struct((-us).alias("neg_us"), F.col("occurred_at").alias("text"), F.col("id").alias("id")))
    return evidence.groupBy("store_id", _unknown("source").alias("source")).agg(
        F.count(F.lit(1)).alias("count"),
        F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("kinds"),
        F.min(key)["text"].alias("latest_at"),
    )


def latest_source_gap(evidence: DataFrame) -> DataFrame:
    """|latest system record - latest observation| per store, in hours (2 dp, half-even)."""
    us = to_micros(parse_timestamp(F.col("occurred_at")))
    agg = evidence.groupBy("store_id").agg(
        F.max(F.when(F.col("kind") == "system_record", us)).alias("latest_system_us"),
        F.max(F.when(F.col("kind") == "observation", us)).alias("latest_observation_us"),
    )
    gap = F.abs(F.col("latest_observation_us") - F.col("latest_system_us"))
    unit = 36_000_000  # microseconds per 0.01 h
    q = F.floor(gap / unit).cast("bigint")
    rem = gap - q * unit
    up = (rem * 2 > unit) | ((rem * 2 == unit) & (q % 2 == 1))
    hundredths = q + F.when(up, 1).otherwise(0)
    return agg.select(
        "store_id",
        gap.alias("latest_source_gap_us"),
        (hundredths / F.lit(100.0)).alias("latest_source_gap_hours"),
    )


def corroboration_coverage(evidence: DataFrame, matches: DataFrame) -> DataFrame:
    """Per store: corroborated / uncorroborated system records, unlinked observations.

    ``matches`` is the output of ``nearest_observation``.  Uncorroborated counts
    every system record (unparseable times included) minus the corroborated ones.
    """
    base = evidence.groupBy("store_id").agg(
        F.sum(F.when(F.col("kind") == "system_record", 1).otherwise(0)).cast("bigint").alias("system_records"),
        F.sum(F.when(F.col("kind") == "observation", 1).otherwise(0)).cast("bigint").alias("observations"),
    )
    m = matches.groupBy("store_id").agg(
        F.countDistinct("system_record_id").alias("corroborated"),
        F.countDistinct("observation_id").alias("linked_observations"),
        F.count(F.lit(1)).alias("match_count"),
    )
    j = base.join(m, "store_id", "left").fillna(0, ["corroborated", "linked_observations", "match_count"])
    return j.select(
        "store_id",
        "system_records",
        "observations",
        F.col("match_count").cast("bigint").alias("match_count"),
        F.col("corroborated").cast("bigint").alias("corroborated_system_records"),
        (F.col("system_records") - F.col("corroborated")).cast("bigint").alias("uncorroborated_system_records"),
        (F.col("observations") - F.col("linked_observations")).cast("bigint").alias("unlinked_observations"),
    )


def most_counted(counts: DataFrame, key: str) -> DataFrame:
    """``counts (store_id, key, count)`` with ``shown``: a store's ``VALUES_SHOWN`` values with the largest counts."""
    order = Window.partitionBy("store_id").orderBy(F.desc("count"), F.asc_nulls_last(key))
    return counts.withColumn("shown", F.row_number().over(order) <= VALUES_SHOWN)


def listed(entries: Column, text: Callable[[Column], Column]) -> Column:
    """The shown entries' texts in order, and how many other values have how many rows."""
    shown = F.array_sort(F.collect_list(F.when(F.col("shown"), entries)))
    others, rows = F.count_if(~F.col("shown")), F.sum(F.when(~F.col("shown"), F.col("count")))
    more = F.when(others > 0, F.concat(F.lit("("), others.cast("string"), F.lit(" others)="), rows.cast("string")))
    return F.concat_ws(", ", F.array_join(F.transform(shown, text), ", "), more)


def counts_text(counts: DataFrame, key: str, name: str) -> DataFrame:
    """(store, key, count) -> one 'k=v, k2=v2' text per store, keys sorted."""
    entry = F.struct(F.col(key).alias("k"), F.col("count").alias("v"))
    return most_counted(counts, key).groupBy("store_id").agg(
        listed(entry, lambda e: F.concat(e["k"], F.lit("="), e["v"].cast("string"))).alias(name))
