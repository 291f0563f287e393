"""Extension points, all as plain DataFrame / Column functions.

* evidence sources: register a callable ``(spark) -> DataFrame`` that yields
  poll items (batch) or a streaming DataFrame with the same schema;
* mapping provider: a Column function ``(canonical, candidates) -> struct<path,
  score, reason>`` passed to ``propose_mappings(provider=...)``;
* workflow rules: ``WorkflowRule`` Column expressions merged into the defaults;
* task sink: tasks delivered per role as a partitioned table or a stream sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.operators.workflows import WorkflowRule, default_rules
from storelens.schemas import POLL_ITEM

_SOURCES: dict[str, Callable[[SparkSession], DataFrame]] = {}


def clear_evidence_sources() -> None:
    _SOURCES.clear()


def register_evidence_source(name: str, fn: Callable[[SparkSession], DataFrame]) -> None:
    """Register a poll-item source under ``name`` (its output must carry the
    poll-item columns; extra columns travel as payload)."""
    _SOURCES[name] = fn


def evidence_sources() -> dict[str, Callable[[SparkSession], DataFrame]]:
    return dict(_SOURCES)


def poll_all(spark: SparkSession) -> DataFrame | None:
    """Union of every registered source's poll items (missing columns -> null)."""
    out = None
    for name, fn in _SOURCES.items():
        df = fn(spark)
        missing = [f for f in POLL_ITEM.fieldNames() if f not in df.columns]
        for f in missing:
            df = df.withColumn(f, F.lit(name) if f == "connector" else F.lit(None).cast(POLL_ITEM[f].dataType))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def first_candidate_provider(score: float = 0.65, reason: str = "Highest lexical and sample-type match; human "
                             "verification required.") -> Callable[[Column, Column], Column]:
    """The default provider as an explicit, replaceable Column function."""
    def provider(canonical: Column, candidates: Column) -> Column:
        return F.struct(candidates[0].alias("path"), F.lit(score).alias("score"), F.lit(reason).alias("reason"))
    return provider


def last_candidate_provider(score: float = 0.70, reason: str = "Chosen by a custom provider.") -> Callable[[Column, Column], Column]:
    """Example custom provider: the last of the top candidates."""
    def provider(canonical: Column, candidates: Column) -> Column:
        return F.struct(F.element_at(candidates, -1).alias("path"), F.lit(score).alias("score"),
                        F.lit(reason).alias("reason"))
    return provider


def with_rules(extra: dict[str, list[WorkflowRule]]) -> dict[str, list[WorkflowRule]]:
    """Default rules plus user rules appended per event type (new types allowed)."""
    rules = {k: list(v) for k, v in default_rules().items()}
    for etype, rs in extra.items():
        rules.setdefault(etype, []).extend(rs)
    return rules


def delivery_of(tasks: DataFrame) -> str:
    """A name for a set of tasks, from their ids: the same tasks have the same name in any order."""
    r = tasks.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).first()
    return f"{r['n']}-{(r['x'] or 0) & (2**64 - 1):016x}{(r['y'] or 0) & (2**64 - 1):016x}"


def deliver_tasks(tasks: DataFrame, path: str, fmt: str = "parquet", num_partitions: int | None = None, delivery: str | None = None) -> None:
    """Task sink: one folder per role so each role's consumer reads only its work
    (range-partitioned by role and id: few files per role, hot roles split).

    Below a role lies a folder per ``delivery``, by default ``delivery_of`` the tasks; a
    delivery that is tried again replaces its own folders, so no task arrives twice.
    """
    n = num_partitions or int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = tasks.withColumn("delivery", F.lit(delivery or delivery_of(tasks)))
    (named.repartitionByRange(n, "role", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", 1_000_000).partitionBy("role", "delivery").format(fmt).save(path))
