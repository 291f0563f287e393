"""Per-session cache for large Column expressions.

Building a Column costs one JVM round trip per node; rule sets with hundreds of
nodes are built once per SparkContext and reused (unresolved Columns are
plan-independent).
"""

from __future__ import annotations

import functools

from pyspark import SparkContext


def session_cached(fn):
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args):
        sc = SparkContext._active_spark_context
        key = (sc.applicationId if sc is not None else None, args)
        if key not in cache:
            cache.clear() if len(cache) > 64 else None
            cache[key] = fn(*args)
        return cache[key]

    return wrapper


def frame_cached(fn):
    """Memoise a ``(spark, sf_dir) -> DataFrame`` fixture per session and folder.

    DataFrames are immutable lazy plans over immutable inputs, so one object can
    serve every branch of a query (Spark de-duplicates attributes of self-joins).
    """
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(spark, sf_dir):
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cache:
            cache[key] = fn(spark, sf_dir)
        return cache[key]

    return wrapper


def with_rules(df, rows: list[tuple], ddl: str):
    """Pair every row of ``df`` with each fixed rule row (a projection + explode of
    a literal array, not a join).  ``ddl`` is the rule schema ("a string, b int, ...")."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import _parse_datatype_string

    fields = [f.strip().split(" ", 1) for f in ddl.split(",")]
    rule_type = _parse_datatype_string("struct<" + ",".join(f"{n}:{t}" for n, t in fields) + ">")
    rules = F.lit(None).cast(f"array<{rule_type.simpleString()}>") if not rows else F.array(*[
        F.struct(*[F.lit(v).cast(rule_type[n].dataType).alias(n) if not isinstance(v, (list, tuple))
                   else _lit_array(v, rule_type[n].dataType).alias(n) for (n, _), v in zip(fields, row)])
        for row in rows])
    names = [n for n, _ in fields]
    return df.select("*", F.explode(rules).alias("_rule")).select(
        *[c for c in df.columns], *[F.col("_rule")[n].alias(n) for n in names])


def _lit_array(values, dtype):
    from pyspark.sql import functions as F
    from pyspark.sql.types import ArrayType

    if not values:
        return F.array().cast(dtype)
    elem = dtype.elementType if isinstance(dtype, ArrayType) else None
    if elem is not None and isinstance(elem, ArrayType):
        return F.array(*[_lit_array(v, elem) for v in values]).cast(dtype)
    return F.array(*[F.lit(v) for v in values]).cast(dtype)
