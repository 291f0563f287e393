"""Mixing sources to target weights by Poisson replication.

Each source gets a target share of the output.  Its repetition rate is the
share times the output size over the source's own size, and every document is
repeated ``k`` times, where ``k`` comes from inverting a Poisson distribution
with that rate at a uniform number hashed from (seed, document).  The copies
are then dealt out by a hash of (seed, document, copy) and of the row's number, and
sorted by it inside each partition, which is a uniform shuffle of the whole output:
repeated rows, whose ``shuffle_key`` is the same, lie anywhere, too.

Cases: null texts have size 0; a null source is a source of its own; rows with a
null id are hashed by their text; repeated rows are repeated alike; sources
without bytes repeat once on average; an empty table gives an empty result.
Columns of ``docs`` are kept; ``copy_no`` and ``shuffle_key`` are replaced if
they exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import small_side, text_or_empty, written

#: Exponent that flattens source sizes where no weights are given.
ALPHA = 0.7
SEED = "mix-1"
#: A Poisson draw is a sum of draws with at most this mean, so that exp(-mean) stays exact.
PART_RATE = 32.0
#: Rates of up to this many sources are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("null"))


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA,
                     epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """``(source_key, rate, parts, cdf)``: one row per source.

    ``weights`` maps sources to target shares of the output bytes (a source
    that is not named gets none); without them the shares are proportional to
    bytes ** alpha.  The output has ``epochs`` times the input's bytes on average.
    """
    sizes = docs.groupBy(_source_key(source).alias("source_key")).agg(
        F.sum(F.octet_length(text_or_empty(text)).cast("double")).alias("bytes"))
    if weights is None:
        share = F.pow("bytes", F.lit(alpha))
    else:
        named = F.create_map(*[x for k, v in weights.items() for x in (F.lit("s" + k), F.lit(float(v)))])
        share = F.coalesce(F.try_element_at(named, F.col("source_key")), F.lit(0.0))
    shares = written(sizes.withColumn("share", share), "mix-sizes")
    all_bytes, all_share = shares.agg(F.sum("bytes"), F.sum("share")).first()
    rate = F.lit(1.0)
    if all_bytes and all_share:
        rate = F.when(F.col("bytes") > 0, epochs * (F.col("share") / all_share) * (all_bytes / F.col("bytes"))).otherwise(rate)
    rated = shares.withColumn("rate", rate)
    parts = F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int")
    part_rate = F.col("rate") / F.col("parts")
    return (rated.withColumn("parts", parts).withColumn("part_rate", part_rate)
            .select("source_key", "rate", "parts", poisson_cdf("part_rate").alias("cdf")))


def poisson_cdf(rate: str) -> Column:
    """P(X <= k) for k from 0 until what is left is below the spacing of the uniform numbers."""
    terms = F.sequence(F.lit(1), F.ceil(F.col(rate) + 12 * F.sqrt(rate) + 30).cast("int"))
    first = F.exp(-F.col(rate))
    return F.aggregate(
        terms,
        F.struct(first.alias("p"), F.array(first).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["p"] * F.col(rate) / k).alias("p"),
            F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * F.col(rate) / k)).alias("cdf")),
        lambda acc: acc["cdf"])


def hashed_uniform(key: Column) -> Column:
    """A number of [0, 1) with 52 bits, from the md5 of ``key``."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, epochs: float = 1.0,
                seed: str = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Each document repeated by its draw, shuffled: the columns of ``docs``, ``copy_no``, ``shuffle_key``."""
    names = [c for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    rates = small_side(repetition_rates(docs, weights, alpha, epochs, source, text), BROADCAST_SOURCES, "mix-rates")
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null:"), F.md5(text_or_empty(text))))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), _source_key(source).alias("source_key"),
                      key.alias("key"), F.monotonically_increasing_id().alias("number")).join(rates, "source_key")
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")),
                        lambda j: hashed_uniform(F.concat_ws("|", F.lit(seed), F.col("key"), j.cast("string"))))
    copies = F.aggregate(draws, F.lit(0),
                         lambda n, u: n + F.size(F.filter(F.col("cdf"), lambda c: c <= u)))
    drawn = row.select("row", "key", "number", copies.alias("copies")).where("copies > 0")
    dealt = drawn.select("row", "key", "number", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    keyed = dealt.select("row", F.col("copy_no").cast("long").alias("copy_no"), F.md5(F.concat_ws(
        "|", F.lit(seed), F.lit("order"), F.col("key"), F.col("copy_no").cast("string"))).alias("shuffle_key"), "number")
    placed = keyed.select("row", "copy_no", "shuffle_key", F.xxhash64("shuffle_key", "number").alias("place"))
    # The count is stated: parts merged by their size put rows that were dealt apart into one task again.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "place").sortWithinPartitions("place", "shuffle_key").select("row.*", "copy_no", "shuffle_key")
