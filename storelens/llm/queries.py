"""Registered queries of the training-data operators; each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import (
    op1_warc,
    op2_quality_rules as op2_rules,
    op3_mixing,
    op4_quality,
    op5_licenses,
    op6_pii,
    op7_line_dedup,
    op8_tokens,
    op9_decontamination,
    op10_minhash,
    op11_hard_negatives as op11_negatives,
    op12_whitening,
    op13_exact_dedup,
)
from storelens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Vocabulary file of the token counts.
TOKENIZER = "byte_bpe_50k.json"
#: Tokens of the context that ``over_limit`` reports.
TOKEN_LIMIT = 1024


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn



@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source", "n_chars"])
    return op3_mixing.mix_sources(docs)


@query
def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_pii.span_digest(op6_pii.detect_pii(table(spark, sf_dir, "documents", ["doc_id", "text"])))


@query
def op7_line_dedup_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    kept = op7_line_dedup.with_bitmaps(docs, op7_line_dedup.dedup_lines(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(op7_line_dedup.kept_text(), 256).alias("kept_sha256"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = op8_tokens.count_tokens(table(spark, sf_dir, "documents", ["doc_id", "text"]), public_tokenizers.path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return op9_decontamination.hit_digest(
        op9_decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"])))


@query
def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_warc.record_digest(op1_warc.round_trip(spark, table(spark, sf_dir, "pages", ["page_id", "url", "html"])))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    judged = op2_rules.apply_cascade(op2_rules.base_counts(docs), op2_rules.plan_cascade(docs))
    return judged.select("doc_id", *op2_rules.COUNTS, "base_failed", "kept")


@query
def op4_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    model = op4_quality.train(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"]))
    return op4_quality.score_documents(docs, model)


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_licenses.license_digest(op5_licenses.scan_licenses(table(spark, sf_dir, "documents", ["doc_id", "text"])))


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_minhash.component_digest(op10_minhash.near_duplicates(table(spark, sf_dir, "documents", ["doc_id", "text"])))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op11_negatives.quantised(table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]))
    return op11_negatives.mine(op11_negatives.relabelled(rows))


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_whitening.whiten(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))


@query
def op13_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_exact_dedup.duplicate_digest(op13_exact_dedup.exact_duplicates(table(spark, sf_dir, "documents", ["doc_id", "text"])))
