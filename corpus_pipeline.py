"""Corpus pipeline: five stages over ``documents``, each written and read by the next.

1. quality classifier: documents that it rejects go;
2. line dedup: lines of earlier documents are cut from the texts;
3. near-duplicates: one document of each component stays;
4. benchmark decontamination: documents with hit words go;
5. source mixing: documents are repeated towards the target weights and shuffled.

The first four return the columns of ``documents``; the last adds ``copy_no`` and ``shuffle_key``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import op3_mixing, op4_quality, op7_line_dedup, op9_decontamination, op10_minhash
from storelens.llm.common import discard, scratch_mark, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on ``labels``, predicts as 1."""
    model = op4_quality.train(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"]))
    return op4_quality.scored(docs, model, carry=COLUMNS).where("predicted = 1").select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without dropped lines; null texts stay null, and ``n_chars`` follows the text."""
    marked = op7_line_dedup.with_bitmaps(docs.select(*COLUMNS), op7_line_dedup.dedup_lines(docs))
    text = marked.withColumn("text", F.when(F.col("text").isNotNull(), op7_line_dedup.kept_text()))
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return text.select("doc_id", "text", "lang", "source", changed.alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one with the smallest id."""
    return op10_minhash.one_of_each(docs.select(*COLUMNS), op10_minhash.near_duplicates(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a word inside an occurring benchmark window."""
    found = op9_decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"]), carry=COLUMNS)
    return found.where(F.size("spans") == 0).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by source and shuffled."""
    return op3_mixing.mix_sources(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix),
]

#: The classifier's scores have no SQL; tests hold every stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; what a stage leaves is deleted once the next is written."""
    docs = table(spark, sf_dir, "documents", list(COLUMNS))
    before = scratch_mark()
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        own = scratch_mark()
        docs = written(made, name.replace(" ", "-"))
        discard(spark, before, own)
        before = own
    return docs
