"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

1. ``text_statistics`` turns every whole text into a few ratios and counts.
2. A random forest is trained on labelled statistics; each path from a root to a
   node is a conjunction of comparisons, that is, a rule.
3. A logistic regression with an L1 penalty weighs the rules and drops most of them.
4. ``RuleModel.score`` compiles what is left into one Spark column.

Only the training reads labels: a hash sample of about ``TRAIN_ROWS`` labelled
documents outside the held-out fold, broadcast by id to the documents.  Scoring
reads the text alone.

Cases: null and empty texts have zero statistics and a score; an id labelled
both 0 and 1 is not trained on; null ids and labels are ignored in training;
repeated rows score alike; labels of one class only give a constant score; no
labels at all score everything 1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import hash_sample, map_arrow, packed, written

#: Labelled documents that the model is fitted on, about.
TRAIN_ROWS = 20_000
TREES, DEPTH, L1, SEED = 20, 3, 0.002, 17
THRESHOLD = 0.3
FOLDS = 5
FIT_PARTITIONS = 12

STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "digit", "symbol", "exclamation", "pipe", "punctuation", "beyond_ascii",
    "space", "distinct_words", "top_word", "distinct_pairs", "line_length", "repeated_lines", "long_words", "sentence_ends", "entropy")

_BYTES = np.arange(256)
_CLASSES = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "symbol": np.isin(_BYTES, np.frombuffer(b"#*$%&<>@^~_=+\\/{}[]", np.uint8)),
    "exclamation": _BYTES == ord("!"),
    "pipe": _BYTES == ord("|"),
    "punctuation": np.isin(_BYTES, np.frombuffer(b".,;:?'\"()-", np.uint8)),
    "beyond_ascii": _BYTES >= 128,
    "space": (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)),
}


def statistics(text: str) -> list[float]:
    """The numbers of one text, in the order of STATISTICS."""
    raw = text.encode("utf-8")
    if not raw:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    share = {k: float(counts[mask].sum()) / n for k, mask in _CLASSES.items()}
    words = raw.split()
    n_words = max(len(words), 1)
    seen = Counter(words)
    lines = raw.split(b"\n")
    used = counts[counts > 0] / n
    return [
        math.log1p(len(text)), math.log1p(len(words)), n * (1 - share["space"]) / n_words,
        share["upper"], share["digit"], share["symbol"], share["exclamation"], share["pipe"], share["punctuation"],
        share["beyond_ascii"], share["space"],
        len(seen) / n_words, max(seen.values(), default=0) / n_words, len(set(zip(words, words[1:]))) / n_words,
        math.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines),
        sum(c for w, c in seen.items() if len(w) > 14) / n_words,
        sum(c for w, c in seen.items() if w[-1:] in b".?!") / n_words,
        float(-(used * np.log2(used)).sum()),
    ]


def text_statistics(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row``, a struct of the ``carry`` columns, and one double per statistic, for every row of ``docs``."""
    source, text_of = packed(docs, carry, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py() or "") for t in text_of(batch)]
            matrix = np.array(rows, float).reshape(len(rows), len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(matrix[:, j]) for j in range(len(STATISTICS))]], names=["row", *STATISTICS])

    return map_arrow(source, run, f"row {source.schema['row'].dataType.simpleString()}, " + ", ".join(f"{s} double" for s in STATISTICS))


#: A comparison (statistic, "<=" or ">", threshold); a rule is a set of them that all hold.
Rule = frozenset[tuple[str, str, float]]


@dataclass
class RuleModel:
    """Weighted rules with an intercept."""

    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        """The probability of label 1 as a Spark column over the statistics."""
        logit = F.lit(self.intercept)
        for rule, weight in self.rules:
            logit = logit + F.when(rule_column(rule), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-logit))


def rule_column(rule: Rule) -> Column:
    holds = F.lit(True)
    for name, side, value in sorted(rule):
        holds = holds & (F.col(name) <= value if side == "<=" else F.col(name) > value)
    return holds


def tree_rules(node, path: Rule = frozenset()) -> Iterator[Rule]:
    """The conjunction of every path below the root of one fitted tree."""
    if path:
        yield path
    if node.subtreeDepth() > 0:
        split = node.split()
        name, value = STATISTICS[split.featureIndex()], float(split.threshold())
        yield from tree_rules(node.leftChild(), path | {(name, "<=", value)})
        yield from tree_rules(node.rightChild(), path | {(name, ">", value)})


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that training never sees."""
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", text: str = "text",
                  rows: int = TRAIN_ROWS) -> DataFrame:
    """Statistics and ``label`` of a hash sample of about ``rows`` labelled documents outside the held-out fold."""
    agreed = (labels.select(F.col(doc_id).alias("label_id"), F.col(label).cast("int").alias("label"))
              .where(F.col("label_id").isNotNull() & F.col("label").isNotNull() & ~held_out("label_id"))
              .groupBy("label_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
              .where("label = most").select("label_id", "label"))
    known = written(agreed, "labels")
    share = min(1.0, rows / max(known.count(), 1))
    sample = known.where(hash_sample(F.col("label_id"), share))
    if share < 1 and sample.isEmpty():
        raise ValueError("no labelled row is in the sample")
    # About ``rows`` ids: their number bounds what is broadcast.
    chosen = docs.select(F.col(doc_id).alias("label_id"), F.col(text).alias("text")).join(F.broadcast(sample), "label_id")
    return written(text_statistics(chosen, "text", ("label",)).select("row.label", *STATISTICS), "training")


def fit(training: DataFrame) -> RuleModel:
    """Rules and weights from rows of statistics and ``label``."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    # About TRAIN_ROWS rows of doubles: few partitions make each pass of the solvers cheap.
    training = training.coalesce(FIT_PARTITIONS)
    classes = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    if len(classes) < 2:
        return RuleModel(-20.0 if 0 in classes else 20.0)
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(training).select("label", "features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, subsamplingRate=0.7, seed=SEED).fit(vectors)
    found = sorted({r for t in forest.trees for r in tree_rules(t._call_java("rootNode"))}, key=sorted)
    names = [f"r{i}" for i in range(len(found))]
    marked = training.select("label", *[rule_column(r).cast("double").alias(n) for r, n in zip(found, names)])
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(marked).select("label", "features")
    weighed = LogisticRegression(elasticNetParam=1.0, regParam=L1, maxIter=60, standardization=False).fit(rows)
    weights = [float(w) for w in weighed.coefficients]
    return RuleModel(float(weighed.intercept), [(r, w) for r, w in zip(found, weights) if w])


def train(docs: DataFrame, labels: DataFrame, **columns: str) -> RuleModel:
    return fit(training_rows(docs, labels, **columns))


def scored(docs: DataFrame, model: RuleModel, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row``, a struct of the ``carry`` columns, ``score`` and ``predicted`` for every row of ``docs``."""
    return text_statistics(docs, text, carry).select("row", model.score().alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def score_documents(docs: DataFrame, model: RuleModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``: one row per row of ``docs``."""
    return scored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model).select(
        "row.doc_id", F.coalesce(held_out("row.doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")
