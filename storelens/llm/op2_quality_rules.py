"""Quality rules as a short-circuit cascade of Spark columns.

``base_counts`` gives word, symbol, line and repetition counts of every whole
text.  ``RULES`` reject documents by counts and texts.  ``plan_cascade`` runs each
rule over a hash sample of about ``SAMPLE_ROWS`` documents, measures its seconds, the
least of ``REPETITIONS`` runs, and which documents it rejects, and picks the order
greedily: next comes the rule that rejects most of what is left per second.  ``apply_cascade`` puts that order into
one CASE expression, so a document stops at its first failing rule.  The order
changes cost and ``rejected_by`` alone, never the verdict.

Cases: null and empty texts have no words and fail the base; repeated rows get
equal results; words and lines are those of the whole text; without rows in the
sample the rules keep their listed order.
"""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import hash_sample, text_or_empty, written

#: Documents that cost and selectivity are estimated on, about.
SAMPLE_ROWS = 2000
#: Runs of each rule over the sample.
REPETITIONS = 3
# Fixed values of the contract.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Rule(NamedTuple):
    name: str
    rejects: Column


def _count(text: Column, chars: str) -> Column:
    """How many characters of the class ``chars`` a text has."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))


def rules() -> list[Rule]:
    """The rules after the base, over ``text`` and the base counts."""
    words, chars = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    text = text_or_empty()
    share = lambda part, percent: 100 * part > percent * chars
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern)))
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 30 * words),
        Rule("duplicate_lines", 100 * F.col("n_dup_lines") > 30 * F.size(lines)),
        Rule("word_length", (chars < 2 * words) | (chars > 20 * words)),
        Rule("exclamations", 100 * _count(text, "!") > 30 * words),
        Rule("digits", share(_count(text, "0-9"), 30)),
        Rule("upper_case", share(_count(text, r"\p{Lu}"), 50)),
        Rule("letters", share(_count(text, r"^\p{L}\x20\x09-\x0D"), 50)),
        Rule("bullets", 100 * of_lines(r"^[\x20\x09-\x0D]*[-•*‣◦]") > 90 * F.size(lines)),
        Rule("ellipses", 100 * of_lines(r"(\.\.\.|…)[\x20\x09-\x0D]*$") > 30 * F.size(lines)),
        Rule("markup", share(_count(text, r"{}<>\\"), 10)),
    ]


def base_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)``."""
    body = F.col("text")
    split = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).withColumn(
        "words", F.array_remove(F.split(body, SPACES), ""))
    # A window with its position at the end: sorting brings equal windows together, and no word holds a space.
    n = F.size("words")
    word = lambda i, k: F.get("words", (i + k).cast("int"))
    starts = F.when(n > 2, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    placed = F.transform(starts, lambda i: F.concat_ws(" ", word(i, 0), word(i, 1), word(i, 2), i.cast("string")))
    windows = split.withColumn("windows", F.sort_array(placed))
    window = lambda x: F.substring_index(x, " ", 3)
    at = lambda x: F.substring_index(x, " ", -1).cast("int")
    covered = lambda x: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: at(x) + k)
    equal = F.zip_with("windows", F.slice("windows", 2, F.greatest(F.size("windows") - 1, F.lit(0))),
                       lambda a, b: F.when(window(a) == window(b), F.concat(covered(a), covered(b))))
    repeated = windows.withColumn("repeated", F.flatten(F.filter(equal, lambda x: x.isNotNull())))
    lines = repeated.withColumn("lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    counted = lines.select(
        "doc_id", "text", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count(body, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("repeated")).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _seconds(df: DataFrame) -> list[float]:
    runs = []
    for _ in range(REPETITIONS):
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        runs.append(time.perf_counter() - began)
    return sorted(runs)


def plan_cascade(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", listed: list[Rule] | None = None) -> list[Rule]:
    """The rules (all of them, or those ``listed``) in order of rejections per second, estimated on a sample."""
    listed = rules() if listed is None else listed
    share = min(1.0, SAMPLE_ROWS / max(docs.count(), 1))
    # Rows without an id are sampled by their number, so that the filter reads no text.
    key = F.coalesce(F.col(doc_id).cast("string"), F.monotonically_increasing_id().cast("string"))
    some = docs.where(hash_sample(key, share))
    sample = written(base_counts(some, doc_id, text), "cascade-sample").where("not base_failed")
    # About SAMPLE_ROWS rows of booleans come to the driver.
    marks = [tuple(r) for r in sample.select(*[F.coalesce(r.rejects, F.lit(False)) for r in listed]).collect()]
    idle = _seconds(sample.select("text", *COUNTS))
    # Differences below the spread of the runs without a rule tell nothing.
    least = max(idle[-1] - idle[0], 1e-3)
    costs = [max(_seconds(sample.select("text", *COUNTS, r.rejects.alias("x")))[0] - idle[0], least) for r in listed]
    order, left = [], list(range(len(listed)))
    while left:
        best = max(left, key=lambda k: (sum(m[k] for m in marks) / costs[k], -k))
        order.append(listed[best])
        left.remove(best)
        marks = [m for m in marks if not m[best]]
    return order


def apply_cascade(counts: DataFrame, order: list[Rule]) -> DataFrame:
    """``counts`` with ``rejected_by`` (null: kept) and ``kept``."""
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule in order:
        verdict = verdict.when(rule.rejects, F.lit(rule.name))
    return counts.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())
