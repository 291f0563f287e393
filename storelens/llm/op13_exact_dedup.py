"""Exact duplicates with a heavy-hitter split.

Texts are equal when they are identical after A-Z become a-z; they are told apart
by the SHA-256 of that form.  Every task runs Misra-Gries over its digests: with
``COUNTERS`` counters it names every digest that has more than 1 in
``COUNTERS + 1`` of its rows, and each counter is short of the true count by at most
that share.  Added up by digest, the counters reach at least
``rows / (COUNTERS + 1)`` for every digest with twice that share of all rows,
and for at most ``COUNTERS + 1`` digests.  Those are counted again exactly, with
the row that stays; this table of verified winners is broadcast, so rows of
frequent texts are settled where they lie.  All other digests are shuffled, and no
group among them has more than 2 in ``COUNTERS + 1`` of the rows.

Of equal texts the row with the largest id stays; a null id is smaller than
every other, and of several rows with that id exactly one stays.

Cases: null texts count as empty and are equal to empty ones; every row, repeated
or without an id, is a row of the result; ``keep_id`` is null where no row of the
group has an id; an empty table gives no rows; columns carried along keep their
names inside ``row``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm.common import map_arrow, written

#: Misra-Gries counters of a task; also bounds the broadcast winners.
COUNTERS = 4096


def _digested(docs: DataFrame, doc_id: str, text: str, carry: Sequence[str]) -> DataFrame:
    """``(row, doc, digest)`` of every row; a text that is carried is sent once."""
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    at = list(carry).index(text) if text in carry else None
    source = docs.select(row, F.col(f"`{doc_id}`").cast("long").alias("doc"), *([F.col(f"`{text}`").alias("text")] if at is None else []))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2) if at is None else batch.column(0).field(at)
            # bytes.lower() changes A-Z only.
            digests = [hashlib.sha256((t.as_py() or "").encode("utf-8").lower()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary())], names=["row", "doc", "digest"])

    return map_arrow(source, run, f"row {source.schema['row'].dataType.simpleString()}, doc long, digest binary")


class MisraGries:
    """Counters of the frequent values of a stream; values come with their counts."""

    def __init__(self, counters: int):
        self.counters = counters
        self.counts: dict[bytes, int] = {}

    def add(self, values: Sequence[bytes], counts: Sequence[int]) -> None:
        for v, n in zip(values, counts):
            self.counts[v] = self.counts.get(v, 0) + n
        if len(self.counts) > self.counters:
            # Taking the (counters + 1)-th largest count from all of them cancels that many rows for each unit.
            found = np.fromiter(self.counts.values(), np.int64, len(self.counts))
            cut = int(np.partition(found, len(found) - self.counters - 1)[len(found) - self.counters - 1])
            self.counts = {v: n - cut for v, n in self.counts.items() if n > cut}


def frequent_digests(digests: DataFrame, rows: int, counters: int = COUNTERS) -> DataFrame:
    """``(digest)``: at most ``counters + 1`` of them, and every one with at least ``2 * rows / (counters + 1)`` rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = MisraGries(counters)
        for batch in batches:
            met = pc.value_counts(batch.column(0))
            sketch.add(met.field(0).to_pylist(), met.field(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(sketch.counts), pa.binary()), pa.array(list(sketch.counts.values()), pa.int64())],
                                         names=["digest", "counter"])

    counted = map_arrow(digests.select("digest"), run, "digest binary, counter long").groupBy("digest").agg(F.sum("counter").alias("counter"))
    return counted.where((F.col("counter") >= 2) & (F.col("counter") * (counters + 1) >= rows)).select("digest")


def _order() -> Column:
    """Rows in order of preference: the larger id, then the earlier written row."""
    return F.struct("doc", (-F.col("rid")).alias("late"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ("doc_id",),
                     counters: int = COUNTERS) -> DataFrame:
    """``(row, digest, keep_id, group_size, kept)``, one row per row of ``docs``.

    ``row`` is a struct of the ``carry`` columns.
    """
    # Row numbers tell rows apart; they stay as written.
    rows = written(_digested(docs, doc_id, text, carry).withColumn("rid", F.monotonically_increasing_id()), "digests")
    total = rows.count()
    frequent = F.broadcast(written(frequent_digests(rows, total, counters), "frequent"))
    winners = F.broadcast(written(rows.join(frequent, "digest", "left_semi").groupBy("digest").agg(
        F.count("*").alias("size"), F.max(_order()).alias("best")), "winners"))

    settled = rows.join(winners, "digest")
    group = Window.partitionBy("digest")
    ordinary = rows.join(winners, "digest", "left_anti").withColumns(
        {"size": F.count("*").over(group), "best": F.max(_order()).over(group)})
    both = settled.select("row", "digest", "rid", "size", "best").unionByName(ordinary.select("row", "digest", "rid", "size", "best"))
    return both.select("row", "digest", F.col("best.doc").alias("keep_id"), F.col("size").alias("group_size"),
                       (F.col("best.late") == -F.col("rid")).alias("kept"))


def without_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts."""
    return exact_duplicates(docs, doc_id, text, tuple(docs.columns)).where("kept").select("row.*")


def duplicate_digest(found: DataFrame) -> DataFrame:
    """One row per document with the id that stays, for ``exact_duplicates``' rows."""
    return found.select("row.doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
