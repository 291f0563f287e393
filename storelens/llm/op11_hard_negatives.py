"""Hard negatives by Kronecker-packed products.

Components become integers, ``floor(SCALE * x)``; a score is an integer inner product.
``PACK`` candidates at a time are packed: of each component, the values of all
candidates, biased to be at least 0, become fields of one wide integer, each as
many bytes wide as the largest possible biased sum needs.  Multiplied by an anchor's
biased component and summed over the components, the integer's fields are the biased
sums of all candidates at once, with no carry between fields; taking off
the bias, which depends on the two component sums only, gives the exact scores.

Anchors are taken in blocks of ``ANCHOR_BLOCK``, each block a pass of two steps over
all packs, with the block broadcast:

1. Each task keeps, for every anchor, the first ``POSITIVES`` rows of its own label; the
   first of all tasks are the positives.
2. Each task keeps, for every anchor and positive, the first ``NEGATIVES`` rows of other
   labels with ``LOW * positive_score <= 100 * negative_score <= HIGH * positive_score``; a
   window ranks those of all tasks.

Rows come first by falling score, then by rising vec_id, null ids last.

Cases: rows whose label or vector is null, or whose vector holds an entry that is
null or not finite, take no part, nor do vectors whose length isn't the most frequent
one (of equally frequent ones the longest), or with an entry so large that 100
times a score might not fit a long.  Repeated rows are rows of their own: each
can be an anchor, and another's positive or negative.  Rows with a null id are no anchors
but are candidates.  A positive without negatives has no rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import isqrt
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm.common import NULL_ID, common_length, finite_vector, map_arrow, scratch, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
#: Candidates whose components share one wide integer.
PACK = 512
#: Anchors of one pass; a pass broadcasts their components.
ANCHOR_BLOCK = 4096
#: Anchors scored together in a task.
TILE = 256

_NONE = np.iinfo(np.int64).min
_FOUND = "rid long, anchor_id long, slot int, id long, score long"


@dataclass(frozen=True)
class Fields:
    """Bias and bytes of a packed integer's fields; components of ``quantised`` rows need 8 at most."""

    low: int
    width: int
    length: int

    @staticmethod
    def for_range(low: int, high: int, length: int) -> Fields:
        return Fields(low, max(1, (((high - low) ** 2 * length).bit_length() + 7) // 8), length)


def pack(rows: np.ndarray, fields: Fields) -> list[bytes]:
    """One little-endian integer per component, a field per row."""
    biased = np.ascontiguousarray((rows - fields.low).astype("<u8").T)
    raw = biased.view(np.uint8).reshape(*biased.shape, 8)
    return [component[:, :fields.width].tobytes() for component in raw]


def scores(anchors: list[list[int]], anchor_sums: np.ndarray, packed: list[int], sums: np.ndarray, fields: Fields) -> np.ndarray:
    """Exact inner products, anchors by candidates; anchors' components are biased."""
    n = len(sums)
    raw = b"".join(sum(map(mul, a, packed)).to_bytes(n * fields.width, "little") for a in anchors)
    split = np.frombuffer(raw, np.uint8).reshape(len(anchors), n, fields.width)
    wide = np.zeros((len(anchors), n, 8), np.uint8)
    wide[:, :, :fields.width] = split
    return wide.view("<i8")[:, :, 0] + fields.low * (anchor_sums[:, None] + sums[None, :]) - fields.length * fields.low ** 2


def first_of_rows(values: np.ndarray, ids: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Places (row, column) of each row's first ``most`` entries, by falling value, then rising id; ``_NONE`` never counts."""
    if values.shape[1] > most:
        least = np.partition(values, values.shape[1] - most, axis=1)[:, -most]
    else:
        least = np.full(len(values), _NONE, np.int64)
    row, column = np.nonzero((values >= least[:, None]) & (values > _NONE))
    order = np.lexsort((ids[column], -values[row, column], row))
    row, column = row[order], column[order]
    start = np.searchsorted(row, row)
    keep = np.arange(len(row)) - start < most
    return zip(row[keep].tolist(), column[keep].tolist())


class Best:
    """The first rows for each of several targets, over many packs."""

    def __init__(self, targets: int, most: int):
        self.most = most
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(targets)]
        self.least = np.full(targets, _NONE, np.int64)

    def add(self, first: int, values: np.ndarray, ids: np.ndarray) -> None:
        """Values of the targets from ``first`` on; those below a target's last row are left out."""
        worth = values >= np.maximum(self.least[first:first + len(values)], _NONE + 1)[:, None]
        rows = np.flatnonzero(worth.any(axis=1))
        changed = set()
        for r, c in first_of_rows(np.where(worth[rows], values[rows], _NONE), ids, self.most):
            target = first + int(rows[r])
            self.found[target].append((-int(values[rows[r], c]), int(ids[c])))
            changed.add(target)
        for target in changed:
            kept = self.found[target] = sorted(self.found[target])[:self.most]
            if len(kept) == self.most:
                self.least[target] = -kept[-1][0]


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``(rid, id, label, x)`` of the rows that take part, null ids as the largest long; written, so that rids stay."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
                          F.col(f"`{embedding}`").alias("vector")).where("label is not null")
    finite = rows.where(finite_vector("vector", np.finfo(np.float64).max))
    length = common_length(finite, "vector")
    largest = isqrt((2**63 - 1) // (100 * max(length, 1)))
    fits = finite.where((F.size("vector") == length) & finite_vector("vector", float(largest // SCALE)))
    x = F.transform("vector", lambda c: F.floor(c.cast("double") * SCALE))
    return written(fits.select(F.monotonically_increasing_id().alias("rid"), F.coalesce("id", F.lit(NULL_ID)).alias("id"), "label", x.alias("x")),
                   "quantised")


def relabelled(rows: DataFrame) -> DataFrame:
    """Rows whose id is divisible by 7 get the next label of ten."""
    return rows.withColumn("label", F.when((F.col("id") % 7 == 0) & (F.col("id") != NULL_ID), (F.col("label") + 1) % 10).otherwise(F.col("label")))


def packs(rows: DataFrame, fields: Fields) -> DataFrame:
    """``(rids, ids, labels, sums, packed)``: up to ``PACK`` candidates each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                piece = batch.slice(at, PACK)
                x = piece.column(3).flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, fields.length)
                lists = [pa.array([c.to_numpy(zero_copy_only=False)], pa.list_(pa.int64())) for c in piece.columns[:3]]
                yield pa.RecordBatch.from_arrays(
                    [*lists, pa.array([x.sum(axis=1)], pa.list_(pa.int64())), pa.array([pack(x, fields)], pa.list_(pa.binary()))],
                    names=["rids", "ids", "labels", "sums", "packed"])

    table = map_arrow(rows.select("rid", "id", "label", "x"), run,
                      "rids array<long>, ids array<long>, labels array<long>, sums array<long>, packed array<binary>")
    return written(table, "packs")


@dataclass(frozen=True)
class Anchors:
    """One block of anchors; ``positives`` has each anchor's (id, score) pairs once they are known."""

    rids: np.ndarray
    ids: list[int]
    labels: np.ndarray
    sums: np.ndarray
    biased: list[list[int]]
    positives: list[list[tuple[int, int]]]


def _scan(packed: DataFrame, anchors: Anchors, fields: Fields) -> DataFrame:
    """One pass over the packs: positives of the anchors or, where those are known, negatives by positive."""
    shared = packed.sparkSession.sparkContext.broadcast(anchors)
    mining = bool(anchors.positives)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        n = len(a.ids)
        slots = POSITIVES if mining else 1
        best = [Best(n, NEGATIVES if mining else POSITIVES) for _ in range(slots)]
        goal = np.full((slots, n), _NONE, np.int64)
        if mining:
            for i, found in enumerate(a.positives):
                for slot, (_, score) in enumerate(found):
                    goal[slot, i] = score
        for batch in batches:
            for rids, ids, labels, sums, integers in zip(*batch.columns):
                rids, ids, labels, sums = (c.values.to_numpy(zero_copy_only=False) for c in (rids, ids, labels, sums))
                wide = [int.from_bytes(b.as_py(), "little") for b in integers.values]
                for at in range(0, n, TILE):
                    tile = slice(at, at + TILE)
                    s = scores(a.biased[tile], a.sums[tile], wide, sums, fields)
                    same = a.labels[tile][:, None] == labels[None, :]
                    if not mining:
                        other = rids[None, :] != a.rids[tile][:, None]
                        best[0].add(at, np.where(same & other, s, _NONE), ids)
                        continue
                    hundred = np.where(same, _NONE, 100 * s)
                    for slot in range(slots):
                        p = goal[slot, tile][:, None]
                        known = p != _NONE
                        p = np.where(known, p, 0)
                        inside = known & (hundred >= LOW * p) & (hundred <= HIGH * p) & ~same
                        best[slot].add(at, np.where(inside, s, _NONE), ids)
        for slot in range(slots):
            rows = [(i, id_, -score) for i, found in enumerate(best[slot].found) for score, id_ in found]
            at = [i for i, _, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.rids[at], pa.int64()), pa.array([a.ids[i] for i in at], pa.int64()), pa.array([slot] * len(rows), pa.int32()),
                 pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                names=["rid", "anchor_id", "slot", "id", "score"])

    return map_arrow(packed, run, _FOUND)


def _ranked(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each anchor and slot over all tasks."""
    order = Window.partitionBy("rid", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(rows: DataFrame) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``quantised`` rows."""
    spark = rows.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    range_ = rows.select(F.array_min("x").alias("low"), F.array_max("x").alias("high"), F.size("x").alias("length")).agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("length").alias("length")).first()
    if not range_["length"]:
        return spark.createDataFrame([], out)
    fields = Fields.for_range(range_["low"], range_["high"], range_["length"])
    packed = packs(rows, fields)
    anchors = rows.where((F.col("id") % 100 == 0) & (F.col("id") != NULL_ID))
    blocks = -(-anchors.count() // ANCHOR_BLOCK)
    folder, mined = scratch(spark, "negatives"), False
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    for b in range(blocks):
        # One block of about ANCHOR_BLOCK anchors at a time.
        taken = anchors.where(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == b).collect()
        if not taken:
            continue
        x = np.array([r["x"] for r in taken], np.int64)
        block = Anchors(np.array([r["rid"] for r in taken], np.int64), [r["id"] for r in taken], np.array([r["label"] for r in taken], np.int64),
                        x.sum(axis=1), (x - fields.low).tolist(), [])
        at = {rid: i for i, rid in enumerate(block.rids.tolist())}
        positives: list[list[tuple[int, int]]] = [[] for _ in taken]
        for r in _ranked(_scan(packed, block, fields), POSITIVES).orderBy("rid", "rank").collect():
            positives[at[r["rid"]]].append((r["id"], r["score"]))
        if not any(positives):
            continue
        negatives = _ranked(_scan(packed, Anchors(block.rids, block.ids, block.labels, block.sums, block.biased, positives), fields), NEGATIVES)
        pairs = spark.createDataFrame([(rid, slot, id_, score) for rid, i in at.items() for slot, (id_, score) in enumerate(positives[i])],
                                      "rid long, slot int, positive_id long, positive_score long")
        negatives.join(F.broadcast(pairs), ["rid", "slot"]).select(
            "anchor_id", back("positive_id"), F.col("rank").cast("int").alias("rank"), back("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{folder}/block={b}")
        mined = True
    if not mined:
        return spark.createDataFrame([], out)
    return spark.read.schema(out).parquet(folder).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Hard negatives of the anchors among ``vectors``, labels as given."""
    return mine(quantised(vectors, vec_id, embedding, label))
