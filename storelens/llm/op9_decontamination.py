"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test items are cut into windows of ``WINDOW`` consecutive words; an item of
fewer words is one window.  For each window length one matcher is built: a shift
table says, for a block of words at the end of the current position, how far
the search may skip; where it may not skip, the hash of that suffix block and of the
window's first block names the bucket of windows to compare directly, word by word.

The items' words are numbered; every other word of a document is 0.  A matcher is a few
arrays, about 60 bytes a window: the driver builds those of one block of items, at
most about ``BLOCK_WINDOWS`` windows and as many different words, and broadcasts them, so a
worker holds one copy, whatever number of tasks it runs.  Each block is one pass
over the documents, and the passes' hits are joined by row.

Cases: texts and items that are null or hold no word hit nothing; an item with a
null id marks words but is no item; repeated items and rows count once and
repeat; a repeated item_id is one item; columns keep their names inside ``row``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import map_arrow, text_or_empty, written

WINDOW = 10
BLOCK_WORDS = 2
#: Windows of one block of items.
BLOCK_WINDOWS = 500_000
SPANS = "array<struct<start:bigint,end:bigint>>"

_LOWER = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: The words' pattern for lower-cased texts.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def words(text: str | None) -> list[bytes]:
    """Words of digits, letters and all beyond ASCII, A-Z lower-cased."""
    return text.encode("utf-8").translate(_LOWER).split() if text else []


def numbers(text: str | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Numbers of the text's words; 0 is any word that no item has."""
    found = words(text)
    return np.fromiter(map(vocabulary.get, found, repeat(0)), np.uint64, len(found))


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of several, position by position."""
    x = np.zeros_like(parts[0])
    for part, factor in zip(parts, _FACTORS):
        x = (x ^ part) * factor
        x ^= x >> np.uint64(29)
    return x


def _blocks(ids: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the blocks of ``size`` words that end at ``ends``."""
    return _mixed(*[ids[ends - k] for k in range(size)])


class WuManber:
    """Windows of one length: ``starts`` into the joined item words ``flat``, with the item of each."""

    def __init__(self, length: int, flat: np.ndarray, starts: np.ndarray, items: np.ndarray):
        self.length = length
        self.block = min(BLOCK_WORDS, length)
        self.skip = length - self.block + 1
        self.flat = flat
        bits = max(8, int(len(starts) * self.skip * 2).bit_length())
        self.down = np.uint64(64 - bits)
        self.shift = np.full(2**bits, self.skip, np.uint8)
        # A slot that several blocks share keeps the smallest shift, so no window is skipped.
        for end in range(self.block, length + 1):
            np.minimum.at(self.shift, self._slots(_blocks(flat, starts + (end - 1), self.block)), np.uint8(length - end))
        keys = self._bucket(_blocks(flat, starts + (length - 1), self.block), _blocks(flat, starts + (self.block - 1), self.block))
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.items = keys[order], starts[order], items[order]

    def _slots(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> self.down).astype(np.int64)

    @staticmethod
    def _bucket(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return _mixed(suffix, prefix)

    def find(self, ids: np.ndarray, blocks: dict[int, np.ndarray] | None = None) -> Iterator[tuple[int, frozenset[int]]]:
        """Starts of occurring windows and the items they belong to; ``blocks`` are those of the text by size, kept
        for the other matchers."""
        n, last = len(ids), self.length - 1
        if n < self.length:
            return
        kept = {} if blocks is None else blocks
        if self.block not in kept:
            kept[self.block] = _blocks(ids, np.arange(self.block - 1, n), self.block)
        blocks = kept[self.block]
        shifts = self.shift[self._slots(blocks)]
        if shifts.all():
            return  # no position where a window may end
        steps = shifts.tolist()
        i, ahead = last, self.block - 1
        ends = []
        while i < n:
            step = steps[i - ahead]
            if not step:
                ends.append(i)
                step = 1
            i += step
        if not ends:
            return
        at = np.array(ends)
        keys = self._bucket(blocks[at - ahead], blocks[at - last])
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        reach = np.arange(self.length)
        for k in np.flatnonzero(high > low):
            start, bucket = int(at[k]) - last, slice(low[k], high[k])
            same = (self.flat[self.starts[bucket][:, None] + reach] == ids[start:start + self.length]).all(axis=1)
            if same.any():
                yield start, frozenset(self.items[bucket][same].tolist())


def build(items: Sequence[tuple[str | None, str]]) -> tuple[dict[bytes, int], list[WuManber], list[str | None]]:
    """Word numbers, matchers by window length and item ids of one block of items."""
    vocabulary: dict[bytes, int] = {}
    texts = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)], np.uint64) for _, text in items]
    firsts = np.cumsum([0, *[len(t) for t in texts]])
    flat = np.concatenate([*texts, np.empty(0, np.uint64)])
    windows: dict[int, list[tuple[np.ndarray, int]]] = {}
    for k, (first, ids) in enumerate(zip(firsts.tolist(), texts)):
        if len(ids):
            size = min(WINDOW, len(ids))
            windows.setdefault(size, []).append((first + np.arange(len(ids) - size + 1), k))
    matchers = [WuManber(size, flat, np.concatenate([s for s, _ in found]), np.concatenate([np.full(len(s), k, np.int32) for s, k in found]))
                for size, found in sorted(windows.items())]
    return vocabulary, matchers, [item_id for item_id, _ in items]


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """The sorted union of word ranges."""
    out: list[dict[str, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def _scan(source: DataFrame, text_of, block: list[tuple[str | None, str]]) -> DataFrame:
    """Words, merged hit spans and item ids of every row against one block of items."""
    shared = source.sparkSession.sparkContext.broadcast(build(block))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, matchers, names = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            counts, hits, items = [], [], []
            for text in text_of(batch):
                ids = numbers(text.as_py(), vocabulary)
                counts.append(len(ids))
                spans, found, blocks = [], set(), {}
                for matcher in matchers:
                    for start, ks in matcher.find(ids, blocks):
                        spans.append((start, start + matcher.length))
                        found |= ks
                hits.append(_merged(spans))
                items.append(sorted({names[k] for k in found if names[k] is not None}))
            out = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[c for _, c in out], pa.array(counts, pa.int64()), pa.array(hits, kind), pa.array(items, pa.list_(pa.string()))],
                names=[*[n for n, _ in out], "n_words", "spans", "items"])

    return map_arrow(source, run, f"{kept}, n_words long, spans {SPANS}, items array<string>")


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       item_id: str = "item_id", item_text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(row, n_words, spans, items)``, one row per row of ``docs``; ``row`` is a struct of the ``carry`` columns.

    ``spans`` are the merged word ranges (end exclusive) inside occurring windows; ``items``
    are the sorted ids of items with occurring windows.
    """
    items = written(benchmark.select(F.col(item_id).cast("string").alias("item_id"), text_or_empty(item_text).alias("text")).distinct(),
                    "benchmark-items")
    # An item has at most as many windows as words.
    windows = items.agg(F.sum(F.regexp_count(F.lower("text"), F.lit(_WORD)))).first()[0] or 0
    blocks = windows // BLOCK_WINDOWS + 1
    number = F.pmod(F.xxhash64("text"), F.lit(blocks))
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    key = F.concat_ws("|", F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null")), F.md5(text_or_empty(f"`{text}`"))).alias("key")
    body = F.col(f"`{text}`").alias("text")
    at = list(carry).index(text) if text in carry else None
    result = None
    for b in range(blocks):
        # One block of items, about BLOCK_WINDOWS windows, at a time.
        block = [(r["item_id"], r["text"]) for r in items.where(number == b).collect()]
        if result is None:
            in_row = at is not None
            source = docs.select(row, *([] if blocks == 1 else [key]), *([] if in_row else [body]))
            result = _scan(source, (lambda batch: batch.column(0).field(at)) if in_row else (lambda batch: batch.column("text")), block)
            continue
        found = _scan(docs.select(key, body), lambda batch: batch.column("text"), block).where(F.size("spans") > 0)
        # Equal keys have equal texts, hence equal hits.
        more = found.groupBy("key").agg(F.first("spans").alias("more_spans"), F.first("items").alias("more_items"))
        result = result.join(more, "key", "left").select(
            "row", "key", "n_words", _union("spans", "more_spans").alias("spans"),
            F.array_sort(F.array_union("items", F.coalesce("more_items", F.array()))).alias("items"))
    return result.select("row", "n_words", "spans", "items")


def _union(a: str, b: str) -> Column:
    """Two lists of word ranges merged into one."""
    none = F.array().cast(SPANS)
    last = lambda out: F.element_at(out, -1)
    longer = lambda out, s: F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(
        last(out)["start"].alias("start"), F.greatest(last(out)["end"], s["end"]).alias("end"))))
    return F.aggregate(F.array_sort(F.concat(F.col(a), F.coalesce(F.col(b), none))), none, lambda out, s: F.when(
        (F.size(out) > 0) & (s["start"] <= F.get(out, F.size(out) - 1)["end"]), longer(out, s)).otherwise(F.concat(out, F.array(s))))


def hit_digest(found: DataFrame) -> DataFrame:
    """Counts and the digest of the item ids, for ``find_contamination``'s rows."""
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "row.doc_id", "n_words", total.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
