"""Corpus-wide line dedup with keep bitmaps.

Texts become rows of (line key hash, document, positions), one row per distinct
line of a document.  The rows are range-partitioned by hash and document and
sorted inside each partition, so each partition streams runs of equal hashes in
document order: the first document of a run keeps its lines, later ones lose
theirs.  A hash that fills many partitions is spread by its documents; a run
that starts a partition is left pending, and is settled from one summary row per
partition (its first and last hash with their first documents), the only thing
the driver sees.  What comes out are per-document bitmaps, not texts.

Hashes are the 128 bits of the key's md5.

Cases: a null or empty text is one empty line; a null id sorts after every other
id; rows with one id are one document, and each of them keeps the lines that its
id may keep; bitmaps are held by (doc_id, hash of the text), so repeated rows get
the same one; lines shorter than ``MIN_CHARS`` code points after stripping always stay.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm.common import id_or_last, map_arrow, partitions, ship_package, text_or_empty, written

MIN_CHARS = 10
# Fixed value: the white space that is stripped.
SPACE = " \t\n\x0b\x0c\r"
#: Output rows of one Arrow batch.
BATCH_ROWS = 20_000

DROP, PENDING, SUMMARY = 0, 1, 2
_KEYS = ["h1", "h2", "doc", "text_hash"]
_LINES = "h1 long, h2 long, doc long, text_hash long, positions binary"
_TAGGED = ("kind int, part int, doc long, text_hash long, positions binary, "
           "first_h1 long, first_h2 long, first_doc long, last_h1 long, last_h2 long, last_doc long")


def line_keys(text: str) -> dict[bytes, list[int]]:
    """Positions of each line key of one text, long enough keys only."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split("\n")):
        if len(line) >= MIN_CHARS:
            key = line.strip(SPACE)
            if len(key) >= MIN_CHARS:
                found.setdefault(key.encode("utf-8").lower(), []).append(i)
    return found


def _emit_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, docs, texts, positions = bytearray(), [], [], []
        for text, doc, text_hash in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            for key, at in line_keys(text.as_py()).items():
                hashes += hashlib.md5(key).digest()
                docs.append(doc)
                texts.append(text_hash)
                positions.append(np.asarray(at, np.int32).tobytes())
        h = np.frombuffer(bytes(hashes), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(docs, pa.int64()), pa.array(texts, pa.int64()),
             pa.array(positions, pa.binary())], names=[*_KEYS, "positions"])


def _stream_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decides the lines of one sorted partition."""
    part = TaskContext.get().partitionId()
    first = last = None  # (h1, h2, first document) of the first and of the current run
    for batch in batches:
        h1, h2, doc = (batch.column(i).to_numpy() for i in range(3))
        n = len(h1)
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        continues = last is not None and (h1[0], h2[0]) == last[:2]
        new[0] = not continues
        run = np.cumsum(new)  # 0: the run that the batch before left open
        starts = np.flatnonzero(new)
        owners = np.concatenate([[last[2] if last is not None else 0], doc[starts]])
        first_open = first is None or (last is not None and first[:2] == last[:2] and continues)
        if first is None:
            first = (h1[0], h2[0], doc[0])
        in_first = (run == run[0]) if first_open else np.zeros(n, bool)
        drop = ~in_first & (doc != owners[run])
        last = (h1[-1], h2[-1], owners[run[-1]])
        for kind, chosen in ((DROP, drop), (PENDING, in_first)):
            at = np.flatnonzero(chosen)
            for lo in range(0, len(at), BATCH_ROWS):
                rows = batch.take(pa.array(at[lo:lo + BATCH_ROWS]))
                yield _tagged(kind, part, rows.num_rows, rows.column(2), rows.column(3), rows.column(4))
    if first is not None:
        yield _tagged(SUMMARY, part, 1, ends=[*first, *last])


def _tagged(kind: int, part: int, n: int, doc=None, text_hash=None, positions=None, ends=None) -> pa.RecordBatch:
    none = lambda t: pa.nulls(n, t)
    arrays = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)),
              doc if doc is not None else none(pa.int64()), text_hash if text_hash is not None else none(pa.int64()),
              positions if positions is not None else none(pa.binary())]
    arrays += [pa.array([int(x)], pa.int64()) for x in ends] if ends else [none(pa.int64()) for _ in range(6)]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _TAGGED.split(", ")])


def settle(summaries: list[tuple]) -> list[tuple[int, int]]:
    """(partition, owner of its first run) from (part, first h1, h2, doc, last h1, h2, doc) rows."""
    owners, carried = [], None
    for part, f1, f2, fdoc, l1, l2, ldoc in sorted(summaries):
        owner = carried[1] if carried and carried[0] == (f1, f2) else fdoc
        owners.append((part, owner))
        carried = ((l1, l2), owner if (l1, l2) == (f1, f2) else ldoc)
    return owners


def _bitmap(positions: pd.Series) -> pd.DataFrame:
    counts, maps = [], []
    for blobs in positions:
        at = np.frombuffer(b"".join(blobs), np.int32)
        keep = np.ones((at.max() // 8 + 1) * 8, bool)  # whole bytes, what follows the last dropped line stays
        keep[at] = False
        counts.append(len(at))
        maps.append(zlib.compress(np.packbits(keep).tobytes()))
    return pd.DataFrame({"n_dropped": counts, "keep": maps})


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, text_hash, n_dropped, keep)`` of the documents that lose lines.

    ``keep`` is a zlib-compressed bitmap that ends with the last dropped line;
    lines beyond it stay.  ``doc`` is the id, nulls as the largest long, and
    ``text_hash`` xxhash64 of the text.
    """
    spark = docs.sparkSession
    pack = F.pandas_udf(_bitmap, "struct<n_dropped:long,keep:binary>")
    body = text_or_empty(text)
    # Written first: the range bounds are drawn from the table, not from a second pass over the texts.
    lines = written(map_arrow(docs.select(body.alias("text"), id_or_last(doc_id).alias("doc"), F.xxhash64(body).alias("text_hash")), _emit_lines,
                              _LINES), "lines")
    ordered = lines.repartitionByRange(partitions(spark), *_KEYS).sortWithinPartitions(*_KEYS)
    tagged = written(map_arrow(ordered, _stream_runs, _TAGGED), "line-runs")
    ends = tagged.where(F.col("kind") == SUMMARY).select(
        "part", "first_h1", "first_h2", "first_doc", "last_h1", "last_h2", "last_doc")
    owners = spark.createDataFrame(settle([tuple(r) for r in ends.collect()]), "part int, owner long")
    pending = tagged.where(F.col("kind") == PENDING).join(F.broadcast(owners), "part").where("doc <> owner")
    return (tagged.where(F.col("kind") == DROP).select("doc", "text_hash", "positions")
            .union(pending.select("doc", "text_hash", "positions"))
            # One list is one document's lines; repeated rows bring equal blobs.
            .groupBy("doc", "text_hash").agg(F.collect_set("positions").alias("positions"))
            .select("doc", "text_hash", pack("positions").alias("packed"))
            .select("doc", "text_hash", "packed.n_dropped", "packed.keep"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``keep`` (null where every line stays); columns of these names are replaced."""
    body = text_or_empty(text)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "keep")]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), id_or_last(doc_id).alias("doc"),
                        F.xxhash64(body).alias("text_hash"))
    joined = keyed.join(bitmaps, ["doc", "text_hash"], "left")
    kept = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    return joined.select("row.*", (F.length(kept) - F.length(F.replace(kept, F.lit("\n"))) + 1).cast("long").alias("n_lines"),
                         F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "keep")


def apply_bitmap(text: str | None, keep: bytes | None) -> str:
    """The kept lines of one text."""
    if keep is None:
        return text or ""
    lines = (text or "").split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return "\n".join(line for i, line in enumerate(lines) if i >= len(bits) or bits[i])


def _shortened(text: pd.Series, keep: pd.Series) -> pd.Series:
    return pd.Series([None if k is None else apply_bitmap(t, k) for t, k in zip(text, keep)], dtype=object)


def kept_text(text: str = "text", keep: str = "keep") -> Column:
    """Texts without their dropped lines; only texts that lose some reach Python."""
    ship_package(SparkSession.active())
    shorten = F.pandas_udf(_shortened, "string")
    return F.coalesce(shorten(F.when(F.col(keep).isNotNull(), F.coalesce(F.col(text), F.lit(""))), F.col(keep)),
                      F.col(text), F.lit(""))
