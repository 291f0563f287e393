"""Near-duplicate components by fast similarity sketching, banding and exact checks.

Sketch: the distinct shingle hashes of a text are thrown into ``BINS`` bins, in
rounds.  In round i every hash gets a bin and a value i + fraction; a bin keeps its
smallest value, so earlier rounds win.  After ``BINS`` random rounds, round
``BINS`` + j throws everything into bin j, so every coordinate is filled, and
the share of equal coordinates of two sketches is concentrated around their
Jaccard similarity.  ``ROWS`` coordinates make a band; texts with an equal band
meet in a bucket.  A pair at 0.75 misses all ``BANDS`` bands with probability
(1 - 0.75 ** 7) ** 80, about 1e-5.

From buckets to components, without emitting all pairs of a bucket:

1. Texts with equal sets become one class and one node, whatever their ids are.
2. Each class is compared with one leader: among all it meets, the class that
   meets most others.  Verified links give the first components.
3. A bucket whose classes lie in one component is done.  In the others, classes
   outside the bucket's largest component meet all classes of other components.
   Pairs whose sizes or sketch bits rule out the threshold are skipped (the bits of
   a pair at the threshold are that far apart with probability below 1e-8), as are
   those of one leader that cannot have enough in common: which of the leader's
   shingles a class has is known exactly, and a bitmap of its other shingles bounds
   what two classes share of those.  The others are verified.

Every link is confirmed on the full sets of 64-bit shingle hashes.

Cases: texts without words have an empty set and are their own component, as are
null texts; texts of fewer words than a shingle have one shingle; a null id is
the largest id, and its component_id is null where no other id is in the
component; rows are judged by their own text, so rows of one id or without one may
differ, and lie in different components or as near copies in the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import NULL_ID, id_or_last, map_arrow, small_side, text_or_empty, written

SHINGLE = 5
#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 75
ROWS, BANDS = 7, 80
BINS = ROWS * BANDS
#: Bits of a sketch that are compared: one per coordinate, in whole longs.
LONGS = BINS // 64
BITS = 64 * LONGS
#: Equal bits that a pair needs.  At the threshold they are 0.875 of 512 with a deviation of 7.5.
MIN_EQUAL_BITS = int(BITS * (1 + PERCENT / 100) / 2 - 5.7 * 7.5)
#: Ids up to this many are broadcast to the texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Pairs of one node that are compared in one go.
CHUNK_PAIRS = 32
#: Classes with more than one in this many rows get their component by a broadcast; there are fewer than this many.
HOT_CLASSES = 4096
#: Words a task remembers the hashes of.
CACHE_WORDS = 100_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_FILLED = np.uint64(2**64 - 1)
_LOW = np.uint64(2**32 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the splitmix64 finaliser; fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of texts; remembers hashes of words."""

    def __init__(self):
        self.words: dict[bytes, int] = {}

    def shingles(self, text: str) -> np.ndarray:
        """Sorted hashes of the text's distinct shingles."""
        words = text.encode("utf-8").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        known = self.words
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        size = min(SHINGLE, len(words))
        out = np.full(len(words) - size + 1, size, np.uint64)
        for j in range(size):
            out = _mix(out * _GOLDEN + h[j:len(h) - size + 1 + j])
        return np.unique(out)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The BINS coordinates of a non-empty set."""
    bins = np.full(BINS, _FILLED, np.uint64)
    at, n = 0, len(shingles)
    # Rounds come in groups of as many as fill the bins with high odds; later rounds never displace earlier ones.
    group = max(1, -(-int(BINS * (np.log(BINS) + 3)) // n))
    while at < BINS and (bins == _FILLED).any():
        rounds = np.arange(at, min(at + group, BINS), dtype=np.uint64)
        h = _mix(shingles[None, :] + (rounds * _GOLDEN)[:, None]).ravel()
        values = (np.repeat(rounds, n) << np.uint64(32)) | (h & _LOW)
        np.minimum.at(bins, (((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64), values)
        at += group
    empty = np.flatnonzero(bins == _FILLED)
    last = np.uint64(BINS) + empty.astype(np.uint64)
    for j, number, seed in zip(empty, last, last * _GOLDEN):
        bins[j] = (number << np.uint64(32)) | (_mix(shingles + seed) & _LOW).min()
    return bins


_BAND_KEYS = _mix(np.arange(1, ROWS + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
_BAND_SEEDS = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def band_hashes(bins: np.ndarray) -> np.ndarray:
    return _mix((_mix(bins.reshape(BANDS, ROWS)) * _BAND_KEYS).sum(axis=1, dtype=np.uint64) + _BAND_SEEDS)


def sketch_bits(bins: np.ndarray) -> np.ndarray:
    return np.packbits((_mix(bins[:BITS]) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    none = np.zeros(BANDS, np.uint64), np.zeros(LONGS, np.int64)
    for batch in batches:
        sizes, digests, bands, bits = [], [], [], []
        for text in batch.column(2):
            s = shingler.shingles(text.as_py())
            bins = sketch(s) if len(s) else None
            sizes.append(len(s))
            digests.append(hashlib.md5(s.tobytes()).digest())
            bands.append(band_hashes(bins) if len(s) else none[0])
            bits.append(sketch_bits(bins) if len(s) else none[1])
        n = len(sizes)
        flat = pa.array(np.concatenate(bands).view(np.int64) if n else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
             pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), flat),
             *[pa.array([b[k] for b in bits], pa.int64()) for k in range(LONGS)]],
            names=["doc", "text_hash", "n_shingles", "set_key", "bands", *_BIT_NAMES])


_BIT_NAMES = [f"b{k}" for k in range(LONGS)]
_SKETCH_TYPE = "doc long, text_hash long, n_shingles long, set_key binary, bands array<long>, " + ", ".join(f"{b} long" for b in _BIT_NAMES)


def _shingle_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        sets = [shingler.shingles(t.as_py()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])


def _common(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of pairs, which shingles of b are in a and a bitmap of a's others, from rows ``(b, chunk, a, shingles)``:
    b's own set, with a null a, comes before those that it is compared with.  Sets are read in place; one b's set is kept."""
    y = np.empty(0, np.uint64)
    for batch in batches:
        ids, counts, masks, others = [], [], [], []
        for b, a, shingles in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            x = np.frombuffer(shingles.as_buffer(), np.uint64)
            if a is None:
                y = x.copy()
                continue
            inside = np.isin(y, x, assume_unique=True)
            rest = x[~np.isin(x, y, assume_unique=True)]
            other = np.zeros(len(y) + -len(y) % 64, bool)
            other[(rest % np.uint64(len(other))).astype(np.int64)] = True
            ids.append((a, b))
            counts.append((len(x), len(y), int(inside.sum()), len(rest) - int(other.sum())))
            masks.append(np.packbits(np.pad(inside, (0, -len(y) % 64))).view(np.int64))
            others.append(np.packbits(other).view(np.int64))
        columns = np.array([(*i, *c) for i, c in zip(ids, counts)], np.int64).reshape(-1, 6)
        yield pa.RecordBatch.from_arrays([*[pa.array(columns[:, k]) for k in range(6)],
                                          *[pa.array(bits, pa.list_(pa.int64())) for bits in (masks, others)]],
                                         names=["a", "b", "n_a", "n_b", "common", "spare", "mask", "other"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` with the sizes of their full sets, the number of common shingles, ``mask``, the
    bits of b's sorted shingles that a has, ``other``, the places of a's other shingles in a bitmap of that length,
    and ``spare``, how many of those found their place taken.

    The pairs of one b come in chunks of about ``CHUNK_PAIRS``; b's set is sent once
    to each chunk and sorted before the sets to compare with it.
    """
    pairs = written(pairs, "pairs")
    large = small_side(pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK_PAIRS), BROADCAST_IDS, "large")
    chunks = F.coalesce(F.ceil(F.col("n") / CHUNK_PAIRS), F.lit(1))
    dealt = pairs.join(large, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), chunks).alias("chunk"))
    of = lambda key: sets.select(F.col("node").alias(key), "shingles")
    firsts = dealt.select("b", "chunk").distinct().join(of("b"), "b").select("b", "chunk", F.lit(None).cast("long").alias("a"), "shingles")
    both = firsts.unionByName(dealt.join(of("a"), "a")).repartition("b", "chunk").sortWithinPartitions(F.col("b"), F.col("chunk"), F.asc_nulls_first("a"))
    return map_arrow(both.select("b", "chunk", "a", "shingles"), _common, "a long, b long, n_a long, n_b long, common long, spare long, mask array<long>, other array<long>")


def _reaches(common: Column, n_a: Column, n_b: Column) -> Column:
    return 100 * common >= PERCENT * (n_a + n_b - common)


def _links(counted: DataFrame) -> DataFrame:
    return counted.where(_reaches(F.col("common"), F.col("n_a"), F.col("n_b"))).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes in ``links (a, b)``: the smallest node reachable.

    Each round takes the smallest label among neighbours and then the label's own
    label; rounds end when no label changes.  Every round is a written table.
    """
    both = written(links.union(links.select("b", "a")).distinct(), "links").toDF("node", "other")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        seen = both.join(labels.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.join(seen, "node").select("node", "component", F.least("component", "near").alias("lower"))
        jump = labels.toDF("lower", "far")
        after = written(lower.join(jump, "lower", "left").select(
            "node", "component", F.least("lower", F.coalesce("far", "lower")).alias("next")), "labels")
        labels = after.select("node", F.col("next").alias("component"))
        if after.where("next <> component").isEmpty():
            return labels


def most_common(x: str, y: str) -> Column:
    """No fewer shingles than two classes of one leader have in common.

    Of the leader's shingles, exactly those that both have.  Of the others, common ones
    have the same place in both bitmaps: no more than places that are set in both, and
    as many as found their place taken, in the class with fewer of those.
    """
    shared = lambda bits: F.aggregate(
        F.zip_with(F.col(f"{x}.{bits}"), F.col(f"{y}.{bits}"), lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda n, k: n + k)
    return shared("mask") + shared("other") + F.least(f"{x}.spare", f"{y}.spare")


def _possible(x: str, y: str) -> Column:
    """Two bucket rows may be linked, and this is the first bucket that they share.

    Ruled out are pairs whose sizes differ too much, whose sketch bits are too far
    apart, that were compared already, or that share a leader and cannot have enough
    in common.
    """
    of = lambda row, c: F.col(f"{row}.{c}")
    n_x, n_y = of(x, "n_shingles"), of(y, "n_shingles")
    sizes = 100 * F.least(n_x, n_y) >= PERCENT * F.greatest(n_x, n_y)
    apart = sum((F.bit_count(of(x, b).bitwiseXOR(of(y, b))) for b in _BIT_NAMES), F.lit(0))
    new = (of(x, "node") != of(y, "leader")) & (of(y, "node") != of(x, "leader"))
    enough = (of(x, "leader") != of(y, "leader")) | _reaches(most_common(x, y), n_x, n_y)
    equal = F.filter(F.zip_with(of(x, "bands"), of(y, "bands"), lambda p, q: F.when(p == q, p)), lambda p: p.isNotNull())
    return sizes & new & enough & (apart <= BITS - MIN_EQUAL_BITS) & (F.get(equal, 0) == of(x, "bucket"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, text_hash, set_key, n_shingles, component, leads)``: one row per row of ``docs``.

    ids are longs, null ids the largest; ``text_hash`` is xxhash64 of the text;
    ``component`` is the smallest id of the component, and ``leads`` marks the rows of
    the one class of each component that has it (ties: the smallest ``set_key``).
    """
    body = text_or_empty(text)
    source = docs.select(id_or_last(doc_id).alias("doc"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    sketches = written(map_arrow(source, _sketches, _SKETCH_TYPE), "sketches")
    # The numbers only tell the classes apart; they stay as written.
    classes = written(sketches.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc").alias("doc"), F.count("*").alias("rows")).withColumn(
        "node", F.monotonically_increasing_id()), "classes")

    one = sketches.join(classes.drop("rows"), ["doc", "set_key"]).dropDuplicates(["node"])
    signed = written(one, "class-sketches")
    rows = signed.select("node", F.explode("bands").alias("bucket"))
    met = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    meeting = written(rows.join(met, "bucket"), "buckets")

    weights = written(meeting.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    weighed = meeting.select("bucket", "node").join(weights, "node")
    leaders = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("order"))).alias("leader"))
    chosen = weighed.join(leaders, "bucket").where("leader.order <> -node").groupBy("node").agg(F.max("leader").alias("leader"))
    star = chosen.select(F.col("node").alias("a"), (-F.col("leader.order")).alias("b"))

    wanted = small_side(weights.select("node").join(signed.select("node", "doc", "text_hash"), "node"), BROADCAST_IDS, "wanted")
    texts = source.join(wanted, ["doc", "text_hash"]).select("node", "text")
    sets = written(map_arrow(texts, _shingle_sets, "node long, shingles binary").dropDuplicates(["node", "shingles"]), "sets")

    counted = written(compared(star, sets), "star")
    links = _links(counted)
    labels = components(links)
    # A node's leader and what it has of the leader's shingles and beside them; a node without one leads itself.
    led = counted.select(F.col("a").alias("node"), F.col("b").alias("_leader"), "spare", "mask", "other")
    traits = signed.join(led, "node", "left").select("node", "n_shingles", "bands", *_BIT_NAMES, F.coalesce("_leader", "node").alias("leader"),
                                                     "spare", "mask", "other")
    placed = meeting.select("bucket", "node").join(labels, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component"))
    per = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    open_ = per.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("largest"), F.count("*").alias("parts")).where(
        "parts > 1").select("bucket", F.col("largest.component").alias("largest"))
    left = written(placed.join(open_, "bucket").join(traits, "node"), "open-buckets")
    x, y = left.where("component <> largest").alias("x"), left.alias("y")
    rest = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") != F.col("y.component"))
                  & ((F.col("y.component") == F.col("y.largest")) | (F.col("x.node") < F.col("y.node"))) & _possible("x", "y"))
    pairs = rest.select(F.least("x.node", "y.node").alias("b"), F.greatest("x.node", "y.node").alias("a")).distinct()
    more = written(_links(compared(pairs.select("a", "b"), sets)), "links")
    final = components(links.union(more))

    first = final.join(classes, "node").groupBy("component").agg(F.min(F.struct("doc", "set_key")).alias("first"))
    linked = final.join(first, "component").select("node", "first")
    of_class = written(classes.join(linked, "node", "left").select(
        "set_key", "rows", F.coalesce("first.doc", "doc").alias("component"),
        F.coalesce(F.col("first.set_key") == F.col("set_key"), F.lit(True)).alias("leads")), "class-components")
    rows = sketches.select("doc", "text_hash", "set_key", "n_shingles")
    filled, empty = rows.where("n_shingles > 0"), rows.where("n_shingles = 0")
    hot = F.col("rows") * HOT_CLASSES > sketches.count()
    frequent = F.broadcast(of_class.where(hot).drop("rows"))
    others = filled.join(frequent, "set_key", "left_anti").join(of_class.where(~hot).drop("rows"), "set_key")
    alone = empty.withColumns({"component": F.col("doc"), "leads": F.lit(True)})
    return filled.join(frequent, "set_key").unionByName(others).unionByName(alone).select(
        "doc", "text_hash", "set_key", "n_shingles", "component", "leads")


def _stays() -> Column:
    """The row has the smallest id of its component, and its text is the one that stays."""
    return F.col("leads") & (F.col("doc") == F.col("component"))


def one_of_each(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, by its smallest id, and every row without words."""
    stays = found.where(_stays() & (F.col("n_shingles") > 0))
    # Dealt anew by document: the join on the set that leads here may then split a large class of copies.
    one = stays.select("doc", "set_key", "text_hash").repartition("doc", "set_key").groupBy("doc", "set_key").agg(
        F.min("text_hash").alias("text_hash")).select("doc", "text_hash")
    empty = found.where("n_shingles = 0").select("doc", "text_hash")
    body = text_or_empty(text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_or_last(doc_id).alias("doc"),
                       F.xxhash64(body).alias("text_hash"))
    return rows.join(one.union(empty), ["doc", "text_hash"], "left_semi").dropDuplicates(["doc", "text_hash"]).select("row.*")


def component_digest(found: DataFrame) -> DataFrame:
    """One row per document: its set size, component and whether it is the one that stays."""
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(back("doc").alias("doc_id"), "n_shingles", back("component").alias("component_id"),
                        _stays().alias("kept"))
