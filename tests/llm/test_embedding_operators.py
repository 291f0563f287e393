"""Hard negatives, whitening and exact duplicates against plain versions."""

import hashlib
import math
from collections import Counter

import helpers as h
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from storelens.llm import op11_hard_negatives as op11, op12_whitening as op12, op13_exact_dedup as op13
from storelens.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, rid long, id string, x int, row string, rank int, block int"


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash", 1, "r", 2, 3) for r in rows], VECTORS)


def _finite(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def _negatives(rows, relabel=True):
    """The rows of the contract by sorting all scores of every anchor."""
    part = [(i, [math.floor(256 * float(np.float32(c))) for c in v], (l + 1) % 10 if relabel and i is not None and i % 7 == 0 else l)
            for i, v, l in rows if l is not None and _finite(v)]
    length = max(((n, k) for k, n in Counter(len(v) for _, v, _ in part).items()), default=(0, 0))[1]
    part = [p for p in part if len(p[1]) == length]
    out = []
    for a, (i, v, label) in enumerate(part):
        if i is None or i % 100:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(v, w)), (j is None, j), l) for b, (j, w, l) in enumerate(part) if b != a), key=lambda s: s[:2])
        for ps, (_, p), _ in [s for s in scored if s[2] == label][:5]:
            found = [s for s in scored if s[2] != label and -30 * ps <= -100 * s[0] <= -90 * ps][:10]
            out += [(i, p, k, n, -ps, -ns) for k, (ns, (_, n), _) in enumerate(found, 1)]
    return sorted(out, key=str)


def _mined(spark, rows):
    return sorted(map(tuple, op11.mine(op11.relabelled(op11.quantised(_vectors(spark, rows)))).collect()), key=str)


_RNG = np.random.default_rng(11)


def _random_rows(n, d, labels=3, spread=0.4):
    return [(int(i), [float(c) for c in _RNG.normal(0, spread, d).astype(np.float32)], int(_RNG.integers(labels))) for i in range(n)]


EDGES = [(200, None, 1), (300, [0.1, float("nan"), 0.2, 0.0], 1), (400, [0.1, float("inf"), 0.2, 0.0], 1), (500, [0.1, None, 0.2, 0.0], 1),
         (600, [0.1, 0.2], 1), (700, [0.5, 0.5, 0.5, 0.5], None), (None, [0.3, 0.3, 0.3, 0.3], 1), (None, [0.3, 0.3, 0.3, 0.3], 2),
         (800, [0.0, 0.0, 0.0, 0.0], 1), (900, [-0.5, 0.25, -1.0, 2.0], 9), (-100, [0.2, -0.2, 0.1, 0.9], 1), (600, [], 2)]


@pytest.mark.parametrize("anchor_block,pack", [(4096, 512), (3, 7)])
def test_hard_negatives(spark, monkeypatch, anchor_block, pack):
    monkeypatch.setattr(op11, "ANCHOR_BLOCK", anchor_block)
    monkeypatch.setattr(op11, "PACK", pack)
    rows = _random_rows(420, 4) + EDGES + _random_rows(120, 4) + [(5, [0.25, 0.25, 0.25, 0.25], 1)] * 40 + [(6, [0.2, 0.2, 0.2, 0.2], 2)] * 40
    got = _mined(spark, rows)
    assert got and got == _negatives(rows)


def test_hard_negatives_ties(spark):
    same = [0.5, 0.25, -0.125]
    near = [0.25, 0.25, -0.125]
    rows = [(i, same if i % 3 else near, i % 2) for i in range(1, 230)] + [(0, same, 1), (0, same, 1)]
    got = _mined(spark, rows)
    assert got and got == _negatives(rows)


def test_hard_negatives_without_rows(spark):
    assert not _mined(spark, []) and not _mined(spark, [(100, None, 1), (200, [0.1], None)])
    assert not _mined(spark, [(1, [0.1], 1), (2, [0.1], 2)]) and not _mined(spark, [(100, [], 1), (200, [], 1)])
    # Without a positive, or with a score of 0 among others' negative ones, an anchor has no rows.
    assert not _mined(spark, [(100, [0.5], 1), (1, [0.4], 2)]) and not _mined(spark, [(100, [0.5], 1), (1, [-0.5], 1), (2, [-0.2], 2)])
    assert not op11.mine(op11.quantised(_vectors(spark, [(100, [3e38, 1.0], 1), (1, [1.0, 3e38], 1), (2, [1.0, 3e38], 2)]))).collect()


@given(st.integers(1, 9), st.integers(1, 40), st.integers(1, 6), st.sampled_from([0, 1, 200, 10**6]), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_packed_products_are_exact(length, n, m, size, rng):
    x = np.array([[rng.randint(-size, size) for _ in range(length)] for _ in range(n)], np.int64)
    a = np.array([[rng.randint(-size, size) for _ in range(length)] for _ in range(m)], np.int64)
    both = np.concatenate([x, a])
    fields = op11.Fields.for_range(int(both.min()), int(both.max()), length)
    packed = [int.from_bytes(b, "little") for b in op11.pack(x, fields)]
    got = op11.scores((a - fields.low).tolist(), a.sum(axis=1), packed, x.sum(axis=1), fields)
    assert (got == a @ x.T).all()


def _whitened(rows, k=32):
    """n, deviations and eigen-decomposition with numpy."""
    part = [(i, v) for i, v, _ in rows if _finite(v)]
    length = max(((n, d) for d, n in Counter(len(v) for _, v in part).items()), default=(0, 0))[1]
    part = [p for p in part if len(p[1]) == length]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in part], np.int64).reshape(len(part), length)
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(r, s)) for r in x]
    centred = (n * x - s) / max(n, 1)
    e, u = np.linalg.eigh(centred.T @ centred / max(n, 1))
    return [i for i, _ in part], n, deviation, centred, e[::-1][:k], u[:, ::-1][:, :k], e.sum()


@pytest.mark.parametrize("size,length", [(2**18, 5), (35, 5), (2**18, 40), (400, 40)])
def test_whitening(spark, monkeypatch, size, length):
    monkeypatch.setattr(op12, "BLOCK_VALUES", size)
    monkeypatch.setattr(op12, "SPLIT_BLOCKS", 2)
    scales = np.linspace(0.3, 2, length)
    rows = [(i, [float(c) for c in np.array(v) * scales], l) for i, v, l in _random_rows(230, length)]
    rows += [(2, None, 1), (3, [0.5] * (length - 1) + [float("nan")], 1), (4, [0.5] * (length - 1) + [None], 1), (5, [float("-inf")] * length, 1),
             (6, [0.5] * (length + 1), 1), (7, [], 1), (None, [0.7] * length, None), (1, rows[1][1], 0), (1, rows[1][1], 0)]
    got = op12.whiten(_vectors(spark, rows)).toPandas()
    ids, n, deviation, centred, e, u, trace = _whitened(rows)
    k = len(e)
    assert len(got) == len(ids) * k and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    z = centred @ u / np.sqrt(e)
    byrow = {}
    for r in got.itertuples():
        byrow.setdefault((None if r.vec_id != r.vec_id else int(r.vec_id), r.deviation), {}).setdefault(r.component, []).append((r.whitened, r.explained))
    signs = np.array([np.sign(byrow[(0, deviation[0])][c + 1][0][0] * z[0, c]) for c in range(k)])
    for i, d, row in zip(ids, deviation, z * signs):
        found = byrow[(i, d)]
        assert sorted(found) == list(range(1, k + 1))
        for c in range(k):
            assert len(found[c + 1]) == (3 if i == 1 else 1)
            assert abs(found[c + 1][0][0] - row[c]) < 1e-8 and abs(found[c + 1][0][1] / (e[c] / trace) - 1) < 1e-9


def test_whitening_without_variance(spark):
    rows = [(i, [0.5, i / 10, i / 10], 0) for i in range(20)]
    got = op12.whiten(_vectors(spark, rows)).toPandas()
    assert len(got) == 60 and (got[got.component > 1].whitened == 0).all() and got.identity_error[0] < 1e-9
    assert abs(got[got.component == 1].whitened.pow(2).mean() - 1) < 1e-9
    one = op12.whiten(_vectors(spark, rows[:1])).toPandas()
    assert len(one) == 3 and not one.whitened.any() and not one.deviation.any() and not one.explained.any() and not one.identity_error.any()
    for none in ([], [(1, None, 1)], [(1, [], 1), (2, [], 1)]):
        assert op12.whiten(_vectors(spark, none)).count() == 0


def test_deviation_beyond_a_long():
    assert op12._deviation(np.array([[3, 4], [2**32, 0], [2**31, 2**31], [3 * 10**9, 0]])) == [25, None, None, 9 * 10**18]


def _groups(rows):
    digest = [hashlib.sha256(h.lower(t or "").encode()).hexdigest() for _, t in rows]
    size = Counter(digest)
    keep = {}
    for (i, _), d in zip(rows, digest):
        keep[d] = max(keep.get(d, -2**63), -2**63 if i is None else i)
    kept, out = set(), []
    for (i, _), d in zip(rows, digest):
        stays = (-2**63 if i is None else i) == keep[d] and d not in kept
        kept |= {d} if stays else set()
        out.append((i, None if keep[d] == -2**63 else keep[d], size[d], stays, d))
    return sorted(out, key=str)


TEXTS = ["A b", "a B", "a b", " a b", None, "", "É", "é", "x" * 300_000, "X" * 300_000, "Same", "same", "a\x00b", "A\x00b", "é\U0001F600K", "é\U0001F600k", "K"]


@pytest.mark.parametrize("counters", [op13.COUNTERS, 3])
def test_exact_duplicates(spark, counters):
    texts = TEXTS + ["Hot text"] * 60 + ["hot tExt"] * 40 + [(5, "A b"), (5, "a b"), (None, "hot text"), (None, "only without id"), (None, "Only without id"), (7, "É")]
    docs = h.documents(spark, texts)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = op13.exact_duplicates(docs, counters=counters)
    assert sorted(map(tuple, op13.duplicate_digest(found).collect()), key=str) == _groups(rows)
    assert "Window" in found._jdf.queryExecution().toString()


def test_frequent_digests_reach_every_frequent_one(spark):
    values = [b"hot"] * 500 + [b"warm"] * 300 + [str(i).encode() for i in range(400)]
    digests = spark.createDataFrame([(v,) for v in values], "digest binary").repartition(7)
    found = {bytes(r["digest"]) for r in op13.frequent_digests(digests, len(values), 9).collect()}
    assert {b"hot", b"warm"} <= found and len(found) <= 10
    assert not op13.frequent_digests(digests.limit(0), 0, 9).collect()


@given(st.lists(st.lists(st.integers(0, 12), max_size=40), max_size=6), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_misra_gries_bounds(batches, counters):
    sketch = op13.MisraGries(counters)
    for batch in batches:
        met = Counter(batch)
        sketch.add(list(met), list(met.values()))
    true = Counter(v for b in batches for v in b)
    n = sum(true.values())
    assert len(sketch.counts) <= counters
    for v, k in true.items():
        assert k - n / (counters + 1) <= sketch.counts.get(v, 0) <= k


def test_one_row_of_each_text_stays(spark):
    docs = h.documents(spark, ["One", "one", None, "", "two", (1, "ONE"), (None, "two")])
    kept = op13.without_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], h.lower(r["text"] or ""), r["row"], r["doc"]) for r in kept.collect()) == [
        (1, "one", "r", 7), (3, "", "r", 7), (4, "two", "r", 7)]
    assert op13.without_duplicates(docs.limit(0)).count() == 0


def test_queries_are_registered():
    assert {"op11_hard_negatives", "op12_embedding_whitening", "op13_exact_duplicates"} <= set(QUERIES)
