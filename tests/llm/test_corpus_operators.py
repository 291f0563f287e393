"""WARC, quality rules and classifier, licences, near-duplicates and the pipeline against plain versions."""

import gzip
import hashlib
import math
import random
import re
import textwrap

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
import helpers as h
from conftest import SF_SMALL
from storelens.llm import common, op1_warc, op2_quality_rules, op4_quality, op5_licenses, op10_minhash
from storelens.llm.oracles import ORACLES
from storelens.llm.queries import QUERIES
from storelens.sources.tables import TABLES

BIG = "<html>" + "same payload " * 20 + "é</html>"
PAGES = [(5, "http://www.Example.com:80/b?x=1#frag", BIG), (3, "https://example.com/a", BIG), (9, None, BIG), (1, "http://a.example.com", "short"),
         (2, "http://a.example.com", "short"), (4, "http://u@b.org/x y\n", None), (None, "http://example.com/a", "\r\n\r\nWARC/1.1\r\n" + "z" * 200),
         (7, "", ""), (7, "", ""), (3, "https://example.com/a", BIG), (11, "http://example.com/" + "p" * 5000, "x" * 300_000)]


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, page string, offset int")


def _want_records(rows):
    low = {}
    for i, _, t in rows:
        b = (t or "").encode()
        if len(b) >= 100:
            low[b] = min(low.get(b, 2**63), 2**63 - 1 if i is None else i)
    out = []
    for i, _, t in rows:
        b = (t or "").encode()
        owner = low.get(b)
        again = owner is not None and owner != (2**63 - 1 if i is None else i)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", owner if again else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark):
    got = op1_warc.record_digest(op1_warc.round_trip(spark, _pages(spark, PAGES))).collect()
    want = _want_records(PAGES)
    assert sorted(map(tuple, got), key=str) == want


@pytest.mark.parametrize("lines,archive", [(2, 300), (1000, 10**9)])
def test_warc_index_and_files(spark, monkeypatch, lines, archive):
    monkeypatch.setattr(op1_warc, "BLOCK_LINES", lines)
    monkeypatch.setattr(op1_warc, "ARCHIVE_BYTES", archive)
    rows = [(i, f"http://h{i % 3}.example.com/{i % 50}", f"<p>{i}</p>" * 30) for i in range(200)] + [(7, "http://h1.example.com/7", "twice")]
    folder = common.scratch(spark, "warc-test")
    index = op1_warc.build_index(op1_warc.write_archives(op1_warc.tagged_pages(_pages(spark, rows)), folder), folder)
    assert sum(len(gzip.open(f"{folder}/{s.name}.blocks.gz", "rt").read().split("\n")) for s in index.shards) >= 1
    reader = op1_warc.IndexReader(index)
    assert len(list(reader.find("com,example,h1)/7", 7))) == 2 and not list(reader.find("com,example,h1)/7", 8))
    assert not list(reader.find("zz)/", 0)) and not list(reader.find("a)/", 0))
    some = spark.createDataFrame([("com,example,h2)/5", 5), ("com,example,h2)/5", 5), ("none)/", 1)], "key string, page long")
    records = op1_warc.fetch(op1_warc.locate(some, index), folder).collect()
    assert [(r["page"], bytes(r["payload"]).decode()) for r in records] == [(5, "<p>5</p>" * 30)]
    key, page = index.shards[0].first
    archive_file, offset, length = next(op1_warc.IndexReader(index).find(key, page))
    with open(f"{folder}/{archive_file}", "rb") as f:
        f.seek(offset)
        raw = gzip.decompress(f.read(length))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and op1_warc.parse_record(raw)[0]["X-Page-ID"] == str(page)
    with pytest.raises(ValueError):
        op1_warc.parse_record(raw[:-3])


def test_warc_folder_has_a_scheme(spark):
    folder = op1_warc.shared_folder(spark, "warc")
    assert folder.startswith("file:/") and op1_warc._store(folder)[1].startswith("/")
    assert op1_warc._store("/plain/path")[1] == "/plain/path"


def test_warc_empty(spark):
    assert op1_warc.round_trip(spark, _pages(spark, PAGES[:1]).limit(0)).count() == 0


_RNG = random.Random(4)
CLEAN = " ".join("".join(_RNG.choices("abdefghilmnoprstu", k=_RNG.randint(2, 9))) + (". " if i % 11 == 10 else "") for i in range(300))
QUALITY = [CLEAN, None, "", "a b c", CLEAN.replace(" ", "### "), "\n".join(["same line here ok"] * 40), "word " * 200, CLEAN.upper().replace(" ", "!! "),
           " ".join(f"w{i}é\U0001F600" for i in range(60)) + "\r\n\x0b\t x y z x y z", "\n".join(f"* item {i} of the list is here" for i in range(60)),
           " ".join(str(i * 7919) for i in range(300)), " | ".join(f"cell{i}" for i in range(90)), "a b a b a b\n\n \na b a b a b", "long" * 50_000]


def test_quality_counts(spark):
    docs = h.documents(spark, QUALITY)
    counts = op2_quality_rules.base_counts(docs)
    judged = op2_quality_rules.apply_cascade(counts, op2_quality_rules.plan_cascade(docs)).orderBy("doc_id").collect()
    for row, text in zip(judged, QUALITY):
        n = h.quality_counts(text)
        assert tuple(row[c] for c in op2_quality_rules.COUNTS) == n, row["doc_id"]
        assert row["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (row["base_failed"] and row["kept"])
    assert judged[0]["kept"] and not any(judged[i]["kept"] for i in (1, 2, 3, 4, 5, 6, 7, 9, 10, 11))
    listed = op2_quality_rules.apply_cascade(counts, op2_quality_rules.rules()).orderBy("doc_id").collect()
    assert [r["kept"] for r in listed] == [r["kept"] for r in judged]
    assert len(op2_quality_rules.plan_cascade(docs.limit(0))) == len(op2_quality_rules.rules())


def test_cascade_goes_by_rejections_and_cost(spark):
    docs = h.documents(spark, [CLEAN + f" {i}" + (" !" * 20 if i % 2 else "") + ("?" if i == 5 else "") for i in range(60)])
    text = F.col("text")
    slow = text
    for _ in range(40):
        slow = F.regexp_replace(slow, "(a|b|c)(d|e|f)?", "$1$2")
    given = [op2_quality_rules.Rule("dear_and_idle", F.length(slow) < 0), op2_quality_rules.Rule("idle", F.length(text) < 0),
             op2_quality_rules.Rule("few", text.endswith("?")), op2_quality_rules.Rule("many", F.contains(text, F.lit(" ! !"))),
             op2_quality_rules.Rule("dear", (F.length(slow) > 0) & F.contains(text, F.lit("! !")))]
    order = [r.name for r in op2_quality_rules.plan_cascade(docs, listed=given)]
    assert order.index("many") < min(order.index(x) for x in ("dear", "idle", "dear_and_idle", "few")) and set(order) == {r.name for r in given}
    counts = op2_quality_rules.base_counts(docs)
    by_order = {tuple(r) for r in op2_quality_rules.apply_cascade(counts, op2_quality_rules.plan_cascade(docs, listed=given)).select("doc_id", "kept").collect()}
    assert by_order == {tuple(r) for r in op2_quality_rules.apply_cascade(counts, given).select("doc_id", "kept").collect()}


def test_samples_hold_at_any_size(spark):
    ids = spark.range(200_000).select(F.col("id"), F.concat(F.lit("x"), F.col("id")).alias("s"))
    for share in (1.0, 0.01, 1e-4):
        n = ids.where(common.hash_sample(F.col("s"), share)).count()
        assert abs(n - 200_000 * share) <= 6 * (200_000 * share) ** 0.5 * (share < 1)
    # 2,000 of 10**13 documents: a bound in whole millionths would be 0.
    assert "<= 0" not in str(common.hash_sample(F.col("s"), 2e-10)._jc)


LICENSES = ["Some text\nReleased under the MIT License.\nmore", "LICENSED!! UNDER!! CC!! BY-NC!! 4.0!!", "Licensed under CC BY 4.0", None, "", "one",
            op5_licenses.TEMPLATES["MIT-notice"].replace(", ", ",\n"), "a licence of no kind at all, released under the rain",
            "Released under the MIT License.\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.", "x " * 100_000]


def _dice(text, templates=op5_licenses.TEMPLATES, threshold=op5_licenses.THRESHOLD):
    grams = lambda t: set(zip(*[[w for w in re.split(r"[\W_]+", t.lower()) if w][k:] for k in (0, 1)]))
    lines = (text or "").split("\n")
    out = []
    for unit, line in [*enumerate(lines), *([(-1, text)] if len(lines) > 1 else [])]:
        a = grams(line)
        scores = [(2 * len(a & grams(t)) / (len(a) + len(grams(t))), name) for name, t in templates.items()]
        best = max(s for s, _ in scores)
        if best >= threshold:
            out.append((unit, next(n for s, n in scores if s == best), best))
    return out


def test_license_matches(spark):
    got = op5_licenses.scan_licenses(h.documents(spark, LICENSES)).orderBy("doc_id").collect()
    assert len(got) == len(LICENSES)
    for row, text in zip(got, LICENSES):
        assert [(m["unit"], m["license"], pytest.approx(m["dice"])) for m in row["matches"]] == _dice(text)
    assert got[0]["matches"][0]["license"] == "MIT" and got[6]["matches"][0]["unit"] == -1


def test_license_sizes_at_the_bounds(spark):
    # 9 bigrams against 6, 6 against 4, and the fewest that reach a template of 33: all have a Dice coefficient of 0.8.
    isc = " ".join(op5_licenses.TEMPLATES["ISC"].split()[:22])
    assert (len(op5_licenses.bigrams(isc)), len(op5_licenses.bigrams(op5_licenses.TEMPLATES["ISC"]))) == (22, 33)
    texts = ["This work is licensed under CC BY-NC 4.0.", "Code is released under the MIT License.", isc]
    got = op5_licenses.scan_licenses(h.documents(spark, texts)).orderBy("doc_id").collect()
    assert [[(m["unit"], m["license"], m["dice"]) for m in r["matches"]] for r in got] == [
        [(0, "CC-BY-NC-4.0", 0.8)], [(0, "MIT", 0.8)], [(0, "ISC", 0.8)]]


def test_license_windows(spark):
    code = "\n" + "\n".join(f"value_{i} = compute(value_{i - 1}, the_{i})" for i in range(1, 41))
    names = ["GPL-3.0-notice", "MIT-notice", "ISC", "Apache-2.0-notice"]
    wrapped = [textwrap.fill(op5_licenses.TEMPLATES[n], 76) + code for n in names]
    inside = "The toolkit was written by many people over the years. Released under the MIT License. It runs on most systems."
    texts = [*wrapped, inside, "first line\n" + inside + " Docs are licensed under CC BY 4.0." + code + "\n" + inside,
             code + "\nReleased under the MIT License." + code, "Released under the rain." + code]
    got = op5_licenses.scan_licenses(h.documents(spark, texts)).orderBy("doc_id").collect()
    found = [[(m["unit"], m["license"], m["dice"]) for m in r["matches"]] for r in got]
    assert found[:4] == [[(0, n, 1.0)] for n in names]
    assert found[4] == [(0, "MIT", 1.0)]
    assert found[5] == [(1, "MIT", 1.0), (1, "CC-BY-4.0", 1.0), (42, "MIT", 1.0)]
    assert found[6:] == [[(41, "MIT", 1.0)], []]


def _windows(text, templates, threshold):
    """The windows of the docstring's wording, by trying every start and length; (unit, license, dice) by start."""
    cut = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    lines = [cut(line) for line in (text or "").split("\n")]
    words = [w for line in lines for w in line]
    line_of = [i for i, line in enumerate(lines) for _ in line]
    chain = [f"{a} {b}" for a, b in zip(words, words[1:])]
    found = []
    for order, (name, body) in enumerate(templates.items()):
        spoken = cut(body)
        grams = {f"{a} {b}" for a, b in zip(spoken, spoken[1:])}
        most = math.floor((2 - threshold) / threshold * (len(spoken) - 1) + 1e-9)
        for start in range(len(chain)):
            if chain[start] not in grams:
                continue
            best = (0.0, 0)
            for n in range(1, min(most, len(chain) - start) + 1):
                own = set(chain[start:start + n])
                dice = 2 * len(own & grams) / (len(own) + len(grams))
                best = max(best, (dice, n), key=lambda b: b[0])
            if best[0] >= threshold:
                found.append((-best[0], -len(grams), order, start, best[1], name))
    taken = []
    for w in sorted(found):
        if all(w[3] + w[4] < v[3] or v[3] + v[4] < w[3] for v in taken):
            taken.append(w)
    units = [(u, n, d) for u, n, d in _dice(text, templates, threshold)]
    own = [(w[3], line_of[w[3]], w[5], -w[0]) for w in taken if not any(
        n == w[5] and (u == -1 or line_of[w[3]] <= u <= line_of[w[3] + w[4]]) for u, n, _ in units)]
    return units + [w[1:] for w in sorted(own)]


def test_license_windows_over_random_texts(spark):
    rng = random.Random(5)
    templates = {"A": "one two three four five six", "B": "two three four nine ten", "C": "five six seven eight one two three four", "D": "ten one two"}
    pool = "one two three four five six seven eight nine ten other".split()
    texts = []
    for _ in range(60):
        words = []
        while len(words) < rng.randrange(5, 70):
            words += rng.choice(list(templates.values())).split()[rng.randrange(3):] if rng.random() < 0.5 else rng.choices(pool, k=rng.randrange(1, 6))
        texts.append("".join(w + rng.choice([" ", " ", " ", ", ", "\n", "\n\n"]) for w in words))
    got = op5_licenses.scan_licenses(h.documents(spark, texts), templates).orderBy("doc_id").collect()
    for row, text in zip(got, texts):
        assert [(m["unit"], m["license"], round(m["dice"], 9)) for m in row["matches"]] == [
            (u, n, round(d, 9)) for u, n, d in _windows(text, templates, op5_licenses.THRESHOLD)], text


def test_a_text_full_of_licence_words_stays_cheap(spark):
    import time

    body = "\n".join(textwrap.fill(op5_licenses.TEMPLATES["MIT-text"], 70) + f"\nfile {i} of many" for i in range(40))
    assert len(body) > 30_000
    began = time.perf_counter()
    found = op5_licenses.scan_licenses(h.documents(spark, [body])).collect()
    assert len([m for m in found[0]["matches"] if m["license"] == "MIT-text"]) == 40
    assert time.perf_counter() - began < 60


def test_license_templates_name_the_right_license(spark):
    body = "\n" + "\n".join(f"Clause {i} of {i + 7} more clauses binds party {i * 3}." for i in range(60))
    sentences = [("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
                 ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
                 ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
                 ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", "MPL-1.1")]
    every = list(op5_licenses.TEMPLATES)
    texts = [*(t for t, _ in sentences), *op5_licenses.TEMPLATES.values(), *(textwrap.fill(op5_licenses.TEMPLATES[n], 60) + body for n in every)]
    want = [*(n for _, n in sentences), *every, *every]
    got = op5_licenses.license_digest(op5_licenses.scan_licenses(h.documents(spark, texts))).orderBy("doc_id").collect()
    assert [r["license"] for r in got] == want
    assert all(r["dice"] == 1.0 for r in got[:len(sentences) + len(every)])
    assert {"GPL-2.0", "LGPL-2.1", "AGPL-3.0", "BSD-2-Clause", "EPL-2.0", "Unlicense", "GPL-2.0-text", "BSD-2-Clause-text"} <= set(every)


def _sample(spark):
    return (spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"),
            spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality"))


def test_quality_classifier_on_held_out_rows(spark):
    docs, labels = _sample(spark)
    training = op4_quality.training_rows(docs, labels)
    assert set(training.columns) == {"label", *op4_quality.STATISTICS}
    model = op4_quality.fit(training)
    assert 0 < len(model.rules) < 200
    out = op4_quality.score_documents(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    auc = (np.searchsorted(np.sort(bad), good, "left") + np.searchsorted(np.sort(bad), good, "right")).sum() / (2 * len(good) * len(bad))
    assert auc > 0.9, auc
    right = ((out.score >= 0.3).astype(int) == out.quality).mean()
    assert right > 0.93 and (out[out.quality == 1].predicted == 1).mean() > 0.98, right


def _plain_statistics(text):
    """STATISTICS of one text, character class by character class."""
    raw = (text or "").encode()
    if not raw:
        return dict.fromkeys(op4_quality.STATISTICS, 0.0)
    n, words, lines = len(raw), raw.split(), raw.split(b"\n")
    some = max(len(words), 1)
    share = lambda inside: sum(inside(b) for b in raw) / n
    often = {w: words.count(w) for w in set(words)}
    freq = [raw.count(bytes([b])) / n for b in set(raw)]
    blank = share(lambda b: b == 32 or 9 <= b <= 13)
    return {
        "log_chars": math.log(1 + len(text)), "log_words": math.log(1 + len(words)), "word_length": n * (1 - blank) / some,
        "upper": share(lambda b: 65 <= b <= 90), "digit": share(lambda b: 48 <= b <= 57), "symbol": share(lambda b: chr(b) in "#*$%&<>@^~_=+\\/{}[]"),
        "exclamation": share(lambda b: b == 33), "pipe": share(lambda b: b == 124), "punctuation": share(lambda b: chr(b) in ".,;:?'\"()-"),
        "beyond_ascii": share(lambda b: b > 127), "space": blank, "distinct_words": len(often) / some, "top_word": max(often.values(), default=0) / some,
        "distinct_pairs": len(set(zip(words, words[1:]))) / some, "line_length": math.log(1 + n / len(lines)),
        "repeated_lines": 1 - len(set(lines)) / len(lines), "long_words": len([w for w in words if len(w) > 14]) / some,
        "sentence_ends": len([w for w in words if w.endswith((b".", b"?", b"!"))]) / some, "entropy": -sum(p * math.log2(p) for p in freq)}


def test_quality_scores_equal_a_walk_over_the_rules(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, "é! # | x" * 50), (-4, "a\n" * 400), (None, "A.B? c! " + "w" * 20)], "doc_id long, text string"))
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").select("doc_id", "quality")
    model = op4_quality.train(docs, labels)
    assert model.rules
    got = sorted(((r["doc_id"], r["score"], r["predicted"]) for r in op4_quality.score_documents(docs, model).collect()), key=str)
    want = []
    for r in docs.collect():
        stats = _plain_statistics(r["text"])
        logit = model.intercept + sum(w for rule, w in model.rules if all(
            stats[name] <= value if side == "<=" else stats[name] > value for name, side, value in rule))
        score = 1 / (1 + math.exp(-logit))
        want.append((r["doc_id"], score, int(score >= 0.3)))
    for g, w in zip(got, sorted(want, key=str)):
        assert g[0] == w[0] and abs(g[1] - w[1]) < 1e-9 and g[2] == w[2]


def test_quality_classifier_edges(spark):
    texts = [None, "", "a word", "x" * 100_000, "é\U0001F600"]
    docs = h.documents(spark, texts)
    labels = spark.createDataFrame([(0, 1), (1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    constant = op4_quality.train(docs, labels)
    scores = op4_quality.score_documents(docs, constant).orderBy("doc_id").collect()
    assert len(scores) == 5 and all(r["score"] > 0.99 and r["predicted"] == 1 for r in scores)
    rule = frozenset({("log_words", "<=", 0.0)})
    low = op4_quality.score_documents(docs, op4_quality.RuleModel(2.0, [(rule, -4.0)])).orderBy("doc_id").collect()
    assert [r["predicted"] for r in low] == [0, 0, 1, 1, 1]
    assert op4_quality.score_documents(docs.limit(0), constant).count() == 0
    assert op4_quality.train(docs, labels.limit(0)).rules == []


def _copies(seed, groups):
    """Word salad with exact copies, near copies at many distances, chains and unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [None, "", "  \n", "one two", "One  two", "one two three four five", "one two three four five six"]
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([8, 30, 120, 400]))
        texts.append(" ".join(base))
        current = base
        for k in range(rng.choice([0, 1, 4, 25])):
            source = current if g % 2 else base
            edited = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in source]
            current = edited
            texts.append((" ".join(edited)).upper() if k % 5 == 0 else "\n".join(edited))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_all_pairs(spark, seed):
    rows = list(enumerate(_copies(seed, 40), 3))
    docs = h.documents(spark, rows).repartition(5)
    got = {r["doc_id"]: r for r in op10_minhash.component_digest(op10_minhash.near_duplicates(docs)).collect()}
    want = h.near_components(rows)
    assert len(got) == len(rows)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_near_duplicates_hot_group_and_passage(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    base = [f"b{i}" for i in range(200)]
    texts = [passage + " " + " ".join(rng.choices([f"u{i}" for i in range(5000)], k=rng.choice([10, 60, 200]))) for _ in range(150)]
    texts += [" ".join(w if rng.random() > p else f"e{rng.random()}" for w in base) for p in [rng.choice([0.005, 0.02, 0.05]) for _ in range(150)]]
    texts += [" ".join(base)] * 60
    rows = list(enumerate(texts))
    got = op10_minhash.component_digest(op10_minhash.near_duplicates(h.documents(spark, rows))).collect()
    want = h.near_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in want.items()}


def test_near_duplicates_null_ids_and_empty(spark):
    docs = h.documents(spark, [(None, "alpha beta gamma"), (4, "alpha beta gamma"), (None, None), (4, "alpha beta gamma"), (None, "own words")])
    found = op10_minhash.near_duplicates(docs)
    got = sorted(map(tuple, op10_minhash.component_digest(found).collect()), key=str)
    assert got == sorted([(None, 1, 4, False), (4, 1, 4, True), (None, 0, None, True), (4, 1, 4, True), (None, 1, None, True)], key=str)
    stay = sorted((str(r["doc_id"]), str(r["text"])) for r in op10_minhash.one_of_each(docs, found).collect())
    assert stay == [("4", "alpha beta gamma"), ("None", "None"), ("None", "own words")]
    empty = docs.limit(0)
    assert op10_minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_rows_that_share_an_id(spark):
    text = lambda name, *edits: " ".join(f"{name}{i}" if i not in edits else f"{name}-edit{i}" for i in range(200))
    rows = [(5, text("x")), (None, text("x", 7)), (9, text("y")), (None, text("y", 3)), (None, text("z")), (None, text("z", 90)),
            (None, text("z", 90, 120)), (20, text("u")), (20, text("u", 4)), (20, text("v")), (None, text("w"))]
    docs = h.documents(spark, rows)
    found = op10_minhash.near_duplicates(docs)
    got = op10_minhash.component_digest(found).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted(
        [(5, 5), (None, 5), (9, 9), (None, 9), *[(None, None)] * 4, *[(20, 20)] * 3], key=str)
    assert sum(r["kept"] for r in got) == 6
    stay = [(r["doc_id"], r["text"].split()[0]) for r in op10_minhash.one_of_each(docs, found).collect()]
    assert sorted(stay, key=str) == sorted([(5, "x0"), (9, "y0"), (None, "z0"), (20, "u0"), (20, "v0"), (None, "w0")], key=str)


def test_bound_on_common_shingles_holds(spark):
    rng = np.random.default_rng(11)
    leader = rng.integers(0, 2**63, 300).astype(np.uint64)
    extra = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = {i: np.unique(np.concatenate([rng.choice(leader, rng.integers(150, 300), replace=False),
                                         rng.choice(extra, rng.integers(0, 350), replace=False)])) for i in range(1, 40)} | {0: np.unique(leader)}
    rows = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "node long, shingles binary")
    pairs = spark.createDataFrame([(i, 0) for i in sets if i], "a long, b long")
    traits = op10_minhash.compared(pairs, rows).select(F.col("a").alias("node"), "spare", "mask", "other")
    x, y = traits.alias("x"), traits.alias("y")
    most = x.join(y, F.col("x.node") < F.col("y.node")).select("x.node", "y.node", op10_minhash.most_common("x", "y")).collect()
    slack = [bound - len(np.intersect1d(sets[a], sets[b])) for a, b, bound in most]
    assert len(slack) == 39 * 38 // 2 and min(slack) >= 0
    assert all(bound <= min(len(sets[a]), len(sets[b])) for a, b, bound in most)


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=3000))
@settings(max_examples=40, deadline=None)
def test_sketch_is_filled_and_ignores_grouping(values):
    x = np.array(sorted(values), np.uint64)
    bins = op10_minhash.sketch(x)
    assert (bins != np.uint64(2**64 - 1)).all()
    slow = np.full(op10_minhash.BINS, 2**64 - 1, np.uint64)
    for i in range(0, 12):  # the first rounds one by one: they hold every coordinate that they fill
        hashed = op10_minhash._mix(x + np.full(1, i, np.uint64) * op10_minhash._GOLDEN)
        at = (((hashed >> np.uint64(32)) * np.uint64(op10_minhash.BINS)) >> np.uint64(32)).astype(int)
        np.minimum.at(slow, at, (np.uint64(i) << np.uint64(32)) | (hashed & np.uint64(2**32 - 1)))
    filled = slow != np.uint64(2**64 - 1)
    assert (bins[filled] == slow[filled]).all()


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    y = np.concatenate([x[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    same = (op10_minhash.sketch(np.unique(x)) == op10_minhash.sketch(np.unique(y))).mean()
    assert abs(same - 800 / 1200) < 0.08


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(rows):
    return sorted(tuple("" if v is None else (f"{v:.9g}" if isinstance(v, float) else str(v)) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    res = con.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = _norm([tuple(r[names.index(c)] for c in cols) for r in res.fetchall()])
    assert _norm(df.select(*cols).collect()) == want


def test_pipeline_stages_against_plain_versions(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(common.written(stage(spark, steps[-1], SF_SMALL), "stage"))
    assert all(tuple(s.columns) == corpus_pipeline.COLUMNS for s in steps[:-1])
    rows = [[(r["doc_id"], r["text"]) for r in s.orderBy("doc_id").collect()] for s in steps[:-1]]
    model = op4_quality.train(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    kept = {r["doc_id"] for r in op4_quality.score_documents(docs, model).where("predicted = 1").collect()}
    assert rows[1] == [x for x in rows[0] if x[0] in kept]
    assert rows[2] == [(i, t) for i, _, t in h.kept_lines(rows[1])]
    want = h.near_components(rows[2])
    assert rows[3] == [x for x in rows[2] if want[x[0]][1] == x[0]]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows[4] == [x for x in rows[3] if not h.hits(x[1], items)[1]]
    mixed = steps[5].collect()
    assert {(r["doc_id"], r["text"]) for r in mixed} <= set(rows[4])
    assert 0.6 * len(rows[4]) < len(mixed) < 1.5 * len(rows[4])
    whole = corpus_pipeline.run(spark, SF_SMALL)
    assert _norm(whole.collect()) == _norm(mixed)


def test_pipeline_edges(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "x", "en", "s", 1), (2, "", "de", "s", 0), (2, "", "de", "s", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = common.written(stage(spark, frame, SF_SMALL), "stage")
        assert frame.columns == [*corpus_pipeline.COLUMNS, "copy_no", "shuffle_key"]
