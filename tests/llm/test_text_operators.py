"""Mixing, personal data, line dedup, token counts and decontamination against plain versions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import helpers as h
from conftest import SF_SMALL
from storelens.llm import op3_mixing, op6_pii, op7_line_dedup, op8_tokens, op9_decontamination, queries

PII = ["write to a.b+c@mail.example.com, 10.0.0.256 and 10.0.0.25.1", "4111 1111 1111 1111 or 4111111111111112",
       "+1 (017) 555-7713 x +49 30 1234567 +1", "x@y @z.de a@b.c@d.e é\U0001F600 u@v.w", "iban DE89 3704 0044 0532 0130 00",
       "DE89 3704 0044 0532 0130 01", "phone 555-123-4567 but 555-123-4567 elsewhere" + " far" * 20 + " 555-987-6543",
       "9" * 4000 + "." + "1.2.3.4" * 50, "a" * 20000 + "@", None, "", "ssn 123-45-6789", "1.2.3.4" * 3 + " 5.6.7"]


def test_pii_matches_plain_patterns(spark):
    got = op6_pii.span_digest(op6_pii.detect_pii(h.documents(spark, PII))).orderBy("doc_id").collect()
    assert len(got) == len(PII)
    for row, text in zip(got, PII):
        want = h.base_spans(text)
        assert row["base_sha256"] == h.sha(",".join(f"{k}:{a}:{b}" for k, a, b in want))
        assert [row[f"n_{k}"] for k in op6_pii.KINDS[:4]] == [sum(x[0] == k for x in want) for k in op6_pii.KINDS[:4]]
    assert "iban:5:32" in got[4]["spans"] and "iban" not in got[5]["spans"]
    assert got[6]["spans"].count("phone_local") == 2 and "national_id:4:15" in got[11]["spans"]


@pytest.mark.parametrize("text, ibans", [
    ("IBAN AT61 1904 3002 3457 3201 BIC BKAUATWW", ["AT61 1904 3002 3457 3201"]),
    ("BE68 5390 0754 7034 BIC GKCCBEBB", ["BE68 5390 0754 7034"]),
    ("ES9121000418450200051332 EUR", ["ES9121000418450200051332"]),
    ("AT61 1904 3002 3457 3201 BE68 5390 0754 7034 DE89370400440532013000", ["AT61 1904 3002 3457 3201", "BE68 5390 0754 7034", "DE89370400440532013000"]),
    ("NR12 3456 7890 AT61 1904 3002 3457 3201 SWIFT", ["AT61 1904 3002 3457 3201"]),
    ("AT61 1904 3002 3457 3202 BIC, BE68 5390 0754 7034X", []),
])
def test_ibans_end_where_their_country_says(text, ibans):
    assert [text[s.start:s.end] for s in op6_pii.find_spans(text) if s.kind == "iban"] == ibans


@pytest.mark.parametrize("text, kinds", [
    ("078-05-1120 is my social security number", ["national_id"]),
    ("555-123-4567 (phone)", ["phone_local"]),
    ("1980-02-29 is when I was born", ["birth_date"]),
    ("telephone" + " " * 38 + "555-123-4567", ["phone_local"]),
    ("a hotel" + " " * 38 + "555-123-4567" + " " * 37 + "telex and phone", []),
    ("555-123-4567" + " " * 39 + "phone", ["phone_local"]),
    ("555-123-4567" + " " * 40 + "phone", []),
])
def test_context_on_both_sides(text, kinds):
    assert [s.kind for s in op6_pii.find_spans(text)] == kinds


@given(st.text(alphabet="a1 .@+-()0\n9é\U0001F600", max_size=60))
@settings(max_examples=400, deadline=None)
def test_pii_base_property(text):
    found = [(s.kind, s.start, s.end) for s in op6_pii.find_spans(text) if s.kind in op6_pii.KINDS[:4]]
    assert found == h.base_spans(text)


LINES = ["shared line one\nown alpha text\nshared line one", "  SHARED line ONE \t\nshort\nown beta text", None, "", "short\nshort\n",
         "shared line one", (None, "shared line one\nonly without id"), (9, "Ärger und Öl\nshared line one"), (9, "shared line one\nother row"),
         (9, "shared line one\nother row"), "ärger und öl", "\n".join(["repeated in one"] * 50), "\r\nown alpha text\r\n"]


def _kept(spark, docs):
    out = op7_line_dedup.with_bitmaps(docs, op7_line_dedup.dedup_lines(docs))
    return [(r["doc_id"], r["n_lines"], r["t"]) for r in out.withColumn("t", op7_line_dedup.kept_text()).collect()]


def _order(rows):
    return sorted(rows, key=str)


def test_line_dedup_small(spark):
    docs = h.documents(spark, LINES)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert _order(_kept(spark, docs)) == _order(h.kept_lines(rows))


def test_line_dedup_hot_line_over_many_partitions(spark):
    texts = [f"the same line everywhere\nline of {i % 7} some documents\nown line number {i}" for i in range(400)]
    docs = h.documents(spark, texts, first=5).repartition(13)
    assert _order(_kept(spark, docs)) == _order(h.kept_lines([(i, t) for i, t in enumerate(texts, 5)]))


def test_line_runs_settle_over_partitions():
    rows = [(0, 1, 1, 4, 2, 2, 9), (1, 2, 2, 11, 2, 2, 11), (2, 2, 2, 30, 3, 3, 5), (3, 4, 4, 8, 4, 4, 8)]
    assert op7_line_dedup.settle(rows) == [(0, 4), (1, 9), (2, 9), (3, 8)]


TOKEN_TEXTS = ["Hello world's  it's\n\n  x", "a<|endoftext|>b <|endoftext|>", "naïve café über ÑÑ", "日本語 text ١٢٣ x​y͸", "\x1c\x1d \x85\xa0 z",
               None, "", "ab" * 30000, "   ", "\U0001F600\U0001F600 don't 12345 !!!???", "ǅ ⅷ ² ૱   　 x"]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.TOKENIZER)
    return path, Tokenizer.from_file(path)


def test_token_counts_equal_library(spark, tokenizer):
    path, tok = tokenizer
    got = op8_tokens.count_tokens(h.documents(spark, TOKEN_TEXTS), path).orderBy("doc_id").collect()
    want = [len(tok.encode(t or "", add_special_tokens=False).ids) for t in TOKEN_TEXTS]
    assert [r["n_tokens"] for r in got] == want
    assert [r["n_bytes"] for r in got] == [len((t or "").encode()) for t in TOKEN_TEXTS]


def test_token_counts_of_the_table(spark, tokenizer):
    path, tok = tokenizer
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in op8_tokens.count_tokens(docs, path).collect():
        assert r["n_tokens"] == len(tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids)


_counter = {}


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_token_count_property(text):
    import public_tokenizers

    if not _counter:
        spec = open(public_tokenizers.path(queries.TOKENIZER), encoding="utf-8").read()
        _counter["c"] = op8_tokens.TokenCounter(spec, op8_tokens.prove_whole_tokens(spec), op8_tokens.unproven_characters(spec))
    c = _counter["c"]
    assert c.count_all([text, text]) == [len(c.tok.encode(text, add_special_tokens=False).ids)] * 2


ITEMS = [("b", "One two three four five six seven eight nine ten eleven TWELVE"), ("a", "Short item-here"), ("c", "one two three four five six seven eight nine ten"),
         ("d", None), ("e", " .. "), (None, "null id words"), ("b", "another text of item b with more than ten words in it ok"), ("z", "solo")]
ITEM_DOCS = ["x one two, three four five six seven eight nine ten eleven twelve y", "SHORT item here; short item", "null id words", None, "", "...",
             "one two three four five six seven eight nine", "solo solo x", "two three four five six seven eight nine ten eleven one two three four",
             "another text of item b with more than ten words in it", "é one two three four five six seven eight nine ten " * 300]


def _contamination(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id string, text string")
    out = op9_decontamination.hit_digest(op9_decontamination.find_contamination(docs, bench)).collect()
    return {r["doc_id"]: r for r in out}


@pytest.mark.parametrize("windows", [10**6, 12])
def test_contamination_matches_plain_search(spark, monkeypatch, windows):
    monkeypatch.setattr(op9_decontamination, "BLOCK_WINDOWS", windows)
    got = _contamination(spark, h.documents(spark, ITEM_DOCS), ITEMS)
    assert len(got) == len(ITEM_DOCS)
    for i, text in enumerate(ITEM_DOCS):
        n, hit, ids = h.hits(text, ITEMS)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (
            n, hit, len(ids), h.sha(",".join(ids)), hit > 0), i


def test_contamination_keeps_columns_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(op9_decontamination, "BLOCK_WINDOWS", 5)
    docs = h.documents(spark, ITEM_DOCS).withColumnsRenamed({"row": "key", "keep": "items", "spans": "_row_key"})
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    found = op9_decontamination.find_contamination(docs, bench, carry=tuple(docs.columns))
    assert found.select("row.*").columns == docs.columns
    assert sorted(map(str, found.select("row.*").collect())) == sorted(map(str, docs.collect()))


def test_a_large_benchmark_is_compact():
    import pickle
    import random

    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(20_000)]
    items = [(str(k), " ".join(rng.choices(vocabulary, k=400))) for k in range(500)]
    vocabulary, matchers, names = op9_decontamination.build(items)
    # 196,000 windows
    assert len(pickle.dumps((matchers, names))) < 60 * 500 * 391
    text = "x " + items[7][1] + " y z " + " ".join(items[8][1].split()[5:15])
    found = {(start, names[k]) for m in matchers for start, ks in m.find(op9_decontamination.numbers(text, vocabulary)) for k in ks}
    assert found == {(1 + i, "7") for i in range(391)} | {(403, "8")}


def test_contamination_without_items(spark):
    got = _contamination(spark, h.documents(spark, ITEM_DOCS), [])
    assert not any(r["contaminated"] for r in got.values()) and got[0]["n_words"] == 14


@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=14), max_size=4))
@settings(max_examples=300, deadline=None)
def test_wu_manber_property(doc, items):
    text = " ".join(f"w{i}" for i in doc)
    bench = [(str(k), " ".join(f"w{i}" for i in x)) for k, x in enumerate(items)]
    vocabulary, matchers, names = op9_decontamination.build(bench)
    ids = op9_decontamination.numbers(text, vocabulary)
    spans, found = set(), set()
    for m in matchers:
        for start, ks in m.find(ids):
            spans.update(range(start, start + m.length))
            found |= {names[k] for k in ks}
    assert (len(ids), len(spans), sorted(found)) == h.hits(text, bench)


def test_mixing_rates_and_draws(spark):
    docs = spark.createDataFrame([(i, "word " * 20, "a" if i % 10 else "b", 3) for i in range(4000)], "doc_id long, text string, source string, copy_no int")
    out = op3_mixing.mix_sources(docs, weights={"a": 0.5, "b": 0.5})
    assert out.columns == ["doc_id", "text", "source", "copy_no", "shuffle_key"]
    per = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(per["a"] - 2000) < 5 * math.sqrt(2000) and abs(per["b"] - 2000) < 5 * math.sqrt(2000 * 6)
    zero = op3_mixing.mix_sources(docs, weights={"b": 1.0})
    assert [r["source"] for r in zero.select("source").distinct().collect()] == ["b"]
    copies = out.where("source = 'b'").groupBy("doc_id").count().toPandas()["count"]
    # Poisson with mean 5: variance equals the mean, counting the documents drawn zero times.
    full = list(copies) + [0] * (400 - len(copies))
    mean = sum(full) / 400
    var = sum((x - mean) ** 2 for x in full) / 400
    assert 4.3 < mean < 5.7 and 0.7 < var / mean < 1.3


def test_mixing_deals_repeated_rows_apart(spark):
    docs = h.documents(spark, [(None, "")] * 4000 + [(None, "same text")] * 4000 + [(1, "row")] * 4000)
    mixed = op3_mixing.mix_sources(docs.repartition(4))
    sizes = [r["n"] for r in mixed.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) > 4000 and len(sizes) > 1 and max(sizes) < 2 * sum(sizes) / len(sizes)
    first = [r["text"] for r in mixed.where("copy_no = 1").limit(200).collect()]
    assert 1 < len({(a, b) for a, b in zip(first, first[1:])})


def test_mixing_high_rates_and_edges(spark):
    docs = h.documents(spark, ["word", None, "", "word", (None, "no id"), (None, None)])
    out = op3_mixing.mix_sources(docs, epochs=200.0)
    assert out.columns == [*docs.columns, "copy_no", "shuffle_key"]
    n = out.groupBy("doc_id").count().collect()
    assert any(r["count"] > 60 for r in n)
    again = op3_mixing.mix_sources(docs, epochs=200.0)
    assert _order([tuple(r) for r in out.collect()]) == _order([tuple(r) for r in again.collect()])


def test_empty_tables(spark):
    empty = h.documents(spark, ["x"]).limit(0)
    assert op3_mixing.mix_sources(empty).count() == 0
    assert op6_pii.detect_pii(empty).count() == 0
    assert _kept(spark, empty) == []
    import public_tokenizers

    assert op8_tokens.count_tokens(empty, public_tokenizers.path(queries.TOKENIZER)).count() == 0
    assert _contamination(spark, empty, ITEMS) == {}
