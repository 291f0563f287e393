"""Small tables and plain versions of the operators' base rules."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, doc long, keep string, spans string"


def documents(spark, texts, first=0):
    """A documents table with clashing extra columns; items are texts or (id, text)."""
    rows = []
    for i, t in enumerate(texts, first):
        doc_id, text = t if isinstance(t, tuple) else (i, t)
        rows.append((doc_id, text, "en" if i % 3 else None, f"src{i % 2}" if i % 4 else None, len(text or ""), "r", 7, "k", "s"))
    return spark.createDataFrame(rows, DOC_SCHEMA)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def kept_lines(rows):
    """(doc_id, kept text) of every row, by the line dedup rule."""
    docs = [(i if i is not None else 2**63 - 1, (t or "").split("\n")) for i, t in rows]
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, lines in docs:
        for line in lines:
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    return [(rows[n][0], len(lines), "\n".join(x for x in lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == i))
            for n, (i, lines) in enumerate(docs)]


def base_spans(text):
    """The contract's base kinds, straight from their patterns."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    found = [(m.start(), n, k, m.end()) for n, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m.group())]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def hits(text, items):
    """(words, hit words, sorted ids of occurring items) by plain comparison at every position."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    words = split(text)
    hit, ids = set(), set()
    for item_id, item in items:
        iw = split(item)
        size = min(10, len(iw))
        for s in range(len(iw) - size + 1 if size else 0):
            for p in range(len(words) - size + 1):
                if words[p:p + size] == iw[s:s + size]:
                    hit.update(range(p, p + size))
                    ids.add(item_id)
    return len(words), len(hit), sorted(str(i) for i in ids if i is not None)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def near_components(rows):
    """id -> (set size, component) by comparing all pairs; ids are distinct."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by the contract's wording."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i:i + 3])].append(i)
    repeated = {p + k for ps in places.values() if len(ps) > 1 for p in ps for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated))
