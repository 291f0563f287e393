"""Personal data spans: patterns propose, checksums confirm, context words adjust the score.

Every kind has a pattern, a validator and a prior score.  A proposed span that
its validator refuses is dropped.  Context words of the kind that reach into the
``CONTEXT_CHARS`` before or behind the span raise its score; spans scoring at least
``MIN_SCORE`` are reported.  The four base kinds (email, ip, card, phone) have
priors above that bound, so context only adds to their scores; the kinds added by
the method (IBAN with its country's length and a mod-97 check, and bare phone, national id and birth date
numbers that only context can carry) never replace base spans.

Cases: null and empty texts have no spans; offsets count code points of the
whole text; repeated rows get repeated results; every pattern runs in time
linear in the text, so very long texts and runs are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import map_arrow

MIN_SCORE = 0.6
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.35

# The base kinds in the order used for equal starts, then the added ones.
KINDS = ("email", "ip", "card", "phone", "iban", "phone_local", "national_id", "birth_date")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"[^\W\d_]+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The ISO 7064 check of an IBAN without spaces."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _card_ok(s: str) -> bool:
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def _phone_ok(s: str) -> bool:
    return 9 <= len(_digits(s)) <= 15


# IBAN lengths of the ISO 13616 registry.
IBAN_LENGTHS = {country: n for n, countries in {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}.items() for country in countries.split()}


def iban_end(s: str) -> int:
    """Where the IBAN at the start of a candidate ends, or 0.

    The country code fixes the length.  Codes without a known length are tried at
    each border of groups, the longest first.
    """
    ends = [*(i for i, c in enumerate(s) if c == " "), len(s)]
    for end in reversed(ends):
        bare = s[:end].replace(" ", "")
        if 15 <= len(bare) <= 34 and len(bare) == IBAN_LENGTHS.get(s[:2], len(bare)) and mod97(bare):
            return end
    return 0


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost IBANs; the search goes on after one that is accepted, or behind the start of a refused candidate."""
    m = _IBAN.search(text)
    while m:
        end = m.start() + iban_end(m.group())
        if end > m.start():
            yield m.start(), end
        m = _IBAN.search(text, max(end, m.start() + 1))


def _date_ok(s: str) -> bool:
    y, m, d = (int(x) for x in re.split(r"[-./]", s))
    return 1900 <= y <= 2100 and 1 <= m <= 12 and 1 <= d <= 31


class Rule(NamedTuple):
    """A kind's pattern, validator, prior score and context words.

    The guards of the patterns (look-behind, possessive repeats) only skip
    starts and retries that cannot match, so the matches are the leftmost ones.
    """

    kind: str
    pattern: re.Pattern[str]
    valid: Callable[[str], bool]
    prior: float
    words: frozenset[str]


RULES = (
    Rule("ip", re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), _ip_ok, 0.7, frozenset({"ip", "address", "host", "adresse"})),
    Rule("card", re.compile(r"[0-9](?:[ -]?[0-9])++"), _card_ok, 0.7,
         frozenset({"card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"})),
    Rule("phone", re.compile(r"\+[0-9][ ().0-9-]+[0-9]"), _phone_ok, 0.7,
         frozenset({"phone", "tel", "telephone", "mobile", "call", "telefon", "telefono"})),
    Rule("phone_local", re.compile(r"(?<![0-9+).-])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
         lambda s: True, 0.3, frozenset({"phone", "tel", "telephone", "mobile", "call", "telefon", "telefono"})),
    Rule("national_id", re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"),
         lambda s: True, 0.3, frozenset({"ssn", "social", "security"})),
    Rule("birth_date", re.compile(r"(?<![0-9])[0-9]{4}[-./][0-9]{2}[-./][0-9]{2}(?![0-9])"),
         _date_ok, 0.3, frozenset({"born", "birth", "birthday", "dob", "geboren", "geburtsdatum"})),
)
EMAIL_WORDS = frozenset({"email", "mail", "contact", "write"})
IBAN_WORDS = frozenset({"iban", "account", "konto", "compte", "cuenta", "bank"})
_BEYOND = 1 + max(len(w) for words in (EMAIL_WORDS, IBAN_WORDS, *(r.words for r in RULES)) for w in words)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost email matches, found from their ``@``: each match holds exactly one."""
    end = 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > end and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
        at = text.find("@", max(at + 1, end))


def _scored(text: str, kind: str, start: int, end: int, prior: float, words: frozenset[str]) -> Span:
    first, last = start - CONTEXT_CHARS, end + CONTEXT_CHARS
    # Words are read beyond the borders, so far that one cut there is longer than any context word.
    before = (m.group() for m in _WORD.finditer(text, max(0, first - _BEYOND), start) if m.end() > first)
    behind = (m.group() for m in _WORD.finditer(text, end, last + _BEYOND) if m.start() < last)
    hit = any(w.lower() in words for near in (before, behind) for w in near)
    return Span(kind, start, end, min(1.0, prior + CONTEXT_BONUS * hit))


def find_spans(text: str) -> list[Span]:
    """All reported spans of one text, by start and kind."""
    found = [_scored(text, "email", a, b, 0.7, EMAIL_WORDS) for a, b in emails(text)]
    found += [_scored(text, "iban", a, b, 0.7, IBAN_WORDS) for a, b in ibans(text)]
    for rule in RULES:
        for m in rule.pattern.finditer(text):
            if rule.valid(m.group()):
                found.append(_scored(text, rule.kind, m.start(), m.end(), rule.prior, rule.words))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted((s for s in found if s.score >= MIN_SCORE), key=lambda s: (s.start, order[s.kind], s.end))


SPAN_TYPE = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def detect_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, spans)``: one row per row of ``docs``, spans with kind, code point offsets and score."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            rows = [[s._asdict() for s in find_spans(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, spans {SPAN_TYPE}")


def span_digest(spans: DataFrame) -> DataFrame:
    """Counts of the base kinds and the joined spans, for ``detect_pii``'s rows."""
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:4]))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
