"""Exact token counts with a whole-token shortcut.

The driver proves once, with the tokenizer itself, which vocabulary strings are
one pre-token that encodes alone as one token.  Tasks split texts into
pre-tokens; proven ones count one without any merging, and only the rest is
merged by the library, once per distinct pre-token while it stays in a bounded
cache.  The split is done by the pattern of the byte-level pre-tokenizer.  The
driver also proves for which characters pattern and library agree; a text that
holds any other character is encoded whole by the library.

Cases: null and empty texts have 0 bytes and 0 tokens; strings of added tokens
inside texts count as the library's default does; repeated rows repeat; texts
are never cut.
"""

from __future__ import annotations

import os
import re as stdre
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import map_arrow

#: Fixed value: the split of the byte-level pre-tokenizer (public_tokenizers.PATTERN).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens a task remembers besides the proven ones.
CACHE_ENTRIES = 300_000
#: Characters whose class is compared between pattern and library.
PROVEN_BELOW = 0x10000


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


def _load(spec: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_str(spec)
    tok.no_truncation()
    tok.no_padding()
    return tok


def prove_whole_tokens(spec: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token."""
    import json

    model = json.loads(spec)
    pre = model.get("pre_tokenizer") or {}
    if model.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("the shortcut needs a byte-level tokenizer without normaliser and prefix space")
    tok, letters, split = _load(spec), _byte_letters(), regex.compile(SPLIT)
    strings = []
    for token in tok.get_vocab(with_added_tokens=False):
        try:
            s = bytes(letters[c] for c in token).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if split.findall(s) == [s]:
            strings.append(s)
    return frozenset(s for s, e in zip(strings, tok.encode_batch(strings, add_special_tokens=False)) if len(e.ids) == 1)


def unproven_characters(spec: str) -> str:
    """A pattern for characters where library and pattern may split differently.

    Each character is put between a letter, a digit, a space and a mark, which
    shows its class; what differs, and all above PROVEN_BELOW, is not proven.
    """
    tok, split = _load(spec), regex.compile(SPLIT)
    safe, ranges = [], []
    for cp in range(PROVEN_BELOW):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        probe = f"a{c}a1{c}1 {c}!{c} "
        ours = [m.span() for m in split.finditer(probe)]
        if ours == [span for _, span in tok.pre_tokenizer.pre_tokenize_str(probe)]:
            safe.append(cp)
    for cp in safe:
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "[^" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges) + "]"


class TokenCounter:
    """Counts tokens in one task."""

    def __init__(self, spec: str, whole: frozenset[str], unproven: str):
        self.tok, self.split, self.unproven = _load(spec), regex.compile(SPLIT), stdre.compile(unproven)
        self.whole, self.cache = dict.fromkeys(whole, 1), {}
        added = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = stdre.compile("|".join(map(stdre.escape, added))) if added else None

    def count_all(self, texts: list[str | None]) -> list[int]:
        counts, waiting, rest = [0] * len(texts), [], {}
        whole, cache = self.whole, self.cache
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.unproven.search(text):
                counts[i] = len(self.tok.encode(text, add_special_tokens=False).ids)
                continue
            n = 0
            parts = self.added.split(text) if self.added else [text]
            n += len(parts) - 1
            for part in parts:
                for piece in self.split.findall(part):
                    if piece in whole:
                        n += 1
                    elif piece in cache:
                        n += cache[piece]
                    else:
                        waiting.append((i, piece))
                        rest[piece] = 0
            counts[i] = n
        if rest:
            pieces = list(rest)
            for piece, e in zip(pieces, self.tok.encode_batch_fast(pieces, add_special_tokens=False)):
                rest[piece] = len(e.ids)
            for i, piece in waiting:
                counts[i] += rest[piece]
            if len(cache) + len(rest) > CACHE_ENTRIES:
                cache.clear()
            if len(rest) <= CACHE_ENTRIES:
                cache.update(rest)
        return counts


#: Texts are counted in groups of about so many characters, which bounds what waits for merging.
GROUP_CHARS = 4_000_000


def count_tokens(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)``: one row per row of ``docs``; ``tokenizer_path`` is read on the driver only."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    # The vocabulary bounds what is broadcast.
    shared = docs.sparkSession.sparkContext.broadcast((spec, prove_whole_tokens(spec), unproven_characters(spec)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(*shared.value)
        for batch in batches:
            texts, counts, group, size = batch.column(1).to_pylist(), [], [], 0
            for t in texts:
                group.append(t)
                size += len(t or "")
                if size >= GROUP_CHARS:
                    counts += counter.count_all(group)
                    group, size = [], 0
            counts += counter.count_all(group)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                         F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"))
    return map_arrow(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
