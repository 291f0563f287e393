"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# The stripped characters are tab, line feed, vertical tab, form feed, carriage return and space.
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES["op7_line_dedup_bitmaps"] = f"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, {_SPACE}), {_UPPER}) AS k FROM lines),
owners AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (
  SELECT l.doc_id, l.line, l.pos, o.owner IS NOT NULL AND l.doc_id <> o.owner AS dropped
  FROM keyed l LEFT JOIN owners o ON l.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

ORACLES["op3_source_mixing"] = """
WITH keyed AS (
  SELECT *, coalesce('s' || source, 'null') AS sk,
         coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) AS rk FROM documents),
sizes AS (SELECT sk, sum(strlen(coalesce(text, '')))::DOUBLE AS bytes FROM keyed GROUP BY sk),
rates AS (
  SELECT sk, CASE WHEN bytes > 0
    THEN (pow(bytes, 0.7) / sum(pow(bytes, 0.7)) OVER ()) * (sum(bytes) OVER () / bytes) ELSE 1.0 END AS rate
  FROM sizes),
parts AS (SELECT sk, rate, greatest(ceil(rate / 32.0), 1)::INT AS parts FROM rates),
steps AS (
  SELECT sk, parts, rate / parts AS r, unnest(range(0, (ceil(rate / parts + 12 * sqrt(rate / parts) + 30) + 1)::BIGINT)) AS k
  FROM parts),
cdfs AS (
  SELECT sk, parts, list(c ORDER BY k) AS cdf
  FROM (SELECT sk, parts, k, sum(exp(-r + k * ln(r) - lgamma(k + 1))) OVER (PARTITION BY sk ORDER BY k) AS c FROM steps)
  GROUP BY sk, parts),
drawn AS (
  SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(cdf, lambda c: c <=
           ('0x' || substr(md5('mix-1|' || rk || '|' || j), 1, 13))::BIGINT / 4503599627370496.0))))::BIGINT AS copies
  FROM keyed d JOIN cdfs USING (sk)),
copied AS (SELECT doc_id, text, lang, source, n_chars, rk, unnest(range(1, copies + 1)) AS copy_no FROM drawn)
SELECT doc_id, text, lang, source, n_chars, copy_no,
       md5('mix-1|order|' || rk || '|' || copy_no) AS shuffle_key
FROM copied
"""


ORACLES["op1_warc_round_trip"] = """
WITH d AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, min(page_id) AS owner FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN o.owner <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN o.owner <> d.page_id THEN o.owner END AS refers_to
FROM d LEFT JOIN o ON d.payload_digest = o.payload_digest AND d.payload_bytes >= 100
"""

_WORDS = r"'[^\x20\x09-\x0D]+'"
_NO_WORD = r"'^[\x20\x09-\x0D]*$'"

ORACLES["op2_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, {_WORDS}) AS ws,
         list_filter(string_split(t, chr(10)), lambda x: NOT regexp_full_match(x, {_NO_WORD})) AS ls FROM d),
grams AS (
  SELECT rid, unnest(range(len(ws) - 2)) AS pos,
         unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g
  FROM w WHERE len(ws) >= 3),
again AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, g) AS n FROM grams),
covered AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS p FROM again WHERE n >= 2) GROUP BY rid),
c AS (
  SELECT w.*, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (rid)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(word_chars, 1) AS cs FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 30 * len(ls) OR cs < 2 * n_words OR cs > 20 * n_words
    OR 100 * len(regexp_extract_all(t, '!')) > 30 * n_words OR 100 * len(regexp_extract_all(t, '[0-9]')) > 30 * cs
    OR 100 * len(regexp_extract_all(t, '\p{{Lu}}')) > 50 * cs
    OR 100 * len(regexp_extract_all(t, '[^\p{{L}}\x20\x09-\x0D]')) > 50 * cs
    OR 100 * len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-•*‣◦]'))) > 90 * len(ls)
    OR 100 * len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 30 * len(ls)
    OR 100 * len(regexp_extract_all(t, '[{{}}<>\\]')) > 10 * cs) AS kept
FROM f
"""


def _license_sql() -> str:
    from storelens.llm.op5_licenses import TEMPLATES

    quoted = ", ".join("({}, '{}', '{}')".format(i, k, v.replace("'", "''")) for i, (k, v) in enumerate(TEMPLATES.items()))
    grams = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
templates AS (
  SELECT ord, license, {grams.format("ws")} AS b
  FROM (SELECT ord, license, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS ws
        FROM (VALUES {quoted}) AS v(ord, license, body))),
lines AS (
  SELECT rid, unnest(range(len(ls))) AS unit, unnest(ls) AS line FROM (SELECT rid, string_split(t, chr(10)) AS ls FROM d)),
units AS (
  SELECT rid, unit, regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}]+') AS ws FROM lines
  UNION ALL
  SELECT rid, -1, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') FROM d WHERE contains(t, chr(10))),
sets AS (SELECT rid, unit, {grams.format("ws")} AS b FROM units WHERE len(ws) >= 2),
scored AS (
  SELECT rid, unit, ord, license, 2.0 * len(list_intersect(s.b, t.b)) / (len(s.b) + len(t.b)) AS dice
  FROM sets s JOIN templates t ON len(s.b) BETWEEN 0.8 / 1.2 * len(t.b) - 1e-9 AND 1.2 / 0.8 * len(t.b) + 1e-9),
best AS (
  SELECT * FROM scored WHERE dice >= 0.8
  QUALIFY row_number() OVER (PARTITION BY rid, unit ORDER BY dice DESC, ord) = 1)
SELECT doc_id, count(license)::BIGINT AS n_matches, arg_min(license, (-dice, unit)) AS license,
       round(max(dice)::DOUBLE, 6) AS dice, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses
FROM d LEFT JOIN best USING (rid) GROUP BY rid, doc_id
"""


ORACLES["op5_license_scan"] = _license_sql()

ORACLES["op9_benchmark_decontamination"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
items AS (
  SELECT item_id, ws, least(10, len(ws)) AS n
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM benchmark)
  WHERE len(ws) > 0),
patterns AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS g
  FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM items)),
places AS (
  SELECT rid, n, s, array_to_string(ws[s:s + n - 1], ' ') AS g
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM items) WHERE len(ws) >= n)),
found AS (SELECT rid, item_id, n, s FROM places JOIN patterns USING (n, g)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM found) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""

ORACLES["op10_near_duplicates"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), {_WORDS}) AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[s:s + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS s FROM d WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, y.doc_id) p
  JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b
  WHERE 100 * common >= 75 * (sa.n + sb.n - common)),
reach AS (
  SELECT a AS doc_id, a AS other FROM links
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
smallest AS (SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id,
       coalesce(component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN smallest USING (doc_id)
"""

ORACLES["op11_hard_negatives"] = """
WITH r AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid, a.vec_id AS anchor_id, x.vec_id, x.label = a.label AS same, list_inner_product(a.q, x.q)::BIGINT AS score
  FROM r a JOIN r x ON x.rid <> a.rid WHERE a.vec_id % 100 = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS k FROM s WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.rid, p.k ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.rid = s.rid AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""

ORACLES["op13_exact_duplicates"] = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {_UPPER})) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
