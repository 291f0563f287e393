"""DuckDB oracles of the catalog operators (scoring, ranking, inference, readiness)."""

from __future__ import annotations

from storelens.plans.oracle_rules import CANONICAL_FIELDS, READINESS_GROUPS, ROLE_RULES
from storelens.sources.catalog_fixture import TEMPLATE_CONTRACTS, TEMPLATE_FKS, template_rows


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_s(x) for x in xs) + "]::VARCHAR[]"


def _list2(xss) -> str:
    return "[" + ", ".join(_list(x) for x in xss) + "]::VARCHAR[][]"


def _b(x: bool) -> str:
    return "true" if x else "false"


TPL_VALUES = ",\n".join(
    f"({t}, {_s(src)}, {_s(kind)}, {_s(tab)}, {_s(col)}, {_s(typ)}, {_b(pk)}, {tp}, {cp})"
    for t, src, kind, tab, col, typ, pk, tp, cp in template_rows()
)
CANON_VALUES = ",\n".join(
    f"({_s(n)}, {i}, {_list(tk)}, {_list(tt)}, {_list(wk)}, {_list2(gr)}, {_b(req)}, {_s(lab)})"
    for i, (n, tk, tt, wk, gr, req, lab) in enumerate(CANONICAL_FIELDS)
)
ROLE_VALUES = ",\n".join(
    f"({_s(r)}, {i}, {_list(t)}, {_list2(g)}, {_list(p)}, {_list(n)})" for i, (r, t, g, p, n) in enumerate(ROLE_RULES)
)
FK_VALUES = ",\n".join(f"({t}, {_s(s)}, {_s(a)}, {_s(b)}, {_s(c)}, {_s(d)})" for t, s, a, b, c, d in TEMPLATE_FKS)
CONTRACT_VALUES = ",\n".join(
    f"({t}, {_s(s)}, {_s(f)}, {_s(a)}, {_s(b)}, {_s(au)}, {i})" for i, (t, s, f, a, b, au) in enumerate(TEMPLATE_CONTRACTS)
)
READY_VALUES = ",\n".join(
    f"({_s(k)}, {i}, {_s(lab)}, {_s(f)}, {j})" for i, (k, lab, fs) in enumerate(READINESS_GROUPS) for j, f in enumerate(fs)
)

CAT_CTES = f"""
tpl(template, source, source_kind, "table", "column", type, primary_key, table_pos, column_pos) AS (VALUES {TPL_VALUES}),
fx_stores AS (
  SELECT 'cat_' || CAST(c_custkey AS VARCHAR) AS store_id, c_name AS name, CAST(c_custkey % 3 AS INTEGER) AS template,
         CASE WHEN c_custkey % 3 = 2 THEN true WHEN c_custkey % 3 = 1 THEN c_custkey % 2 = 0 ELSE false END AS requires_confirmation,
         'sql' || CAST(c_custkey % 7 AS VARCHAR) AS server, c_custkey
  FROM customer),
ocount AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
fx_cat AS (
  SELECT s.store_id, t.source, s.source_pos, t.source_kind, t."table", t.table_pos, t."column", t.column_pos, t.type,
         t.primary_key, CAST(coalesce(oc.n, 0) * (t.table_pos + 1) AS BIGINT) AS row_count,
         t.source || '.' || t."table" AS table_path, t.source || '.' || t."table" || '.' || t."column" AS path,
         regexp_replace(lower(t."column"), '[^a-z0-9]', '', 'g') AS normalized,
         regexp_replace(lower(t."table"), '[^a-z0-9]', '', 'g') AS normalized_table
  FROM (SELECT store_id, c_custkey, template, CASE WHEN template = 2 AND c_custkey % 4 = 0 THEN 1 ELSE 0 END AS source_pos FROM fx_stores
        UNION ALL SELECT store_id, c_custkey, 1, 0 FROM fx_stores WHERE template = 2 AND c_custkey % 4 = 0) s
  JOIN tpl t ON t.template = s.template LEFT JOIN ocount oc ON oc.o_custkey = s.c_custkey),
sqlsrc AS (SELECT store_id, arg_min(source, source_pos) AS source FROM fx_cat WHERE source_kind = 'sqlserver' GROUP BY 1),
sqlcat AS (SELECT c.* FROM fx_cat c JOIN sqlsrc s ON s.store_id = c.store_id AND s.source = c.source),
canon(canonical_field, field_pos, tokens, table_tokens, weak_tokens, column_groups, required, label) AS (VALUES {CANON_VALUES}),
fx_contracts AS (
  SELECT s.store_id, c.source, c.canonical_field, c."table", c."column", c.authority, c.contract_pos
  FROM fx_stores s JOIN (VALUES {CONTRACT_VALUES}) c(template, source, canonical_field, "table", "column", authority, contract_pos)
    ON c.template = s.template WHERE s.c_custkey % 2 = 0),
fx_fks AS (
  SELECT s.store_id, f.source, f.from_table, f.from_column, f.to_table, f.to_column
  FROM fx_stores s JOIN (VALUES {FK_VALUES}) f(template, source, from_table, from_column, to_table, to_column)
    ON f.template = s.template),
flags AS (
  SELECT c.store_id, r.canonical_field, r.field_pos, c.path, c.source_pos, c.table_pos, c.column_pos, r.required, r.label,
         c.normalized AS nm, c.normalized_table AS nt,
         len(list_filter(r.table_tokens, lambda t: length(t) >= 3 AND contains(c.normalized_table, t))) > 0 AS table_match,
         list_contains(r.tokens, c.normalized) AS exact_hit,
         list_contains(r.weak_tokens, c.normalized) AS weak_exact,
         len(list_filter(r.tokens, lambda t: length(t) >= 3 AND contains(c.normalized, t))) > 0 AS contained,
         len(list_filter(r.weak_tokens, lambda t: contains(c.normalized, t))) > 0 AS weak_contained,
         len(r.column_groups) > 0 AND len(list_filter(r.column_groups,
             lambda g: len(list_filter(g, lambda t: contains(c.normalized, t))) = 0)) = 0 AS grouped
  FROM fx_cat c CROSS JOIN canon r),
scored0 AS (
  SELECT *, CASE WHEN exact_hit THEN (CASE WHEN weak_exact THEN 0.62 ELSE 0.78 END)
                 WHEN contained THEN (CASE WHEN weak_contained THEN 0.58 ELSE 0.66 END)
                 WHEN grouped THEN 0.76 END::DECIMAL(6,4) AS col_score
  FROM flags),
scores AS (
  SELECT store_id, canonical_field, field_pos, path, source_pos, table_pos, column_pos, required, label,
    CASE WHEN col_score IS NULL OR (nm IN ('id','name','role','unit','qty','quantity') AND NOT table_match) THEN 0.0::DECIMAL(6,4)
         ELSE least(greatest(col_score
              + CASE WHEN table_match THEN 0.20 ELSE 0 END
              + CASE WHEN canonical_field = 'movement.destination' AND (suffix(nm, 'to') OR suffix(nm, 'dest') OR suffix(nm, 'destination')) THEN 0.16 ELSE 0 END
              - CASE WHEN canonical_field = 'movement.destination' AND (suffix(nm, 'from') OR suffix(nm, 'form') OR suffix(nm, 'source')) THEN 0.30 ELSE 0 END
              - CASE WHEN prefix(nt, 'sys') OR contains(nt, 'report') OR contains(nt, 'rpt') OR contains(nt, 'temp')
                          OR contains(nt, 'config') OR contains(nt, 'setting') OR contains(nt, 'form') THEN 0.28 ELSE 0 END,
              0.0), 0.98)::DECIMAL(6,4) END AS score
  FROM scored0),
cands AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, canonical_field
                                              ORDER BY score DESC, source_pos, table_pos, column_pos) AS rank
                 FROM scores WHERE score > 0) WHERE rank <= 5),
proposals0 AS (
  SELECT c.store_id, c.canonical_field, c.field_pos, c.path AS best_path, c.score AS best_score,
         s.requires_confirmation
  FROM cands c LEFT JOIN fx_stores s ON s.store_id = c.store_id WHERE c.rank = 1),
proposals AS (
  SELECT store_id, canonical_field, field_pos, best_path AS source_path,
         CAST(round(CASE WHEN best_score < 0.80 THEN greatest(best_score, 0.65) ELSE best_score END, 2) AS DECIMAL(4,2)) AS confidence,
         CASE WHEN best_score < 0.80 THEN 'Highest lexical and sample-type match; human verification required.'
              ELSE 'Matched normalized column name and canonical vocabulary.' END AS reasoning,
         (CASE WHEN best_score < 0.80 THEN greatest(best_score, 0.65) ELSE best_score END) >= 0.95
           AND NOT coalesce(requires_confirmation, false) AS verified
  FROM proposals0),
contract_last AS (
  SELECT store_id, canonical_field, arg_max(source || '.' || "table" || '.' || "column", contract_pos) AS cpath
  FROM fx_contracts WHERE authority = 'authorized_connector_contract' GROUP BY 1, 2),
mappings AS (
  SELECT p.store_id, p.canonical_field, p.field_pos, p.source_path,
         CASE WHEN c.cpath = p.source_path THEN 1.00::DECIMAL(4,2) ELSE p.confidence END AS confidence,
         CASE WHEN c.cpath = p.source_path THEN 'Verified by an authorized connector semantic contract, not lexical inference.'
              ELSE p.reasoning END AS reasoning,
         CASE WHEN c.cpath = p.source_path THEN true ELSE p.verified END AS verified
  FROM proposals p LEFT JOIN contract_last c ON c.store_id = p.store_id AND c.canonical_field = p.canonical_field),
cand_lists AS (
  SELECT store_id, canonical_field, list(path ORDER BY rank) AS candidates FROM cands GROUP BY 1, 2),
questions AS (
  SELECT g.store_id,
         CASE WHEN m.source_path IS NULL THEN 'map:' ELSE 'verify:' END || g.canonical_field AS key,
         g.field_pos,
         CASE WHEN m.source_path IS NULL THEN 'Which source field represents ' || lower(g.label) || '?'
              ELSE 'Does `' || m.source_path || '` represent ' || lower(g.label) || '?' END AS prompt,
         CASE WHEN m.source_path IS NULL THEN 'The engine could not infer this required meaning safely.'
              ELSE 'Proposed at confidence ' || printf('%.2f', CAST(m.confidence AS DOUBLE)) || '; important meanings require confirmation.' END AS reason,
         CASE WHEN m.source_path IS NULL THEN []::VARCHAR[]
              ELSE list_filter(list_concat(coalesce(cl.candidates, []::VARCHAR[]), [m.source_path, 'none_of_these']), lambda x, i: list_position(list_concat(coalesce(cl.candidates, []::VARCHAR[]), [m.source_path, 'none_of_these']), x) = i) END AS options,
         false AS resolved
  FROM (SELECT s.store_id, c.canonical_field, c.field_pos, c.label FROM fx_stores s CROSS JOIN canon c WHERE c.required) g
  LEFT JOIN mappings m ON m.store_id = g.store_id AND m.canonical_field = g.canonical_field
  LEFT JOIN cand_lists cl ON cl.store_id = g.store_id AND cl.canonical_field = g.canonical_field
  WHERE m.source_path IS NULL OR NOT m.verified),
rgroups(check_key, check_pos, label, canonical_field, field_order) AS (VALUES {READY_VALUES}),
checks AS (
  SELECT g.store_id, g.check_key, g.check_pos,
         string_agg(CASE WHEN NOT coalesce(m.verified, false) THEN g.canonical_field END, ', ' ORDER BY g.field_order) AS missing
  FROM (SELECT s.store_id, r.* FROM fx_stores s CROSS JOIN rgroups r) g
  LEFT JOIN mappings m ON m.store_id = g.store_id AND m.canonical_field = g.canonical_field
  GROUP BY 1, 2, 3),
readiness AS (
  SELECT c.store_id,
         sum(CASE WHEN c.missing IS NULL THEN 1 ELSE 0 END) = 5 AND coalesce(q.n, 0) = 0 AS ready,
         CAST(coalesce(q.n, 0) AS BIGINT) AS unresolved_questions,
         CAST(sum(CASE WHEN c.missing IS NULL THEN 1 ELSE 0 END) AS INTEGER) AS checks_passed,
         string_agg(c.check_key || ':' || CASE WHEN c.missing IS NULL THEN 'Verified' ELSE 'Awaiting: ' || c.missing END,
                    ' | ' ORDER BY c.check_pos) AS detail
  FROM checks c LEFT JOIN (SELECT store_id, count(*) AS n FROM questions WHERE NOT resolved GROUP BY 1) q
    ON q.store_id = c.store_id
  GROUP BY c.store_id, q.n),
roles(role, role_pos, table_tokens, groups, positive, negative) AS (VALUES {ROLE_VALUES}),
tprof AS (
  SELECT store_id, source, source_pos, "table", table_pos, table_path, normalized_table,
         list_distinct(list(normalized)) AS cols, max(row_count) AS row_count
  FROM fx_cat GROUP BY 1, 2, 3, 4, 5, 6, 7),
rflags AS (
  SELECT t.store_id, r.role, r.role_pos, t.table_path AS source_path, t.source_pos, t.table_pos, t.row_count,
         len(list_filter(r.table_tokens, lambda x: contains(t.normalized_table, x))) > 0 AS tmatch,
         len(list_filter(r.groups, lambda g: len(list_filter(t.cols, lambda c: len(list_filter(g, lambda x: contains(c, x))) > 0)) > 0)) AS matched,
         len(r.groups) AS ngroups,
         len(list_filter(r.positive, lambda x: contains(t.normalized_table, x))) > 0 AS pos,
         len(list_filter(r.negative, lambda x: contains(t.normalized_table, x))) > 0 AS neg,
         prefix(t.normalized_table, 'sys') OR contains(t.normalized_table, 'report') OR contains(t.normalized_table, 'rpt')
           OR contains(t.normalized_table, 'temp') OR contains(t.normalized_table, 'config')
           OR contains(t.normalized_table, 'setting') OR contains(t.normalized_table, 'form') AS rep
  FROM tprof t CROSS JOIN roles r),
role_scores AS (
  SELECT store_id, role, role_pos, source_path, source_pos, table_pos, row_count,
         CAST(round(least(greatest(
              (CASE WHEN tmatch THEN 0.38 ELSE 0 END)::DECIMAL(18,8)
              + (CASE WHEN ngroups > 0 THEN 0.44::DECIMAL(18,8) * matched / ngroups ELSE 0 END)::DECIMAL(18,8)
              + (CASE WHEN pos THEN 0.14 ELSE 0 END) - (CASE WHEN neg THEN 0.22 ELSE 0 END)
              - (CASE WHEN rep THEN 0.28 ELSE 0 END), 0), 0.96), 2) AS DECIMAL(4,2)) AS confidence,
         concat_ws(' | ',
           CASE WHEN tmatch THEN 'table name matches the operational vocabulary' END,
           CASE WHEN matched > 0 THEN CAST(matched AS VARCHAR) || '/' || CAST(ngroups AS VARCHAR) || ' expected column signatures matched' END,
           CASE WHEN pos THEN 'table shape modifier supports this role' END,
           CASE WHEN neg THEN 'table shape modifier conflicts with this role' END,
           CASE WHEN rep THEN 'report/configuration shape reduces operational confidence' END) AS evidence
  FROM rflags),
role_cands AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, role
                     ORDER BY confidence DESC, coalesce(row_count, 0) DESC, source_pos, table_pos) AS rank
                 FROM role_scores WHERE confidence >= 0.50) WHERE rank <= 5),
idcols AS (
  SELECT store_id, table_path, normalized, arg_max("column", column_pos) AS "column", arg_max(primary_key, column_pos) AS pk
  FROM fx_cat WHERE length(normalized) >= 5 AND (suffix(normalized, 'id') OR suffix(normalized, 'code'))
    AND (store_id, table_path) IN (SELECT store_id, source_path FROM role_cands WHERE rank <= 2)
  GROUP BY 1, 2, 3),
inferred AS (
  SELECT store_id, 'inferred_shared_identifier' AS kind, from_table, from_column, to_table, to_column,
         CASE WHEN k THEN 0.82 ELSE 0.64 END::DOUBLE AS confidence, false AS verified, pair_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY from_table, to_table) AS pair_rank
        FROM (SELECT l.store_id, l.table_path AS from_table, l."column" AS from_column, r.table_path AS to_table,
                     r."column" AS to_column, coalesce(l.pk, false) OR coalesce(r.pk, false) AS k,
                     row_number() OVER (PARTITION BY l.store_id, l.table_path, r.table_path
                                        ORDER BY coalesce(l.pk, false) OR coalesce(r.pk, false) DESC, l.normalized) AS rn
              FROM idcols l JOIN idcols r ON l.store_id = r.store_id AND l.normalized = r.normalized
               AND l.table_path < r.table_path) WHERE rn = 1))"""


CATALOG_ORACLES: dict[str, str] = {}


def _q(body: str) -> str:
    return "WITH " + CAT_CTES.strip() + "\n" + body


CATALOG_ORACLES["score_mappings"] = _q(
    "SELECT store_id, canonical_field, path, CAST(score AS DOUBLE) AS score FROM scores")
CATALOG_ORACLES["mapping_candidates"] = _q(
    "SELECT store_id, canonical_field, CAST(rank AS INTEGER) AS rank, path, CAST(score AS DOUBLE) AS score FROM cands")
CATALOG_ORACLES["propose_mappings"] = _q("""
SELECT store_id, canonical_field, source_path, CAST(confidence AS DOUBLE) AS confidence, reasoning, verified FROM proposals""")
CATALOG_ORACLES["apply_contracts"] = _q("""
SELECT store_id, canonical_field, source_path, CAST(confidence AS DOUBLE) AS confidence, reasoning, verified FROM mappings""")
CATALOG_ORACLES["setup_questions"] = _q("""
SELECT store_id, key, prompt, reason, array_to_string(options, '|') AS options, resolved FROM questions""")
CATALOG_ORACLES["readiness"] = _q("SELECT * FROM readiness")
CATALOG_ORACLES["score_table_roles"] = _q("""
SELECT store_id, role, source_path, CAST(confidence AS DOUBLE) AS confidence, evidence, row_count
FROM role_scores WHERE confidence >= 0.50""")
CATALOG_ORACLES["role_candidates"] = _q("""
SELECT store_id, role, CAST(rank AS INTEGER) AS rank, source_path, CAST(confidence AS DOUBLE) AS confidence, row_count
FROM role_cands""")
CATALOG_ORACLES["infer_relationships"] = _q("""
SELECT store_id, kind, from_table, from_column, to_table, to_column, confidence, verified, CAST(pair_rank AS INTEGER) AS pair_rank
FROM inferred""")
CATALOG_ORACLES["all_relationships"] = _q("""
SELECT store_id, 'declared_foreign_key' AS kind, source || '.' || from_table AS from_table, from_column,
       source || '.' || to_table AS to_table, to_column, 1.0::DOUBLE AS confidence, false AS verified FROM fx_fks
UNION ALL
SELECT store_id, kind, from_table, from_column, to_table, to_column, confidence, verified FROM inferred""")
CATALOG_ORACLES["capabilities"] = _q("""
SELECT s.store_id, coalesce(c.caps, '') AS capabilities,
       array_to_string(list_filter(['product_catalog','purchase_header','purchase_line','sale_header','sale_line',
                                    'inventory_stock','camera_registry','camera_events','staff_directory'],
                                   lambda r: NOT list_contains(coalesce(c.capl, []::VARCHAR[]), r)), ',') AS unknowns
FROM fx_stores s LEFT JOIN (
  SELECT store_id, string_agg(role, ',' ORDER BY role) AS caps, list(role) AS capl FROM (
    SELECT store_id, role FROM role_cands WHERE rank = 1
      AND confidence >= CASE WHEN role IN ('staff_directory', 'attendance') THEN 0.80 ELSE 0.60 END
    UNION
    SELECT store_id, 'staff_directory' FROM fx_contracts
    WHERE canonical_field = 'staff.role' AND authority = 'authorized_connector_contract') GROUP BY store_id) c
  ON c.store_id = s.store_id""")
CATALOG_ORACLES["schema_totals"] = _q("""
SELECT t.store_id, t.table_count, t.column_count, t.source_count, coalesce(r.n, 0) AS relationship_count,
       CAST(substr(t.store_id, 5) AS BIGINT) % 4 AS camera_channel_count
FROM (SELECT store_id, count(DISTINCT table_path) AS table_count, count(*) AS column_count,
             count(DISTINCT source) AS source_count FROM fx_cat GROUP BY 1) t
LEFT JOIN (SELECT store_id, count(*) AS n FROM (SELECT store_id FROM fx_fks UNION ALL SELECT store_id FROM inferred)
           GROUP BY 1) r ON r.store_id = t.store_id""")
CATALOG_ORACLES["rank_databases"] = _q("""
SELECT server, database, CAST(score AS DOUBLE) AS score, eligible, table_count, column_count, operational_roles,
       (row_number() OVER (PARTITION BY server ORDER BY eligible DESC, score DESC, database) = 1) AND eligible AS selected
FROM (
  SELECT t.server, t.store_id AS database,
         CAST(round(coalesce(s.strength, 0) * 10 + coalesce(s.n, 0) * 5 + least(t.table_count, 500)::DECIMAL(12,4) / 100
                    + least(t.column_count, 20000)::DECIMAL(12,4) / 10000, 3) AS DECIMAL(12,3)) AS score,
         coalesce(s.n, 0) > 0 AS eligible, t.table_count, t.column_count, coalesce(s.roles, '') AS operational_roles
  FROM (SELECT c.store_id, st.server, count(DISTINCT c.table_path) AS table_count, count(*) AS column_count
        FROM fx_cat c JOIN fx_stores st ON st.store_id = c.store_id GROUP BY 1, 2) t
  LEFT JOIN (SELECT store_id, sum(confidence) AS strength, count(*) AS n, string_agg(role, ',' ORDER BY role) AS roles
             FROM role_cands WHERE rank = 1 AND confidence >= 0.60
               AND role IN ('product_catalog','purchase_header','purchase_line','sale_header','sale_line',
                            'inventory_stock','stock_movement')
             GROUP BY 1) s ON s.store_id = t.store_id)""")
CATALOG_ORACLES["mapping_targets"] = _q("""
SELECT m.store_id, m.canonical_field, m.source_path, c.table_path, c."column", c.type
FROM mappings m JOIN sqlcat c ON c.store_id = m.store_id AND c.path = m.source_path WHERE NOT m.verified""")


def _sig_values() -> str:
    rows = []
    for op in ("purchase", "sale"):
        sig = {
            "date": ((f"{op}date", "transactiondate", "businessdate", "date"), ("date", "createdat", "occurredat")),
            "time": ((f"{op}time", "transactiontime", "time"), ("time",)),
            "quantity": (("qty", "quantity", "soldqty", "receivedqty"), ("quantity",)),
            "line_id": ((f"{op}dtlid", "lineid", "detailid"), ("dtlid", "lineid")),
            "destination": (("destinationid", "locationid", "godownid", "gowdownid", "warehouseid", "shelfid"),
                            ("destination", "location", "godown", "gowdown", "warehouse", "shelf")),
        }
        for name, (ex, co) in sig.items():
            rows.append(f"({_s(op)}, {_s(name)}, {_list(ex)}, {_list(co)})")
    return ",\n".join(rows)


CATALOG_ORACLES["resolve_fact_plan"] = _q(f""",
ops AS (SELECT store_id, op FROM fx_stores CROSS JOIN (VALUES ('purchase'), ('sale')) o(op)),
rp AS (SELECT r.store_id, r.role, arg_min(r.source_path, r.rank) AS path, arg_min(CAST(r.confidence AS DOUBLE), r.rank) AS conf
       FROM (SELECT *, row_number() OVER (PARTITION BY store_id, role
                     ORDER BY confidence DESC, coalesce(row_count, 0) DESC, source_pos, table_pos) AS rank
             FROM role_scores WHERE confidence >= 0.50) r
       JOIN (SELECT DISTINCT store_id, table_path FROM sqlcat) t ON t.store_id = r.store_id AND t.table_path = r.source_path
       WHERE r.confidence >= 0.80 AND coalesce(r.row_count, 0) > 0 GROUP BY 1, 2),
base AS (
  SELECT o.store_id, o.op, h.path AS header_table, h.conf AS header_confidence, l.path AS line_table,
         l.conf AS line_confidence, p.path AS product_table, p.conf AS product_confidence
  FROM ops o LEFT JOIN rp h ON h.store_id = o.store_id AND h.role = o.op || '_header'
             LEFT JOIN rp l ON l.store_id = o.store_id AND l.role = o.op || '_line'
             LEFT JOIN rp p ON p.store_id = o.store_id AND p.role = 'product_catalog'),
sig(op, name, exact, cont) AS (VALUES {_sig_values()}),
sigcols AS (
  SELECT * FROM (
    SELECT c.store_id, c.table_path, s.op, s.name, c."column",
           row_number() OVER (PARTITION BY c.store_id, c.table_path, s.op, s.name
             ORDER BY CASE WHEN list_position(s.exact, c.normalized) IS NOT NULL THEN 0 ELSE 1 END,
                      coalesce(list_position(s.exact, c.normalized), 0), c.column_pos) AS rn
    FROM sqlcat c CROSS JOIN sig s
    WHERE list_position(s.exact, c.normalized) IS NOT NULL
       OR len(list_filter(s.cont, lambda t: contains(c.normalized, t))) > 0) WHERE rn = 1),
rels AS (
  SELECT store_id, source || '.' || from_table AS from_table, from_column, source || '.' || to_table AS to_table,
         to_column, 1.0::DOUBLE AS confidence FROM fx_fks
  UNION ALL SELECT store_id, from_table, from_column, to_table, to_column, confidence FROM inferred),
rr AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY confidence DESC, from_table, from_column, to_table,
                                    to_column) AS rk FROM rels WHERE confidence >= 0.80),
dir AS (SELECT store_id, from_table AS a, to_table AS b, from_column AS a_col, to_column AS b_col, confidence, rk FROM rr
        UNION ALL SELECT store_id, to_table, from_table, to_column, from_column, confidence, rk FROM rr),
hj AS (SELECT b.store_id, b.op, arg_min(d.a_col, d.rk) AS l_col, arg_min(d.b_col, d.rk) AS r_col,
              arg_min(d.confidence, d.rk) AS conf
       FROM base b JOIN dir d ON d.store_id = b.store_id AND d.a = b.header_table AND d.b = b.line_table GROUP BY 1, 2),
pj AS (SELECT b.store_id, b.op, arg_min(d.a_col, d.rk) AS l_col, arg_min(d.b_col, d.rk) AS r_col,
              arg_min(d.confidence, d.rk) AS conf
       FROM base b JOIN dir d ON d.store_id = b.store_id AND d.a = b.line_table AND d.b = b.product_table GROUP BY 1, 2),
mapcols AS (SELECT m.store_id, m.canonical_field, c.table_path, c."column", CAST(m.confidence AS DOUBLE) AS conf, m.verified
            FROM mappings m JOIN sqlcat c ON c.store_id = m.store_id AND c.path = m.source_path),
linepk AS (SELECT store_id, table_path, arg_min("column", column_pos) AS pk FROM sqlcat WHERE primary_key GROUP BY 1, 2),
plan AS (
  SELECT b.*, hj.l_col AS header_id_col, hj.r_col AS line_header_col, hj.conf AS hj_conf,
         pj.l_col AS line_product_col, pj.r_col AS product_key_col, pj.conf AS pj_conf,
         sd."column" AS date_col, st."column" AS time_col,
         coalesce(qm."column", sq."column") AS quantity_col, qm."column" AS qmap_col, qm.conf AS q_conf, qm.verified AS q_ver,
         im."column" AS product_identity_col, im.conf AS i_conf, im.verified AS i_ver,
         pm."column" AS pack_size_col, pm.verified AS p_ver,
         coalesce(lp.pk, sl."column") AS line_id_col, sdest."column" AS destination_col
  FROM base b
  LEFT JOIN hj ON hj.store_id = b.store_id AND hj.op = b.op
  LEFT JOIN pj ON pj.store_id = b.store_id AND pj.op = b.op
  LEFT JOIN sigcols sd ON sd.store_id = b.store_id AND sd.table_path = b.header_table AND sd.op = b.op AND sd.name = 'date'
  LEFT JOIN sigcols st ON st.store_id = b.store_id AND st.table_path = b.header_table AND st.op = b.op AND st.name = 'time'
  LEFT JOIN sigcols sq ON sq.store_id = b.store_id AND sq.table_path = b.line_table AND sq.op = b.op AND sq.name = 'quantity'
  LEFT JOIN sigcols sl ON sl.store_id = b.store_id AND sl.table_path = b.line_table AND sl.op = b.op AND sl.name = 'line_id'
  LEFT JOIN sigcols sdest ON sdest.store_id = b.store_id AND sdest.table_path = b.line_table AND sdest.op = b.op
                         AND sdest.name = 'destination'
  LEFT JOIN mapcols qm ON qm.store_id = b.store_id AND qm.table_path = b.line_table AND qm.canonical_field = b.op || '.quantity'
  LEFT JOIN mapcols im ON im.store_id = b.store_id AND im.table_path = b.product_table AND im.canonical_field = 'product.identity'
  LEFT JOIN mapcols pm ON pm.store_id = b.store_id AND pm.table_path = b.product_table AND pm.canonical_field = 'product.pack_size'
  LEFT JOIN linepk lp ON lp.store_id = b.store_id AND lp.table_path = b.line_table),
reasoned AS (
  SELECT p.*, CASE WHEN s.source IS NULL THEN 'the store has no SQL source'
                 WHEN header_table IS NULL OR line_table IS NULL OR product_table IS NULL
                   THEN 'no header, line and product tables are known well enough'
                 WHEN header_id_col IS NULL OR line_product_col IS NULL THEN 'no join of the plan''s tables is known well enough'
                 WHEN date_col IS NULL OR quantity_col IS NULL OR product_identity_col IS NULL OR line_id_col IS NULL
                   THEN 'a date, quantity, product identity or line identity column is missing' END AS reason
  FROM plan p LEFT JOIN sqlsrc s ON s.store_id = p.store_id)
SELECT store_id, op AS operation, reason IS NULL AS plan_ok, reason, header_table, line_table, product_table,
       header_id_col, line_header_col, line_product_col, product_key_col, date_col, time_col, quantity_col,
       product_identity_col, pack_size_col, line_id_col, destination_col,
       CASE WHEN reason IS NULL THEN least(header_confidence, line_confidence, product_confidence, hj_conf, pj_conf,
                                           i_conf, coalesce(q_conf, 0.78)) END AS structural_confidence,
       CASE WHEN reason IS NULL THEN coalesce(i_ver, false) AND qmap_col IS NOT NULL AND coalesce(q_ver, false)
                                     AND (pack_size_col IS NULL OR coalesce(p_ver, false)) END AS mapping_verified
FROM reasoned""")

CATALOG_ORACLES["carry_forward_mappings"] = _q(""",
prev AS (SELECT store_id, canonical_field, source_path FROM mappings
         WHERE verified OR CAST(substr(store_id, 5) AS BIGINT) % 5 = 0),
cat2 AS (SELECT store_id, path FROM fx_cat WHERE NOT ("column" = 'GodownNo' AND CAST(substr(store_id, 5) AS BIGINT) % 10 = 0)),
kept AS (SELECT p.* FROM prev p WHERE EXISTS (SELECT 1 FROM cat2 c WHERE c.store_id = p.store_id AND c.path = p.source_path)),
cur AS (SELECT * FROM mappings m WHERE NOT (m.canonical_field = 'movement.destination' AND m.source_path LIKE '%.GodownNo'
                                         AND CAST(substr(m.store_id, 5) AS BIGINT) % 10 = 0))
SELECT coalesce(c.store_id, k.store_id) AS store_id, coalesce(c.canonical_field, k.canonical_field) AS canonical_field,
       coalesce(k.source_path, c.source_path) AS source_path,
       CASE WHEN k.source_path IS NOT NULL THEN 1.0 ELSE CAST(c.confidence AS DOUBLE) END AS confidence,
       CASE WHEN k.source_path IS NOT NULL THEN 'Previously confirmed mapping remains present after schema rescan.'
            ELSE c.reasoning END AS reasoning,
       CASE WHEN k.source_path IS NOT NULL THEN true ELSE c.verified END AS verified
FROM cur c FULL OUTER JOIN kept k ON k.store_id = c.store_id AND k.canonical_field = c.canonical_field""")

CATALOG_ORACLES["structural_confidence"] = (
    "SELECT store_id, operation, structural_confidence, mapping_verified FROM ("
    + CATALOG_ORACLES["resolve_fact_plan"] + ") WHERE plan_ok")

CATALOG_ORACLES["learned_line_facts"] = (
    CATALOG_ORACLES["resolve_fact_plan"].rsplit("SELECT store_id, op AS operation, reason IS NULL AS plan_ok", 1)[0].rstrip() + """,
plans AS (
  SELECT store_id, op, header_table, line_table, product_identity_col, pack_size_col, destination_col,
         least(header_confidence, line_confidence, product_confidence, hj_conf, pj_conf, i_conf, coalesce(q_conf, 0.78)) AS conf,
         coalesce(i_ver, false) AND qmap_col IS NOT NULL AND coalesce(q_ver, false)
           AND (pack_size_col IS NULL OR coalesce(p_ver, false)) AS mapping_verified
  FROM reasoned WHERE reason IS NULL),
rows AS (
  SELECT p.*, o.o_orderdate, l.l_quantity, l.l_suppkey, pt.p_partkey, pt.p_size,
         substr(sha256(p.op || '|' || CAST(l.l_orderkey - o.o_custkey AS VARCHAR) || '|' || CAST(l.l_linenumber AS VARCHAR)), 1, 20) AS hash20
  FROM plans p JOIN orders o ON p.store_id = 'cat_' || CAST(o.o_custkey AS VARCHAR)
  JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linestatus = CASE p.op WHEN 'purchase' THEN 'O' ELSE 'F' END
  JOIN part pt ON pt.p_partkey = l.l_partkey)
SELECT store_id, op || '_line' AS operation_type, 'sql-operation:' || op || ':' || hash20 AS external_id,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS occurred_at, 'system_record' AS kind, round(conf, 2) AS confidence,
       CASE product_identity_col WHEN 'ProductId' THEN CAST(p_partkey AS VARCHAR) WHEN 'SKU' THEN 'P' || CAST(p_partkey AS VARCHAR) END
         AS product_id,
       CAST(l_quantity AS DOUBLE) AS quantity,
       CASE WHEN pack_size_col = 'UnitsPerCase' AND p_size % 10 <> 0 AND p_size > 0 THEN CAST(p_size AS DOUBLE) END AS pack_size,
       CASE WHEN destination_col = 'DestinationId' THEN CAST(l_suppkey AS VARCHAR) END AS destination_id,
       hash20 AS source_record_hash, mapping_verified
FROM rows""")
