"""DuckDB oracles of the report / status queries."""

from storelens.oracle_sql import with_fx
from storelens.plans.oracles import ORACLES, wf_tasks_sql
from storelens.plans.oracles_catalog import CAT_CTES, CATALOG_ORACLES

NL = "chr(10)"
SUMMARY_SQL = """CASE event_type
  WHEN 'receiving' THEN 'Receiving needs ' || CAST(n_tasks AS VARCHAR) || ' verification step(s)'
  WHEN 'stock_movement' THEN 'Stock movement needs ' || CAST(n_tasks AS VARCHAR) || ' verification step(s)'
  WHEN 'damage' THEN 'Damage needs ' || CAST(n_tasks AS VARCHAR) || ' verification step(s)'
  WHEN 'expiry' THEN 'Expiry needs manager verification'
  WHEN 'attendance' THEN 'Attendance needs ' || CAST(n_tasks AS VARCHAR) || ' verification step(s)'
  WHEN 'sale' THEN 'Sale needs ' || CAST(n_tasks AS VARCHAR) || ' verification step(s)'
  WHEN 'purchase' THEN 'Purchase needs pack conversion'
  WHEN 'return' THEN 'Return awaits approval'
  WHEN 'stock_count' THEN 'Stock count needs ' || CAST(n_tasks AS VARCHAR) || ' verification step(s)'
  ELSE 'Unsupported event routed to manager' END"""

ORACLES["exception_report"] = with_fx(["fx_facts"], f"""
SELECT e.store_id, e.id AS event_id,
       '# Operational exception ' || e.id || {NL} || {NL} || {SUMMARY_SQL.replace('n_tasks', 't.n')} || {NL} || {NL}
       || '## Evidence references' || {NL} || {NL}
       || CASE WHEN e.evidence_id IS NULL THEN '- `evd_missing`'
               ELSE '- `' || e.evidence_id || '`' || {NL} || '- `' || e.evidence_id || '`' || {NL} || '- `evd_missing`' END
       || CASE WHEN e.n % 9 = 4 THEN {NL} || '- `evd_' || CAST(e.n + 1 AS VARCHAR) || '`' ELSE '' END
       || {NL} AS text
FROM fx_facts e JOIN (SELECT related_event_id, count(*) AS n FROM wf_tasks GROUP BY 1) t ON t.related_event_id = e.id""",
                                        [wf_tasks_sql("fx_facts")])

ORACLES["store_report_lines"] = "WITH " + CAT_CTES.strip() + """
SELECT store_id, 'mappings' AS section, field_pos AS line_no,
       '- `' || canonical_field || '` ← `' || source_path || '` (' || CASE WHEN verified THEN 'verified' ELSE 'proposed' END
       || ', confidence ' || printf('%.2f', CAST(confidence AS DOUBLE)) || ')' AS line
FROM mappings
UNION ALL
SELECT c.store_id, 'readiness', c.check_pos,
       '- [' || CASE WHEN c.missing IS NULL THEN 'x' ELSE ' ' END || '] ' || g.label || ' — '
       || CASE WHEN c.missing IS NULL THEN 'Verified' ELSE 'Awaiting: ' || c.missing END
FROM checks c JOIN (SELECT DISTINCT check_key, label FROM rgroups) g ON g.check_key = c.check_key"""

ORACLES["store_snapshot_lines"] = (
    "WITH snap AS (" + ORACLES["operational_snapshot"] + "), pstates AS (" + ORACLES["proof_state_counts"] + """)
SELECT store_id, 'snapshot' AS section, 0 AS line_no, '- state: ' || state AS line FROM snap
UNION ALL SELECT store_id, 'snapshot', 1, '- evidence: ' || evidence_counts FROM snap
UNION ALL SELECT store_id, 'snapshot', 2, '- events: ' || event_counts FROM snap
UNION ALL SELECT store_id, 'snapshot', 3, '- open work: ' || open_tasks_by_role FROM snap
UNION ALL SELECT store_id, 'snapshot', 4, '- corroborated: ' || CAST(corroborated_system_records AS VARCHAR) FROM snap
UNION ALL SELECT store_id, 'snapshot', 5, '- uncorroborated: ' || CAST(uncorroborated_system_records AS VARCHAR) FROM snap
UNION ALL SELECT store_id, 'snapshot', 6, '- unlinked observations: ' || CAST(unlinked_observations AS VARCHAR) FROM snap
UNION ALL SELECT store_id, 'snapshot', 7, '- last seen: ' || last_seen_by_source FROM snap
UNION ALL
SELECT store_id, 'proofs', CASE state WHEN 'disputed' THEN 0 WHEN 'awaiting_system_record' THEN 1 WHEN 'awaiting_camera_context' THEN 2
         WHEN 'awaiting_human_confirmation' THEN 3 WHEN 'evidence_complete' THEN 4 ELSE 9 END,
       '- ' || state || ': ' || CAST(count AS VARCHAR) FROM pstates""")

ORACLES["write_artifacts"] = ORACLES["operation_proofs"]

ORACLES["store_status"] = with_fx(["fx_task", "fx_all_evidence"], """
SELECT s.store_id, coalesce(q.n, 0) AS open_questions, coalesce(t.n, 0) AS open_tasks, coalesce(e.n, 0) AS events,
       coalesce(v.n, 0) AS evidence, coalesce(a.n, 0) AS actions
FROM (SELECT DISTINCT store_id FROM questions UNION SELECT store_id FROM fx_task UNION SELECT store_id FROM fx_op_event UNION SELECT store_id FROM fx_all_evidence
      UNION SELECT 'store_' || CAST(user_id % 4 AS VARCHAR) FROM events WHERE event_type = 'error') s
LEFT JOIN (SELECT store_id, count(*) AS n FROM fx_task WHERE status = 'open' GROUP BY 1) t ON t.store_id = s.store_id
LEFT JOIN (SELECT store_id, count(*) AS n FROM fx_op_event GROUP BY 1) e ON e.store_id = s.store_id
LEFT JOIN (SELECT store_id, count(*) AS n FROM fx_all_evidence GROUP BY 1) v ON v.store_id = s.store_id
LEFT JOIN (SELECT 'store_' || CAST(user_id % 4 AS VARCHAR) AS store_id, count(*) AS n FROM events
           WHERE event_type = 'error' GROUP BY 1) a ON a.store_id = s.store_id
LEFT JOIN (SELECT store_id, count(*) AS n FROM questions WHERE NOT resolved GROUP BY 1) q ON q.store_id = s.store_id""", [CAT_CTES.strip()])

ORACLES["attention_items"] = "SELECT store_id, attention FROM (" + ORACLES["operational_snapshot"] + ")"

_caps_body = CATALOG_ORACLES["capabilities"].split(CAT_CTES.strip(), 1)[1]
ORACLES["store_awareness"] = "WITH " + CAT_CTES.strip() + f""",
caps AS ({_caps_body})
SELECT c.store_id, 'structural_metadata_only' AS basis, false AS verified, c.sources, c.table_count, c.column_count,
       coalesce(r.n, 0) AS role_candidate_count, caps.capabilities, caps.unknowns,
       coalesce(d.n, 0) AS declared_relationships, coalesce(i.n, 0) AS inferred_relationships,
       CAST(substr(c.store_id, 5) AS BIGINT) % 4 AS camera_channel_count
FROM (SELECT store_id, count(DISTINCT table_path) AS table_count, count(*) AS column_count,
             string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM fx_cat GROUP BY 1) c
LEFT JOIN (SELECT store_id, count(*) AS n FROM role_cands GROUP BY 1) r ON r.store_id = c.store_id
LEFT JOIN (SELECT store_id, count(*) AS n FROM fx_fks GROUP BY 1) d ON d.store_id = c.store_id
LEFT JOIN (SELECT store_id, count(*) AS n FROM inferred GROUP BY 1) i ON i.store_id = c.store_id
LEFT JOIN caps ON caps.store_id = c.store_id"""

ORACLES["rank_collectors"] = """
WITH s AS (SELECT s_suppkey AS k, 'sup_' || CAST(s_suppkey AS VARCHAR) AS store_id FROM supplier),
r AS (SELECT store_id, 'a_device.json' AS root, k % 4 AS ch, k % 2 AS et FROM s
      UNION ALL SELECT store_id, 'b_config.json', k % 3, k % 5 FROM s),
f AS (SELECT store_id, root, ch AS camera_channels, et AS event_tables, ch * 10 + et * 5 AS score, ch > 0 AS eligible
      FROM r WHERE ch > 0 OR et > 0)
SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY eligible DESC, score DESC, root) = 1 AND eligible AS selected
FROM f"""
