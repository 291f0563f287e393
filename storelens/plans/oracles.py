"""DuckDB oracle SQL per registered query key."""

from __future__ import annotations

from storelens.oracle_sql import with_fx

ORACLES: dict[str, str] = {}


_LINE_FACT_COLS = """store_id, operation_type, external_id, occurred_at, kind, confidence, product_id,
       quantity, pack_size, destination_id, source_record_hash, mapping_verified"""

ORACLES["extract_line_facts"] = with_fx(["fx_line_facts"], f"SELECT {_LINE_FACT_COLS} FROM fx_line_facts")

ORACLES["extract_line_facts_recent"] = with_fx(["fx_line_facts"], f"""
SELECT {_LINE_FACT_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY store_id, op ORDER BY o_orderdate DESC, o_orderkey,
         l_linenumber, l_partkey, destination_id, l_quantity, l_suppkey, l_extendedprice) AS rn
  FROM fx_line_facts) WHERE rn <= 5""")

# Brute-force nearest observation per system record (ties: diff, time, id).
NEAREST_OBS_CTE = """
nearest_obs AS (
  SELECT * FROM (
    SELECT s.store_id, s.id AS system_record_id, o.id AS observation_id,
           abs(s.occurred_us - o.occurred_us) AS time_difference_us,
           row_number() OVER (PARTITION BY s.id ORDER BY abs(s.occurred_us - o.occurred_us), o.occurred_us, o.id) AS rn
    FROM fx_evidence s JOIN fx_evidence o
      ON s.store_id = o.store_id AND o.kind = 'observation' AND s.kind = 'system_record'
     AND o.occurred_us BETWEEN s.occurred_us - 900000000 AND s.occurred_us + 900000000
    WHERE s.occurred_us IS NOT NULL) WHERE rn = 1)"""

ORACLES["nearest_observation"] = with_fx(["fx_evidence"], """
SELECT store_id, system_record_id, observation_id, time_difference_us,
       time_difference_us / 1000000.0::DOUBLE AS time_difference_seconds,
       'temporal_cooccurrence_only' AS claim, false AS verified
FROM nearest_obs""", [NEAREST_OBS_CTE])


def _fs(x: str) -> str:
    return f"({x} IS NULL OR {x} = '')"


def _fn(x: str) -> str:
    return f"({x} IS NULL OR {x} = 0)"


def _fb(x: str) -> str:
    return f"({x} IS NULL OR NOT {x})"


def _num(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# (event_type, condition, role expr, question expr, reason, official)
WF_RULES_SQL = [
    ("receiving", "mapping_verified IS NOT DISTINCT FROM false", "'manager'",
     _q("Confirm the discovered product and quantity mapping for this source."),
     "The transaction is real, but its newly discovered schema meaning is not yet human-confirmed.", False),
    ("receiving", _fs("product_id"), "'data_entry_operator'", _q("Which SKU was received?"),
     "Receiving evidence has no verified product identity.", False),
    ("receiving", f"cartons IS NOT NULL AND {_fn('pack_size')}", "'data_entry_operator'",
     _q("What is the verified pieces-per-carton pack size?"), "Cartons cannot become base units without pack size.", False),
    ("receiving", _fs("destination_id"), "'data_entry_operator'", _q("Which godown or shelf received this product?"),
     "Purchase entry has no physical destination.", False),
    ("receiving", _fb("receiver_confirmed"), "CASE WHEN destination_type = 'shelf' THEN 'shelfer' ELSE 'godown_staff' END",
     _q("Confirm the quantity actually received at your location."), "DEO entry is not yet corroborated by the receiver.", True),
    ("stock_movement", f"{_fs('from_location')} OR {_fs('to_location')}", "'godown_staff'",
     _q("Confirm both source and destination locations."), "Movement route is incomplete.", False),
    ("stock_movement", "sent_quantity IS NULL", "'godown_staff'", _q("How many base units left the source location?"),
     "Movement has no sender quantity.", False),
    ("stock_movement", "received_quantity IS NULL", "'shelfer'", _q("How many base units arrived at the shelf?"),
     "Movement has no receiver confirmation.", True),
    ("stock_movement", "received_quantity IS NOT NULL AND sent_quantity IS NOT NULL AND sent_quantity <> received_quantity",
     "'manager'", f"'Resolve movement mismatch: sent ' || {_num('sent_quantity')} || ', received ' || {_num('received_quantity')} || '.'",
     "Sender and receiver records conflict.", True),
    ("damage", _fn("quantity"), "'godown_staff'", _q("Count the damaged base units."),
     "Damage observation has no verified quantity.", False),
    ("damage", _fb("human_confirmed"), "'manager'", _q("Review and approve this damage adjustment."),
     "Camera or staff observation cannot alter stock by itself.", True),
    ("expiry", _fb("human_confirmed"), "'manager'", _q("Confirm the batch, expiry date, quantity, and disposition."),
     "Expiry requires a traceable human decision.", True),
    ("attendance", f"{_fs('staff_id')} AND {_fs('badge_id')}", "'manager'",
     _q("Identify this attendance observation using an approved badge or staff record."),
     "Uniform/camera evidence alone is not official attendance.", False),
    ("attendance", f"source = 'camera' AND {_fb('human_confirmed')}", "'manager'",
     _q("Confirm attendance before recording it officially."), "Camera presence is supporting evidence only.", True),
    ("sale", "mapping_verified IS NOT DISTINCT FROM false", "'manager'",
     _q("Confirm the discovered sale-line mapping for this source."),
     "The POS row is real, but its newly discovered schema meaning is not yet human-confirmed.", False),
    ("sale", f"{_fs('product_id')} OR quantity IS NULL", "'data_entry_operator'",
     _q("Repair the sale line with a product and base-unit quantity."), "POS sale record is incomplete.", False),
    ("sale", "stock_after IS NOT NULL AND stock_after < 0", "'shelfer'", _q("Recount shelf stock for this SKU."),
     "The recorded sale produced negative stock.", False),
    ("purchase", f"cartons IS NOT NULL AND {_fn('pack_size')}", "'data_entry_operator'",
     _q("Confirm pack size for this purchase line."), "Carton quantity is ambiguous.", False),
    ("return", _fb("approved"), "'manager'", _q("Approve the return and its stock effect."),
     "Returns change official stock and value.", True),
    ("stock_count", "counted_quantity IS NULL", "'godown_staff'", _q("Count this SKU in base units."),
     "No physical count was recorded.", False),
    ("stock_count", "counted_quantity IS NOT NULL AND expected_quantity IS NOT NULL AND counted_quantity <> expected_quantity",
     "'manager'", f"'Review stock variance: system ' || {_num('expected_quantity')} || ', physical ' || {_num('counted_quantity')} || '.'",
     "Physical count conflicts with the system record.", True),
    ("__unsupported__", "true", "'manager'", _q("Review this unsupported operational event."),
     "No approved workflow is configured for this event type.", False),
]
KNOWN_TYPES_SQL = ", ".join(_q(t) for t in (
    "receiving", "stock_movement", "damage", "expiry", "attendance", "sale", "purchase", "return", "stock_count"))


def wf_tasks_sql(source: str, rules=None) -> str:
    """CTE body: tasks emitted by the rules over a facts relation ``source``."""
    parts = []
    for i, (et, cond, role, question, reason, official) in enumerate(rules or WF_RULES_SQL):
        auth = "'official_record'" if official else "'external_reversible'"
        type_cond = (f"(event_type IS NULL OR event_type NOT IN ({KNOWN_TYPES_SQL}))" if et == "__unsupported__"
                     else f"event_type = '{et}'")
        parts.append(
            f"SELECT id AS related_event_id, store_id, event_type, occurred_at, {i} AS r, {role} AS role, "
            f"{question} AS question, {_q(reason)} AS reason, {auth} AS required_authority "
            f"FROM {source} WHERE {type_cond} AND ({cond})")
    return f"""wf_rule_rows AS ({' UNION ALL '.join(parts)}),
wf_tasks AS (
  SELECT related_event_id || ':' || CAST(CAST(row_number() OVER (PARTITION BY related_event_id ORDER BY r) - 1 AS INTEGER) AS VARCHAR) AS id,
         store_id, related_event_id, event_type,
         CAST(row_number() OVER (PARTITION BY related_event_id ORDER BY r) - 1 AS INTEGER) AS position,
         role, question, reason, required_authority, 'open' AS status, occurred_at AS created_at
  FROM wf_rule_rows)"""


_TASK_COLS = "id, store_id, related_event_id, event_type, position, role, question, reason, required_authority, status, created_at"

ORACLES["evaluate_workflows"] = with_fx(["fx_facts"], f"SELECT {_TASK_COLS} FROM wf_tasks", [wf_tasks_sql("fx_facts")])

for _et in ("receiving", "stock_movement", "damage", "expiry", "attendance", "sale", "purchase", "return", "stock_count"):
    ORACLES[f"wf_{_et}"] = with_fx(
        ["fx_facts"], f"SELECT {_TASK_COLS} FROM wf_tasks WHERE event_type = '{_et}'", [wf_tasks_sql("fx_facts")])

ORACLES["wf_unsupported"] = with_fx(
    ["fx_facts"], f"SELECT {_TASK_COLS} FROM wf_tasks WHERE event_type = 'inventory_audit'",
    ["fx_facts_mixed AS (SELECT * REPLACE (CASE WHEN k % 17 = 0 THEN 'inventory_audit' ELSE event_type END AS event_type) FROM fx_facts)",
     wf_tasks_sql("fx_facts_mixed")])

ORACLES["event_status"] = with_fx(["fx_facts"], """
SELECT e.id, e.store_id, e.event_type,
       CAST(count(t.related_event_id) AS INTEGER) AS task_count,
       CASE WHEN count(t.related_event_id) = 0 THEN 'verified' ELSE 'needs_verification' END AS status
FROM fx_facts e LEFT JOIN wf_tasks t ON t.related_event_id = e.id
GROUP BY e.id, e.store_id, e.event_type""", [wf_tasks_sql("fx_facts")])

ORACLES["evidence_counts"] = with_fx(["fx_evidence"], """
SELECT store_id, coalesce(kind, 'unknown') AS kind, count(*) AS count FROM fx_evidence GROUP BY 1, 2""")

ORACLES["source_freshness"] = with_fx(["fx_all_evidence"], """
SELECT a.store_id, a.source, a.count, a.kinds, l.occurred_at AS latest_at
FROM (SELECT store_id, coalesce(source, 'unknown') AS source, count(*) AS count,
             string_agg(DISTINCT coalesce(kind, 'unknown'), ',' ORDER BY coalesce(kind, 'unknown')) AS kinds
      FROM fx_all_evidence GROUP BY 1, 2) a
LEFT JOIN (SELECT store_id, coalesce(source, 'unknown') AS source, occurred_at,
                  row_number() OVER (PARTITION BY store_id, coalesce(source, 'unknown')
                                     ORDER BY occurred_us DESC, occurred_at, id) AS rn
           FROM fx_all_evidence WHERE occurred_us IS NOT NULL) l
  ON l.store_id = a.store_id AND l.source = a.source AND l.rn = 1""")

ORACLES["event_counts"] = with_fx(["fx_op_event"], """
SELECT store_id, coalesce(event_type, 'unknown') AS event_type, count(*) AS count FROM fx_op_event GROUP BY 1, 2""")

EVENT_STATUS_CTE = """
ev_status AS (
  SELECT e.id, e.store_id, e.event_type,
         CASE WHEN count(t.related_event_id) = 0 THEN 'verified' ELSE 'needs_verification' END AS status
  FROM fx_facts e LEFT JOIN wf_tasks t ON t.related_event_id = e.id GROUP BY e.id, e.store_id, e.event_type)"""

ORACLES["event_status_counts"] = with_fx(["fx_facts"], """
SELECT store_id, coalesce(status, 'unknown') AS status, count(*) AS count FROM ev_status GROUP BY 1, 2""",
                                         [wf_tasks_sql("fx_facts"), EVENT_STATUS_CTE])

ORACLES["open_tasks_by_role"] = with_fx(["fx_task"], """
SELECT store_id, coalesce(role, 'unknown') AS role, count(*) AS count FROM fx_task WHERE status = 'open' GROUP BY 1, 2""")

COVERAGE_CTE = """
coverage AS (
  SELECT b.store_id, b.system_records, b.observations,
         coalesce(m.mc, 0) AS match_count,
         coalesce(m.c, 0) AS corroborated_system_records,
         b.system_records - coalesce(m.c, 0) AS uncorroborated_system_records,
         b.observations - coalesce(m.lo, 0) AS unlinked_observations
  FROM (SELECT store_id, CAST(sum(CASE WHEN kind = 'system_record' THEN 1 ELSE 0 END) AS BIGINT) AS system_records,
               CAST(sum(CASE WHEN kind = 'observation' THEN 1 ELSE 0 END) AS BIGINT) AS observations
        FROM fx_evidence GROUP BY store_id) b
  LEFT JOIN (SELECT store_id, count(DISTINCT system_record_id) AS c, count(DISTINCT observation_id) AS lo,
                    count(*) AS mc FROM nearest_obs GROUP BY store_id) m ON m.store_id = b.store_id)"""

ORACLES["corroboration_coverage"] = with_fx(["fx_evidence"], "SELECT * FROM coverage", [NEAREST_OBS_CTE, COVERAGE_CTE])

GAP_CTE = """
gap AS (
  SELECT store_id, g AS latest_source_gap_us,
         (g // 36000000 + CASE WHEN 2 * (g - (g // 36000000) * 36000000) > 36000000
                                 OR (2 * (g - (g // 36000000) * 36000000) = 36000000 AND (g // 36000000) % 2 = 1)
                               THEN 1 ELSE 0 END) / 100.0::DOUBLE AS latest_source_gap_hours
  FROM (SELECT store_id, abs(max(CASE WHEN kind = 'observation' THEN occurred_us END)
                           - max(CASE WHEN kind = 'system_record' THEN occurred_us END)) AS g
        FROM fx_evidence GROUP BY store_id))"""

ORACLES["latest_source_gap"] = with_fx(["fx_evidence"], "SELECT * FROM gap", [GAP_CTE])


def _counts_text(src: str, key: str, name: str, where: str = "") -> str:
    return f"""{name} AS (
  SELECT store_id, string_agg(k || '=' || CAST(n AS VARCHAR), ', ' ORDER BY k, n) AS {name}
  FROM (SELECT store_id, coalesce({key}, 'unknown') AS k, count(*) AS n FROM {src} {where} GROUP BY 1, 2)
  GROUP BY store_id)"""


ORACLES["operational_snapshot"] = with_fx(["fx_evidence", "fx_facts", "fx_task"], """
SELECT s.store_id,
       CASE WHEN true THEN 'needs_attention' END AS state,
       false AS ready, CAST(0 AS BIGINT) AS unresolved_questions,
       coalesce(evc.evidence_counts, '') AS evidence_counts,
       coalesce(etc.event_counts, '') AS event_counts,
       coalesce(esc.event_status_counts, '') AS event_status_counts,
       coalesce(otr.open_tasks_by_role, '') AS open_tasks_by_role,
       coalesce(lsn.seen_text, '') AS last_seen_by_source,
       coalesce(c.match_count, 0) AS match_count,
       coalesce(c.corroborated_system_records, 0) AS corroborated_system_records,
       coalesce(c.uncorroborated_system_records, 0) AS uncorroborated_system_records,
       coalesce(c.unlinked_observations, 0) AS unlinked_observations,
       g.latest_source_gap_hours,
       15 AS window_minutes,
       concat_ws(' | ', 'Store setup has 0 unresolved confirmation(s).',
                 CASE WHEN c.uncorroborated_system_records > 0 THEN CAST(c.uncorroborated_system_records AS VARCHAR)
                      || ' system record(s) have no camera observation within the configured time window.' END,
                 CASE WHEN coalesce(otr.open_tasks_by_role, '') <> '' THEN 'Open verification work: ' || otr.open_tasks_by_role || '.' END
       ) AS attention
FROM (SELECT store_id FROM fx_evidence UNION SELECT store_id FROM fx_facts UNION SELECT store_id FROM fx_task) s
LEFT JOIN coverage c ON c.store_id = s.store_id
LEFT JOIN gap g ON g.store_id = s.store_id
LEFT JOIN evc ON evc.store_id = s.store_id
LEFT JOIN etc ON etc.store_id = s.store_id
LEFT JOIN esc ON esc.store_id = s.store_id
LEFT JOIN otr ON otr.store_id = s.store_id
LEFT JOIN lsn ON lsn.store_id = s.store_id""", [
    """lsn AS (
  SELECT a.store_id, string_agg(a.source || '=' || CAST(a.n AS VARCHAR) || ' [' || a.kinds || '] ' || coalesce(l.occurred_at, 'never'),
                                ', ' ORDER BY a.source) AS seen_text
  FROM (SELECT store_id, coalesce(source, 'unknown') AS source, count(*) AS n,
               string_agg(DISTINCT coalesce(kind, 'unknown'), ',' ORDER BY coalesce(kind, 'unknown')) AS kinds
        FROM fx_evidence GROUP BY 1, 2) a
  LEFT JOIN (SELECT store_id, coalesce(source, 'unknown') AS source, occurred_at,
                    row_number() OVER (PARTITION BY store_id, coalesce(source, 'unknown') ORDER BY occurred_us DESC, occurred_at, id) AS rn
             FROM fx_evidence WHERE occurred_us IS NOT NULL) l
    ON l.store_id = a.store_id AND l.source = a.source AND l.rn = 1
  GROUP BY a.store_id)""",
    NEAREST_OBS_CTE, COVERAGE_CTE, GAP_CTE, wf_tasks_sql("fx_facts"), EVENT_STATUS_CTE,
    _counts_text("fx_evidence", "kind", "evc"), _counts_text("fx_facts", "event_type", "etc"),
    _counts_text("ev_status", "status", "esc"), _counts_text("fx_task", "role", "otr", "WHERE status = 'open'"),
])
# the CTE names above are short; rename output columns to the Spark names
ORACLES["operational_snapshot"] = ORACLES["operational_snapshot"].replace(
    "evidence_counts AS (", "evc AS (").replace("evc.evidence_counts", "evc.evc").replace(
    "etc.event_counts", "etc.etc").replace("esc.event_status_counts", "esc.esc").replace(
    "otr.open_tasks_by_role", "otr.otr")

NEAREST_CAM_CTE = """
nearest_cam AS (
  SELECT * FROM (
    SELECT e.id AS event_id, o.id AS camera_observation_id,
           abs(e.occurred_us - o.occurred_us) AS camera_time_difference_us,
           row_number() OVER (PARTITION BY e.id ORDER BY abs(e.occurred_us - o.occurred_us), o.occurred_us, o.id) AS rn
    FROM fx_op_event e JOIN fx_all_evidence o
      ON e.store_id = o.store_id AND o.kind = 'observation'
     AND (lower(o.source) LIKE '%camera%' OR lower(o.source) LIKE '%cctv%' OR lower(o.source) LIKE '%vision%')
     AND o.occurred_us BETWEEN e.occurred_us - 900000000 AND e.occurred_us + 900000000) WHERE rn = 1)"""

ORACLES["nearest_camera"] = with_fx(["fx_op_event", "fx_all_evidence"], """
SELECT e.id, e.store_id, n.camera_observation_id, n.camera_time_difference_us
FROM fx_op_event e LEFT JOIN nearest_cam n ON n.event_id = e.id""", [NEAREST_CAM_CTE])

ORACLES["link_evidence"] = with_fx(["fx_links", "fx_all_evidence"], """
SELECT l.event_id, CAST(l.position AS INTEGER) AS position, l.evidence_id, v.kind
FROM fx_links l JOIN fx_all_evidence v ON v.id = l.evidence_id AND v.store_id = l.store_id""")

ORACLES["check_evidence_refs"] = with_fx(["fx_op_event", "fx_all_evidence"], """
SELECT e.id, e.store_id,
       NOT EXISTS (SELECT 1 FROM (SELECT unnest(CASE WHEN e.n % 5 = 0 THEN
                     (CASE WHEN e.evidence_id IS NULL THEN ['evd_missing'] ELSE [e.evidence_id, e.evidence_id, 'evd_missing'] END)
                   ELSE (CASE WHEN e.evidence_id IS NULL THEN [] ELSE [e.evidence_id, e.evidence_id] END) END
                   || CASE WHEN e.n % 9 = 4 THEN ['evd_' || CAST(e.n + 1 AS VARCHAR)] ELSE []::VARCHAR[] END) AS x) u
                   WHERE u.x NOT IN (SELECT id FROM fx_all_evidence)) AS refs_ok
FROM fx_op_event e""")

_YES = "('yes','true','confirmed','verified','received','complete')"
_NO = "('no','false','rejected','mismatch','missing')"
TASK_CONF_CTE = f"""
task_conf AS (
  SELECT t.id AS task_id, t.store_id, t.related_event_id, t.role, t.answer_evidence_id AS confirmation_evidence_id,
         coalesce(CASE WHEN lower(trim(t.answer_confirmed)) IN {_YES} THEN true
                       WHEN lower(trim(t.answer_confirmed)) IN {_NO} THEN false END,
                  CASE WHEN lower(trim(t.answer_received)) IN {_YES} THEN true
                       WHEN lower(trim(t.answer_received)) IN {_NO} THEN false END) AS confirmation,
         t.occurred_at AS created_at
  FROM fx_task t JOIN fx_all_evidence c ON c.id = t.answer_evidence_id AND c.kind = 'human_confirmation'
    AND c.store_id = t.store_id
  WHERE t.status = 'answered'
    AND t.role IN ('data_entry_operator','deo','godown_staff','godown_incharge','shelfer','receiver'))"""

ORACLES["task_confirmations"] = with_fx(["fx_task", "fx_all_evidence"], """
SELECT task_id, store_id, related_event_id, role, confirmation_evidence_id, confirmation FROM task_conf""",
                                        [TASK_CONF_CTE])

PROOFS_CTE = """
proofs AS (
  SELECT e.id AS event_id, e.store_id, e.event_type, e.occurred_at,
         CASE WHEN coalesce(v.neg, '') <> '' THEN 'disputed'
              WHEN coalesce(s.ids, '') = '' THEN 'awaiting_system_record'
              WHEN n.camera_observation_id IS NULL THEN 'awaiting_camera_context'
              WHEN coalesce(v.pos, '') = '' THEN 'awaiting_human_confirmation'
              ELSE 'evidence_complete' END AS state,
         coalesce(s.ids, '') AS system_evidence_ids,
         n.camera_observation_id, n.camera_time_difference_us,
         coalesce(v.pos, '') AS positive_confirmation_task_ids,
         coalesce(v.neg, '') AS negative_confirmation_task_ids,
         concat_ws(',', CASE WHEN coalesce(s.ids, '') = '' THEN 'linked_system_record' END,
                        CASE WHEN n.camera_observation_id IS NULL THEN 'nearby_camera_observation' END,
                        CASE WHEN coalesce(v.pos, '') = '' THEN 'positive_role_routed_confirmation' END) AS missing,
         coalesce(s.ids, '') <> '' AS database_record_present,
         n.camera_observation_id IS NOT NULL AS camera_temporal_context_present,
         coalesce(v.pos, '') <> '' AS role_routed_human_confirmation_present
  FROM fx_op_event e
  LEFT JOIN (SELECT l.event_id, string_agg(l.evidence_id, ',' ORDER BY l.position) AS ids
             FROM fx_links l JOIN fx_all_evidence x ON x.id = l.evidence_id AND x.kind = 'system_record' AND x.store_id = l.store_id
             GROUP BY l.event_id) s ON s.event_id = e.id
  LEFT JOIN (SELECT store_id, related_event_id,
                    string_agg(CASE WHEN confirmation THEN task_id END, ',' ORDER BY created_at, task_id) AS pos,
                    string_agg(CASE WHEN NOT confirmation THEN task_id END, ',' ORDER BY created_at, task_id) AS neg
             FROM task_conf GROUP BY store_id, related_event_id) v ON v.related_event_id = e.id AND v.store_id = e.store_id
  LEFT JOIN nearest_cam n ON n.event_id = e.id)"""

ORACLES["operation_proofs"] = with_fx(["fx_links", "fx_task", "fx_all_evidence"], "SELECT * FROM proofs",
                                      [NEAREST_CAM_CTE, TASK_CONF_CTE, PROOFS_CTE])

ORACLES["proof_state_counts"] = with_fx(["fx_links", "fx_task", "fx_all_evidence"], """
SELECT c.store_id, c.state, c.count, coalesce(x.count, 0) AS complete_count
FROM (SELECT store_id, state, count(*) AS count FROM proofs GROUP BY 1, 2) c
LEFT JOIN (SELECT store_id, count(*) AS count FROM proofs WHERE state = 'evidence_complete' GROUP BY 1) x
  ON x.store_id = c.store_id""", [NEAREST_CAM_CTE, TASK_CONF_CTE, PROOFS_CTE])

from storelens.plans.oracles_catalog import CATALOG_ORACLES  # noqa: E402

ORACLES.update(CATALOG_ORACLES)

ITEMS_CTES = [
    """fx_items AS (
  SELECT store_id, 'sqlserver_operational_facts' AS connector, external_id, occurred_at, kind, confidence,
         operation_type, product_id, quantity, pack_size, destination_id, source_record_hash, mapping_verified
  FROM fx_line_facts)""",
    """prior_ledger AS (
  SELECT DISTINCT store_id, connector, trim(external_id) AS external_id FROM fx_items
  WHERE occurred_at < '1997-01-01' AND trim(external_id) <> '')""",
    """new_items AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY store_id, connector, external_id
      ORDER BY occurred_at NULLS FIRST, confidence NULLS FIRST, destination_id NULLS FIRST, kind NULLS FIRST,
               mapping_verified NULLS FIRST, operation_type NULLS FIRST, pack_size NULLS FIRST,
               product_id NULLS FIRST, quantity NULLS FIRST, source_record_hash NULLS FIRST) AS rn
    FROM (SELECT * REPLACE (trim(external_id) AS external_id) FROM fx_items) WHERE external_id <> '') d
  WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM prior_ledger l WHERE l.store_id = d.store_id
                               AND l.connector = d.connector AND l.external_id = d.external_id))""",
    """norm_evidence AS (
  SELECT 'evd_' || sha256(store_id || '|' || connector || '|' || external_id) AS id,
         store_id, coalesce(nullif(trim(kind), ''), 'observation') AS kind, connector AS source,
         least(greatest(coalesce(CAST(confidence AS DOUBLE), 0.5), 0.0), 1.0) AS confidence,
         coalesce(nullif(trim(occurred_at), ''), '2026-01-01T00:00:00') AS occurred_at, external_id,
         operation_type, product_id, quantity, pack_size, destination_id, source_record_hash, mapping_verified
  FROM new_items
  WHERE coalesce(nullif(trim(kind), ''), 'observation') IN ('observation','system_record','human_confirmation','manager_decision'))""",
    """cycle_events AS (
  SELECT 'evt_' || sha256(id) AS id, store_id,
         CASE WHEN operation_type = 'purchase_line' THEN 'receiving' ELSE 'sale' END AS event_type,
         occurred_at, id AS evidence_id,
         coalesce(mapping_verified, false) AS mapping_verified, product_id, CAST(quantity AS DOUBLE) AS quantity,
         CASE WHEN operation_type = 'purchase_line' THEN CAST(pack_size AS DOUBLE) END AS pack_size,
         CASE WHEN operation_type = 'purchase_line' THEN destination_id END AS destination_id,
         CASE WHEN operation_type = 'purchase_line' THEN false END AS receiver_confirmed,
         source_record_hash,
         NULL::DOUBLE AS cartons, NULL::VARCHAR AS destination_type, NULL::VARCHAR AS from_location,
         NULL::VARCHAR AS to_location, NULL::DOUBLE AS sent_quantity, NULL::DOUBLE AS received_quantity,
         NULL::BOOLEAN AS human_confirmed, NULL::VARCHAR AS staff_id, NULL::VARCHAR AS badge_id,
         NULL::VARCHAR AS source, NULL::DOUBLE AS stock_after, NULL::BOOLEAN AS approved,
         NULL::DOUBLE AS expected_quantity, NULL::DOUBLE AS counted_quantity
  FROM norm_evidence WHERE operation_type IN ('purchase_line', 'sale_line'))""",
]

ORACLES["prime_ledger"] = with_fx(["fx_line_facts"], """
SELECT DISTINCT store_id, connector, trim(external_id) AS external_id FROM fx_items WHERE trim(external_id) <> ''""", ITEMS_CTES[:1])
ORACLES["new_evidence"] = with_fx(["fx_line_facts"], "SELECT * FROM new_items", ITEMS_CTES[:3])
ORACLES["normalize_evidence"] = with_fx(["fx_line_facts"], "SELECT * FROM norm_evidence", ITEMS_CTES[:4])
ORACLES["facts_to_events"] = with_fx(["fx_line_facts"], """
SELECT id, store_id, event_type, occurred_at, evidence_id, mapping_verified, product_id, quantity, pack_size,
       destination_id, receiver_confirmed, source_record_hash FROM cycle_events""", ITEMS_CTES)
ORACLES["operational_cycle"] = with_fx(["fx_line_facts"], f"SELECT {_TASK_COLS} FROM wf_tasks",
                                       ITEMS_CTES + [wf_tasks_sql("cycle_events")])


def ratio4_sql(n: str, d: str) -> str:
    q = f"((10000 * ({n})) // ({d}))"
    rem = f"(10000 * ({n}) - {q} * ({d}))"
    return (f"(CASE WHEN ({d}) IS NULL OR ({d}) = 0 THEN 0.0::DOUBLE ELSE ({q} + CASE WHEN 2 * {rem} > ({d}) "
            f"OR (2 * {rem} = ({d}) AND {q} % 2 = 1) THEN 1 ELSE 0 END) / 10000.0::DOUBLE END)")


def _identity_sql(canonical, path, col, table, role=0.96, mapc=0.98, group=None):
    g = f"{group}, " if group else ""
    nn, u = ratio4_sql("nn", "r"), ratio4_sql("d", "nn")
    passed = f"(r >= 10 AND {nn} >= 0.98 AND {u} >= 0.98 AND {role} >= 0.90 AND {mapc} >= 0.95)"
    return f"""SELECT {g}'{canonical}' AS canonical_field, '{path}' AS source_path, {passed} AS passed,
  CASE WHEN {passed} THEN 0.99 ELSE {mapc} END::DOUBLE AS confidence, 'aggregate_identity_shape' AS basis,
  r AS row_count, {nn} AS nonnull_ratio, {u} AS uniqueness_ratio, NULL::DOUBLE AS positive_ratio,
  NULL::DOUBLE AS negative_ratio, NULL::BIGINT AS distinct_count, {role}::DOUBLE AS role_confidence,
  NULL::BOOLEAN AS numeric_type
FROM (SELECT {g}count(*) AS r, count({col}) AS nn, count(DISTINCT {col}) AS d FROM {table} {'GROUP BY ' + group if group else ''})"""


def _numeric_sql(canonical, path, col, table, role=0.96, mapc=0.98):
    nn, pos, neg = ratio4_sql("nn", "r"), ratio4_sql("p", "nn"), ratio4_sql("n", "nn")
    if canonical == "purchase.quantity":
        passed = f"(r >= 10 AND {nn} >= 0.98 AND {pos} >= 0.90 AND {neg} <= 0.01 AND {role} >= 0.90 AND {mapc} >= 0.95)"
    else:
        passed = f"(r >= 20 AND {nn} >= 0.50 AND {pos} >= 0.50 AND {neg} = 0.0 AND {role} >= 0.80 AND {mapc} >= 0.95)"
    return f"""SELECT '{canonical}' AS canonical_field, '{path}' AS source_path, {passed} AS passed,
  CASE WHEN {passed} THEN 0.99 ELSE {mapc} END::DOUBLE AS confidence, 'aggregate_numeric_shape' AS basis,
  r AS row_count, {nn} AS nonnull_ratio, NULL::DOUBLE AS uniqueness_ratio, {pos} AS positive_ratio,
  {neg} AS negative_ratio, NULL::BIGINT AS distinct_count, {role}::DOUBLE AS role_confidence, true AS numeric_type
FROM (SELECT count(*) AS r, count({col}) AS nn, CAST(sum(CASE WHEN {col} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS p,
             CAST(sum(CASE WHEN {col} < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM {table})"""


def _nonnumeric_sql(canonical, path, mapc=0.98):
    return f"""SELECT '{canonical}' AS canonical_field, '{path}' AS source_path, false AS passed, {mapc}::DOUBLE AS confidence,
  'aggregate_numeric_shape' AS basis, NULL::BIGINT AS row_count, NULL::DOUBLE AS nonnull_ratio,
  NULL::DOUBLE AS uniqueness_ratio, NULL::DOUBLE AS positive_ratio, NULL::DOUBLE AS negative_ratio,
  NULL::BIGINT AS distinct_count, NULL::DOUBLE AS role_confidence, false AS numeric_type"""


def _destination_sql(canonical, path, col, table, role=0.96, mapc=0.98):
    nn = ratio4_sql("nn", "r")
    passed = f"(r >= 10 AND {nn} >= 0.90 AND d >= 2 AND {role} >= 0.90 AND {mapc} >= 0.95)"
    return f"""SELECT '{canonical}' AS canonical_field, '{path}' AS source_path, {passed} AS passed,
  CASE WHEN {passed} THEN 0.99 ELSE {mapc} END::DOUBLE AS confidence, 'aggregate_destination_shape' AS basis,
  r AS row_count, {nn} AS nonnull_ratio, NULL::DOUBLE AS uniqueness_ratio, NULL::DOUBLE AS positive_ratio,
  NULL::DOUBLE AS negative_ratio, d AS distinct_count, {role}::DOUBLE AS role_confidence, NULL::BOOLEAN AS numeric_type
FROM (SELECT count(*) AS r, count({col}) AS nn, count(DISTINCT {col}) AS d FROM {table})"""


ORACLES["identity_shape"] = _identity_sql("product.identity", "tpch.part.p_partkey", "p_partkey", "part")
ORACLES["identity_shape_by_store"] = _identity_sql(
    "product.identity", "tpch.lineitem.l_orderkey", "l_orderkey",
    "(SELECT l.l_orderkey, 'store_' || CAST(o.o_custkey % 10 AS VARCHAR) AS store_id FROM lineitem l "
    "JOIN orders o ON l.l_orderkey = o.o_orderkey)", group="store_id")
ORACLES["numeric_shape"] = "\nUNION ALL\n".join([
    _numeric_sql("purchase.quantity", "tpch.lineitem.l_quantity", "l_quantity", "lineitem"),
    _numeric_sql("product.pack_size", "tpch.part.p_size", "p_size", "part"),
    _nonnumeric_sql("product.pack_size", "tpch.part.p_type"),
    _numeric_sql("product.pack_size", "tpch.customer.c_acctbal", "c_acctbal", "customer"),
])
ORACLES["destination_shape"] = _destination_sql("movement.destination", "tpch.lineitem.l_suppkey", "l_suppkey", "lineitem")
PROFILE_SQL = "\nUNION ALL\n".join([
    _identity_sql("product.identity", "tpch.part.p_partkey", "p_partkey", "part"),
    _numeric_sql("purchase.quantity", "tpch.lineitem.l_quantity", "l_quantity", "lineitem"),
    _numeric_sql("product.pack_size", "tpch.part.p_size", "p_size", "part"),
    _destination_sql("movement.destination", "tpch.lineitem.l_suppkey", "l_suppkey", "lineitem"),
    """SELECT 'movement.destination', 'tpch.transfers.to_location', false, 0.98::DOUBLE, 'aggregate_validation_failed',
  NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT, NULL::DOUBLE, NULL::BOOLEAN""",
])
ORACLES["profile_mappings"] = PROFILE_SQL
ORACLES["staff_role_counts"] = """
SELECT 'store_' || CAST(c_nationkey AS VARCHAR) AS store_id,
       coalesce(nullif(CASE translate(lower(trim(coalesce(c_mktsegment, ''))), '- ', '__')
         WHEN 'staff' THEN 'shelfer' WHEN 'shelf_staff' THEN 'shelfer' WHEN 'shelf' THEN 'shelfer'
         WHEN 'godown' THEN 'godown_incharge' WHEN 'data_entry_operator' THEN 'deo'
         WHEN 'product_assistance' THEN 'product_manager' WHEN 'product_assistant' THEN 'product_manager'
         WHEN 'productmanager' THEN 'product_manager' WHEN 'purchase_accounts' THEN 'purchase_incharge'
         WHEN 'purchase_account' THEN 'purchase_incharge'
         ELSE translate(lower(trim(coalesce(c_mktsegment, ''))), '- ', '__') END, ''), 'unassigned') AS role,
       count(*) AS count
FROM customer GROUP BY 1, 2"""

ORACLES["stream_correlation"] = with_fx(["fx_evidence"], """
SELECT store_id, system_record_id, observation_id, time_difference_us FROM nearest_obs""", [NEAREST_OBS_CTE])
ORACLES["stream_operational_cycle"] = with_fx(
    ["fx_line_facts"], f"SELECT {_TASK_COLS} FROM wf_tasks",
    [ITEMS_CTES[0], "prior_ledger AS (SELECT store_id, connector, external_id FROM fx_items WHERE false)"]
    + ITEMS_CTES[2:] + [wf_tasks_sql("cycle_events")])
