"""DuckDB oracles of the composed operations."""

from storelens.oracle_sql import with_fx
from storelens.plans.oracles import ITEMS_CTES, ORACLES, ratio4_sql, wf_tasks_sql
from storelens.plans.oracles_catalog import CAT_CTES
from storelens.plans.oracles_sources import CAMERA_SQL
from storelens.plans.oracles_state import ACTIONS_CTE, ANSWERS_CTE

_NN, _UNIQ, _POS, _NEG = ratio4_sql("nn", "r"), ratio4_sql("d", "nn"), ratio4_sql("p", "nn"), ratio4_sql("ng", "nn")


def _stats(path: str, column: str, value: str, source: str, store: str = "NULL::VARCHAR") -> str:
    return (f"SELECT store_id, '{path}' AS table_path, '{column}' AS col, count(*) AS r, count(v) AS nn, count(DISTINCT v) AS d, "
            f"CAST(coalesce(sum(CASE WHEN try_cast(v AS DOUBLE) > 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS p, "
            f"CAST(coalesce(sum(CASE WHEN try_cast(v AS DOUBLE) < 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS ng "
            f"FROM (SELECT {store} AS store_id, CAST({value} AS VARCHAR) AS v FROM {source}) GROUP BY store_id")


_OWN = "'cat_' || CAST(o_custkey AS VARCHAR)"
_LINES = "lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = "
# The shape checks of every column that a mapping of the SQL template can name; lines are each store's own, products shared.
_STATS = "\n  UNION ALL ".join([
    _stats("store_sql.dbo.Products", "ProductId", "p_partkey", "part"),
    _stats("store_sql.dbo.Products", "SKU", "'P' || p_partkey", "part"),
    _stats("store_sql.dbo.Products", "UnitsPerCase", "CASE WHEN p_size % 10 <> 0 THEN p_size END", "part"),
    _stats("store_sql.dbo.ReceiptLines", "Quantity", "l_quantity", _LINES + "'O'", _OWN),
    _stats("store_sql.dbo.ReceiptLines", "DestinationId", "l_suppkey", _LINES + "'O'", _OWN),
    _stats("store_sql.dbo.SaleLines", "SoldQty", "l_quantity", _LINES + "'F'", _OWN),
])

VALIDATION_CTES = "WITH " + CAT_CTES.strip() + f""",
colstats AS ({_STATS}),
checked(canonical_field, role) AS (VALUES ('product.identity', 'product_catalog'), ('purchase.quantity', 'purchase_line'),
  ('product.pack_size', 'product_catalog'), ('movement.destination', 'stock_movement')),
vtargets AS (
  SELECT m.store_id, m.canonical_field, m.source_path, c.table_path, c."column" AS col, c.type, CAST(m.confidence AS DOUBLE) AS mc,
         coalesce((SELECT max(CAST(s.confidence AS DOUBLE)) FROM role_scores s WHERE s.store_id = m.store_id AND s.role = k.role
                   AND s.source_path = c.table_path AND s.confidence >= 0.50), 0.0) AS rc
  FROM mappings m JOIN sqlcat c ON c.store_id = m.store_id AND c.path = m.source_path
  JOIN checked k ON k.canonical_field = m.canonical_field WHERE NOT m.verified),
judged AS (
  SELECT t.*,
         lower(t.type) IN ('bigint','decimal','float','int','money','numeric','real','smallint','smallmoney','tinyint') AS numeric_type,
         {_NN} AS nnr, {_UNIQ} AS ur, {_POS} AS pr, {_NEG} AS ngr
  FROM (SELECT t.*, k.table_path IS NOT NULL AS known, CASE WHEN k.table_path IS NOT NULL THEN coalesce(s.r, 0) END AS r,
               coalesce(s.nn, 0) AS nn, coalesce(s.d, 0) AS d, coalesce(s.p, 0) AS p, coalesce(s.ng, 0) AS ng
        FROM vtargets t LEFT JOIN (SELECT DISTINCT table_path, col FROM colstats) k ON k.table_path = t.table_path AND k.col = t.col
        LEFT JOIN colstats s ON s.table_path = t.table_path AND s.col = t.col AND (s.store_id IS NULL OR s.store_id = t.store_id)) t),
reports AS (
  SELECT *, CASE WHEN NOT known THEN false
    WHEN canonical_field = 'product.identity' THEN r >= 10 AND nnr >= 0.98 AND ur >= 0.98 AND rc >= 0.90 AND mc >= 0.95
    WHEN canonical_field = 'movement.destination' THEN r >= 10 AND nnr >= 0.90 AND d >= 2 AND rc >= 0.90 AND mc >= 0.95
    WHEN NOT numeric_type THEN false
    WHEN canonical_field = 'purchase.quantity' THEN r >= 10 AND nnr >= 0.98 AND pr >= 0.90 AND ngr <= 0.01 AND rc >= 0.90 AND mc >= 0.95
    ELSE r >= 20 AND nnr >= 0.50 AND pr >= 0.50 AND ngr = 0.0 AND rc >= 0.80 AND mc >= 0.95 END AS passed
  FROM judged)"""

_NUMERIC = "canonical_field IN ('purchase.quantity', 'product.pack_size')"
ORACLES["validate_mappings"] = VALIDATION_CTES + f"""
SELECT store_id, canonical_field, source_path, passed, CASE WHEN passed THEN 0.99 ELSE mc END AS confidence,
       CASE WHEN NOT known THEN 'aggregate_validation_failed' WHEN canonical_field = 'product.identity' THEN 'aggregate_identity_shape'
            WHEN canonical_field = 'movement.destination' THEN 'aggregate_destination_shape' ELSE 'aggregate_numeric_shape' END AS basis,
       CASE WHEN known AND ({_NUMERIC}) AND NOT numeric_type THEN NULL ELSE r END AS row_count,
       CASE WHEN known AND NOT ({_NUMERIC} AND NOT numeric_type) THEN nnr END AS nonnull_ratio,
       CASE WHEN known AND canonical_field = 'product.identity' THEN ur END AS uniqueness_ratio,
       CASE WHEN known AND {_NUMERIC} AND numeric_type THEN pr END AS positive_ratio,
       CASE WHEN known AND {_NUMERIC} AND numeric_type THEN ngr END AS negative_ratio,
       CASE WHEN known AND canonical_field = 'movement.destination' THEN d END AS distinct_count,
       CASE WHEN known AND NOT ({_NUMERIC} AND NOT numeric_type) THEN rc END AS role_confidence,
       CASE WHEN known AND {_NUMERIC} THEN numeric_type END AS numeric_type
FROM reports"""

ORACLES["promote_mappings"] = VALIDATION_CTES + """
SELECT m.store_id, m.canonical_field, m.source_path,
       CASE WHEN p.passed THEN greatest(CAST(m.confidence AS DOUBLE), 0.99) ELSE CAST(m.confidence AS DOUBLE) END AS confidence,
       CASE WHEN p.passed THEN 'Column shape checks passed; only aggregates of the column were computed.' ELSE m.reasoning END AS reasoning,
       coalesce(p.passed, false) OR m.verified AS verified,
       CASE WHEN NOT p.passed OR p.passed IS NULL THEN NULL WHEN m.canonical_field = 'product.identity' THEN 'aggregate_identity_shape'
            WHEN m.canonical_field = 'movement.destination' THEN 'aggregate_destination_shape' ELSE 'aggregate_numeric_shape' END AS verification_basis
FROM mappings m LEFT JOIN (SELECT * FROM reports WHERE passed) p ON p.store_id = m.store_id AND p.canonical_field = m.canonical_field
 AND p.source_path = m.source_path"""

ORACLES["validation_questions"] = VALIDATION_CTES + """
SELECT q.store_id, q.key, q.resolved OR p.source_path IS NOT NULL AS resolved, p.source_path AS answer,
       CASE WHEN p.source_path IS NOT NULL THEN 'autonomous_aggregate_validator' END AS resolved_by
FROM questions q LEFT JOIN reports p ON p.passed AND p.store_id = q.store_id AND 'verify:' || p.canonical_field = q.key"""

ORACLES["validation_readiness"] = VALIDATION_CTES + """,
checks2 AS (
  SELECT g.store_id, g.check_key, g.check_pos,
         string_agg(CASE WHEN NOT (coalesce(m.verified, false) OR p.passed IS NOT NULL) THEN g.canonical_field END, ', ' ORDER BY g.field_order) AS missing
  FROM (SELECT s.store_id, r.* FROM fx_stores s CROSS JOIN rgroups r) g
  LEFT JOIN mappings m ON m.store_id = g.store_id AND m.canonical_field = g.canonical_field
  LEFT JOIN (SELECT * FROM reports WHERE passed) p ON p.store_id = g.store_id AND p.canonical_field = g.canonical_field
  GROUP BY 1, 2, 3),
open_questions AS (
  SELECT q.store_id, count(*) AS n FROM questions q
  LEFT JOIN (SELECT * FROM reports WHERE passed) p ON p.store_id = q.store_id AND 'verify:' || p.canonical_field = q.key
  WHERE p.passed IS NULL GROUP BY 1)
SELECT c.store_id,
       sum(CASE WHEN c.missing IS NULL THEN 1 ELSE 0 END) = 5 AND coalesce(q.n, 0) = 0 AS ready,
       CAST(coalesce(q.n, 0) AS BIGINT) AS unresolved_questions,
       CAST(sum(CASE WHEN c.missing IS NULL THEN 1 ELSE 0 END) AS INTEGER) AS checks_passed,
       string_agg(c.check_key || ':' || CASE WHEN c.missing IS NULL THEN 'Verified' ELSE 'Awaiting: ' || c.missing END,
                  ' | ' ORDER BY c.check_pos) AS detail
FROM checks2 c LEFT JOIN open_questions q ON q.store_id = c.store_id GROUP BY c.store_id, q.n"""

_ROUND = [ITEMS_CTES[0], ITEMS_CTES[1], """
fresh AS (
  SELECT DISTINCT store_id, connector, external_id, operation_type, CAST(substr(store_id, 7) AS INTEGER) AS k
  FROM (SELECT * REPLACE (trim(external_id) AS external_id) FROM fx_items) i
  WHERE external_id <> '' AND NOT EXISTS (SELECT 1 FROM prior_ledger l WHERE l.store_id = i.store_id
        AND l.connector = i.connector AND l.external_id = i.external_id))""", f"""
cameras AS (SELECT store_id, external_id FROM ({CAMERA_SQL}))"""]

ORACLES["operational_round"] = with_fx(["fx_line_facts"], """
SELECT s.store_id, 'round-1' AS cycle_id,
       CAST((SELECT count(*) FROM fresh f WHERE f.store_id = s.store_id AND f.k < 7)
            + (SELECT count(*) FROM cameras c WHERE c.store_id = s.store_id) AS BIGINT) AS imported,
       CAST((SELECT count(*) FROM fresh f WHERE f.store_id = s.store_id AND f.k >= 7) AS BIGINT) AS primed,
       CAST((SELECT count(*) FROM fresh f WHERE f.store_id = s.store_id AND f.k < 7
             AND f.operation_type IN ('purchase_line', 'sale_line')) AS BIGINT) AS events_created,
       CAST(1 AS BIGINT) AS error_count, 'broken_source=1' AS errors, false AS healthy
FROM (SELECT 'store_' || CAST(i AS VARCHAR) AS store_id FROM range(10) t(i)) s""", _ROUND)

ORACLES["operational_round_ledger"] = with_fx(["fx_line_facts"], """
SELECT store_id, connector, count(*) AS ids FROM (
  SELECT store_id, connector, external_id FROM prior_ledger
  UNION ALL SELECT store_id, connector, external_id FROM fresh
  UNION ALL SELECT store_id, 'local_camera_events', external_id FROM cameras) GROUP BY 1, 2""", _ROUND)

_ID = "'aud_' || sha256({a} || '|' || store_id || '|' || {t} || '|' || {at})"


def _audit(action: str, actor: str, target: str, detail: str, at: str, source: str) -> str:
    key = _ID.format(a=f"'{action}'", t=target, at=at)
    return (f"SELECT store_id, {key} AS id, '{action}' AS action, {actor} AS actor, {target} AS target, {detail} AS detail, "
            f"{at} AS created_at FROM {source}")


_ROWS = "\nUNION ALL ".join([
    _audit("task_answered", "'gateway'", "task_id",
           "'{\"confirmation_evidence_id\":\"evd_' || sha256(store_id || '|' || answer_id) || '\"}'", "answered_at", "accepted"),
    _audit("action_requested", "'engine'", "id", "'{\"authority\":\"' || authority || '\",\"status\":\"' || initial_status || '\"}'",
           "requested_at", "actions"),
    _audit("action_approved", "approved_by", "id", "'{}'", "approved_at", "actions WHERE approved_at IS NOT NULL"),
    _audit("action_executed", "'executor'", "id", "'{}'", "executed_at", "actions WHERE executed_at IS NOT NULL"),
    _audit("event_evaluated", "'engine'", "id",
           "'{\"event_type\":\"' || event_type || '\",\"tasks_created\":' || CAST(n_tasks AS VARCHAR) || '}'", "occurred_at",
           "(SELECT e.id, e.store_id, e.event_type, e.occurred_at, count(t.related_event_id) AS n_tasks FROM fx_facts e "
           "LEFT JOIN wf_tasks t ON t.related_event_id = e.id GROUP BY 1, 2, 3, 4)"),
])
ORACLES["operation_audit"] = with_fx(["fx_task", "fx_facts"], f"""
SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY created_at, id) AS sequence FROM ({_ROWS})""",
                                     [ANSWERS_CTE, ACTIONS_CTE, wf_tasks_sql("fx_facts")])

ORACLES["health_actions"] = "WITH health AS (" + ORACLES["collector_health"] + """)
SELECT 'act_' || sha256(store_id || '|authorize_start_camera_collector|2026-01-01T00:00:00') AS id, store_id,
       'authorize_start_camera_collector' AS action, 'local_camera_collector' AS target,
       'Collector state ' || state || ': the owner has to allow a start.' AS reason, 'system_change' AS authority,
       '2026-01-01T00:00:00' AS requested_at, 'pending_approval' AS status
FROM health WHERE NOT live_camera_ready AND CAST(regexp_extract(store_id, '([0-9]+)', 1) AS INTEGER) % 3 <> 0"""
