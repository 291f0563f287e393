"""DuckDB oracle SQL for every registered query.

Each oracle recomputes the ``fx_*`` projection from the raw driver views and
then the operator semantics in plain SQL, independently of the Spark code.
"""

from __future__ import annotations

EVENT_TYPE_LIST = (
    "['receiving','stock_movement','damage','expiry','attendance','sale','purchase','return','stock_count']"
)

FX: dict[str, str] = {}

FX["fx_evidence"] = """
fx_evidence AS (
  SELECT 'evd_' || CAST(event_id AS VARCHAR) AS id,
         'store_' || CAST(user_id % 4 AS VARCHAR) AS store_id,
         CASE WHEN event_type IN ('view', 'click') THEN 'observation'
              WHEN event_type = 'purchase' THEN 'system_record'
              WHEN event_type = 'signup' THEN 'human_confirmation'
              WHEN event_type = 'error' THEN 'manager_decision' END AS kind,
         CASE event_type WHEN 'view' THEN 'camera_' || CAST(event_id % 3 AS VARCHAR)
              WHEN 'click' THEN 'door_sensor' WHEN 'purchase' THEN 'pos'
              WHEN 'signup' THEN 'staff_app' WHEN 'error' THEN 'manager_app' END AS source,
         least(greatest(value / 100, 0.0), 1.0) AS confidence,
         CASE WHEN event_id % 50 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS occurred_at,
         CASE WHEN event_id % 50 = 0 THEN NULL ELSE epoch_us(ts) END AS occurred_us,
         props AS payload,
         event_id AS n
  FROM events)"""

FX["fx_op_event"] = f"""
fx_op_event AS (
  SELECT 'evt_' || CAST(event_id AS VARCHAR) AS id,
         'store_' || CAST(user_id % 4 AS VARCHAR) AS store_id,
         ({EVENT_TYPE_LIST})[event_id % 9 + 1] AS event_type,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS occurred_at,
         epoch_us(ts) AS occurred_us,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'evd_' || CAST(event_id AS VARCHAR) END AS evidence_id,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         event_id AS n
  FROM events WHERE event_type = 'purchase')"""

FX["fx_facts"] = """
fx_facts AS (
  SELECT e.*,
    CASE WHEN n % 3 = 0 THEN NULL ELSE n % 2 = 0 END AS mapping_verified,
    CASE WHEN k % 10 = 0 THEN '' WHEN k % 10 = 1 THEN NULL ELSE 'SKU-' || CAST(k AS VARCHAR) END AS product_id,
    CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k % 5 AS DOUBLE) END AS cartons,
    CASE WHEN k % 4 = 0 THEN 0.0::DOUBLE WHEN k % 4 = 1 THEN NULL ELSE 12.0::DOUBLE END AS pack_size,
    CASE WHEN k % 5 = 0 THEN NULL ELSE 'GD-' || CAST(k % 5 AS VARCHAR) END AS destination_id,
    CASE WHEN k % 2 = 0 THEN 'shelf' ELSE 'godown' END AS destination_type,
    k % 6 = 0 AS receiver_confirmed,
    CASE WHEN k % 7 = 0 THEN NULL ELSE 'GD-A' END AS from_location,
    CASE WHEN k % 11 = 0 THEN '' ELSE 'S-1' END AS to_location,
    CASE WHEN k % 8 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS sent_quantity,
    CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(k - k % 2 AS DOUBLE) END AS received_quantity,
    CASE WHEN n % 5 = 0 THEN 0.0::DOUBLE WHEN n % 5 = 1 THEN NULL ELSE CAST(k AS DOUBLE) END AS quantity,
    CASE WHEN n % 4 = 0 THEN NULL ELSE n % 4 = 1 END AS human_confirmed,
    CASE WHEN k % 3 = 0 THEN 'staff-' || CAST(k AS VARCHAR) END AS staff_id,
    CASE WHEN k % 4 = 0 THEN 'B-' || CAST(k AS VARCHAR) END AS badge_id,
    CASE WHEN k % 2 = 0 THEN 'camera' ELSE 'app' END AS source,
    CASE WHEN k % 6 = 1 THEN NULL ELSE CAST(k - 50 AS DOUBLE) END AS stock_after,
    CASE WHEN n % 3 = 1 THEN n % 2 = 1 END AS approved,
    CASE WHEN k % 5 = 1 THEN NULL ELSE CAST(k AS DOUBLE) END AS expected_quantity,
    CASE WHEN k % 7 = 2 THEN NULL ELSE CAST(k + k % 2 AS DOUBLE) END AS counted_quantity
  FROM fx_op_event e)"""

FX["fx_task"] = """
fx_task AS (
  SELECT 'task_' || CAST(n AS VARCHAR) AS id, store_id, id AS related_event_id,
         (['manager','data_entry_operator','godown_staff','shelfer','receiver','deo'])[n % 6 + 1] AS role,
         CASE WHEN n % 3 = 0 THEN 'open' ELSE 'answered' END AS status,
         CASE WHEN n % 3 <> 0 THEN (['yes','no','maybe',' True ','Mismatch'])[n % 5 + 1] END AS answer_confirmed,
         CASE WHEN n % 3 <> 0 AND n % 5 = 2 AND n % 2 = 0 THEN 'received' END AS answer_received,
         CASE WHEN n % 3 <> 0 THEN 'cnf_' || CAST(n AS VARCHAR) END AS answer_evidence_id,
         occurred_at, n
  FROM fx_op_event)"""

FX["fx_confirmation"] = """
fx_confirmation AS (
  SELECT 'cnf_' || CAST(n AS VARCHAR) AS id, store_id,
         CASE WHEN n % 13 = 0 THEN 'manager_decision' ELSE 'human_confirmation' END AS kind,
         'staff_app' AS source, 1.0::DOUBLE AS confidence, occurred_at,
         '{"task_id": "task_' || CAST(n AS VARCHAR) || '"}' AS payload
  FROM fx_task WHERE status = 'answered' AND n % 11 <> 0)"""

FX["fx_line"] = """
fx_line AS (
  SELECT 'store_' || CAST(o.o_orderkey % 10 AS VARCHAR) AS store_id,
         CASE WHEN l.l_linestatus = 'O' THEN 'purchase' ELSE 'sale' END AS op,
         o.o_orderkey // 10 AS o_orderkey, o.o_orderdate, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity,
         l.l_extendedprice,
         CASE WHEN (p.p_size + o.o_orderkey % 10) % 10 = 0 THEN NULL ELSE p.p_size END AS pack_size,
         10 * p.p_partkey + o.o_orderkey % 10 AS p_partkey
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN part p ON p.p_partkey = l.l_partkey)"""

FX["fx_line_facts"] = """
fx_line_facts AS (
  SELECT store_id, op || '_line' AS operation_type,
         'sql-operation:' || op || ':' || substr(sha256(op || '|' || CAST(o_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)), 1, 20) AS external_id,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS occurred_at,
         'system_record' AS kind, 0.78::DOUBLE AS confidence,
         trim(CAST(p_partkey AS VARCHAR)) AS product_id,
         CAST(l_quantity AS DOUBLE) AS quantity,
         CASE WHEN pack_size > 0 THEN CAST(pack_size AS DOUBLE) END AS pack_size,
         CAST(l_suppkey AS VARCHAR) AS destination_id,
         substr(sha256(op || '|' || CAST(o_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)), 1, 20) AS source_record_hash,
         false AS mapping_verified,
         o_orderdate, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, op
  FROM fx_line)"""

FX["fx_all_evidence"] = """
fx_all_evidence AS (
  SELECT id, store_id, kind, source, confidence, occurred_at, payload, occurred_us FROM fx_evidence
  UNION ALL
  SELECT id, store_id, kind, source, confidence, occurred_at, payload,
         epoch_us(try_cast(occurred_at AS TIMESTAMP)) AS occurred_us FROM fx_confirmation)"""

FX["fx_links"] = """
fx_links AS (
  SELECT id AS event_id, store_id, unnest(ids) AS evidence_id, unnest(generate_series(0, len(ids) - 1)) AS position
  FROM (SELECT id, store_id, CASE WHEN evidence_id IS NULL THEN ['evd_missing']
                                  ELSE [evidence_id, evidence_id, 'evd_missing'] END
                             || CASE WHEN n % 9 = 4 THEN ['evd_' || CAST(n + 1 AS VARCHAR)] ELSE []::VARCHAR[] END AS ids
        FROM fx_op_event))"""

# Dependencies between fixture CTEs.
FX_DEPS = {
    "fx_facts": ["fx_op_event"],
    "fx_task": ["fx_op_event"],
    "fx_confirmation": ["fx_op_event", "fx_task"],
    "fx_line_facts": ["fx_line"],
    "fx_all_evidence": ["fx_evidence", "fx_confirmation"],
    "fx_links": ["fx_op_event"],
}


def with_fx(names: list[str], body: str, extra: list[str] | None = None) -> str:
    """Prefix ``body`` with the needed fixture CTEs (and extra named CTE texts)."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in FX_DEPS.get(name, []):
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = [FX[n] for n in ordered] + list(extra or [])
    return "WITH " + ",\n".join(ctes) + "\n" + body
