"""DuckDB oracles of the streaming queries: what the streams must have written in the end."""

from storelens.oracle_sql import with_fx
from storelens.plans.oracles import ITEMS_CTES, NEAREST_OBS_CTE, ORACLES

_BATCH = "CASE WHEN occurred_at < '1997-01-01' THEN 0 WHEN occurred_at < '1999-01-01' THEN 1 ELSE 2 END"
_KEYS = f"""keys AS (
  SELECT store_id, connector, trim(external_id) AS external_id, min({_BATCH}) AS batch FROM fed
  WHERE trim(external_id) <> '' GROUP BY 1, 2, 3)"""

ORACLES["stream_prime_ledger"] = with_fx(["fx_line_facts"], """
SELECT k.store_id, k.connector, count(*) FILTER (WHERE batch = first) AS primed, count(*) FILTER (WHERE batch > first) AS imported
FROM keys k JOIN (SELECT store_id, connector, min(batch) AS first FROM keys GROUP BY 1, 2) p
  ON p.store_id = k.store_id AND p.connector = k.connector GROUP BY 1, 2""", [ITEMS_CTES[0], """fed AS (
  SELECT store_id, connector, external_id, occurred_at FROM fx_items
  UNION ALL
  SELECT store_id, 'late_feed', external_id, occurred_at FROM fx_items
  WHERE occurred_at >= '1997-01-01' AND CAST(substr(store_id, 7, 1) AS INTEGER) < 5)""", _KEYS])

ORACLES["stream_cycle_health"] = with_fx(["fx_line_facts"], """
SELECT store_id, CAST(batch AS VARCHAR) AS cycle_id, n AS imported, 0::BIGINT AS primed, n AS events_created,
       CAST(CASE WHEN store_id = '*' AND batch = 2 THEN 1 ELSE 0 END AS BIGINT) AS error_count,
       CASE WHEN store_id = '*' AND batch = 2 THEN 'archive=1' ELSE '' END AS errors, NOT (store_id = '*' AND batch = 2) AS healthy
FROM (SELECT store_id, batch, count(*) AS n FROM keys GROUP BY 1, 2
      UNION ALL SELECT '*', batch, count(*) FROM keys GROUP BY 2)""", [ITEMS_CTES[0], "fed AS (SELECT * FROM fx_items)", _KEYS])

ORACLES["stream_interval_correlation"] = with_fx(["fx_evidence"], """
SELECT s.store_id, s.id AS system_record_id, n.observation_id, n.time_difference_us
FROM fx_evidence s LEFT JOIN nearest_obs n ON n.system_record_id = s.id
WHERE s.kind = 'system_record' AND s.occurred_us IS NOT NULL""", [NEAREST_OBS_CTE])

ORACLES["stream_collector_health"] = """
WITH beats AS (
  SELECT DISTINCT 'store_' || CAST(user_id % 20 AS VARCHAR) AS store_id, epoch_us(ts) // 1000 AS at_ms,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'running' END AS status,
         CASE WHEN event_type = 'signup' THEN 'unknown' ELSE 'running' END AS camera
  FROM events),
stated AS (
  SELECT *, CASE WHEN status = 'error' THEN 'not_running' WHEN camera = 'running' THEN 'running' ELSE 'unmonitored' END AS state FROM beats),
placed AS (
  SELECT *, lag(at_ms) OVER w AS before, lag(state) OVER w AS was, lead(at_ms) OVER w AS after, max(at_ms) OVER () AS newest
  FROM stated WINDOW w AS (PARTITION BY store_id ORDER BY at_ms))
SELECT store_id, at_ms, state, status AS collector_status, camera AS camera_status, 'running' AS sql_status
FROM placed WHERE before IS NULL OR at_ms - before > 5400000 OR state <> was
UNION ALL
SELECT store_id, at_ms + 5400000, 'stale_heartbeat', status, camera, 'running'
FROM placed WHERE after - at_ms > 5400000 OR (after IS NULL AND at_ms + 5400000 <= newest)
"""
