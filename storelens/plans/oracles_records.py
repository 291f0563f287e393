"""DuckDB oracles of the record-store queries."""

from storelens.plans.oracles import ORACLES

ORACLES["latest_records"] = """
SELECT id, version, store_id, kind, created_at, status, total FROM (
  SELECT 'cust_' || CAST(o_custkey AS VARCHAR) AS id, 'store_' || CAST(o_custkey % 10 AS VARCHAR) AS store_id,
         'customer_profile' AS kind, o_orderkey AS version, strftime(o_orderdate, '%Y-%m-%d') AS created_at,
         o_orderstatus AS status, o_totalprice AS total, o_orderstatus = 'P' AS deleted,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1 AND NOT deleted"""

ORACLES["latest_settings"] = """
SELECT store_id, key, value, version FROM (
  SELECT 'store_' || CAST(user_id % 4 AS VARCHAR) AS store_id, event_type AS key, props AS value, event_id AS version,
         row_number() OVER (PARTITION BY user_id % 4, event_type ORDER BY event_id DESC) AS rn
  FROM events) WHERE rn = 1"""

ORACLES["audit_log"] = """
SELECT store_id, id, action, actor, target, detail, created_at,
       row_number() OVER (PARTITION BY store_id ORDER BY created_at, id) AS sequence
FROM (SELECT 'store_' || CAST(user_id % 4 AS VARCHAR) AS store_id, 'aud_' || CAST(event_id AS VARCHAR) AS id,
             event_type AS action, 'user_' || CAST(user_id AS VARCHAR) AS actor, 'evd_' || CAST(event_id AS VARCHAR) AS target,
             props AS detail, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS created_at FROM events)"""

ORACLES["recent_top_n"] = """
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders)
WHERE rank <= 3"""

ORACLES["dedupe_ordered"] = """
SELECT min(p_partkey) AS position, arg_min(p_type, p_partkey) AS value
FROM part WHERE p_type IS NOT NULL AND p_type <> '' GROUP BY lower(p_type)"""

# However the tables were kept, they hold what one pass over all versions or actions gives.
ORACLES["audit_log_append"] = ORACLES["audit_log"]
ORACLES["current_records"] = ORACLES["latest_records"]
ORACLES["current_settings"] = ORACLES["latest_settings"]
