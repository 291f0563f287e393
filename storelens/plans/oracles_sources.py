"""DuckDB oracles of the source scans."""

from __future__ import annotations

from storelens.plans.oracles import ORACLES
from storelens.plans.oracles_catalog import CAT_CTES

_ISO = "'%Y-%m-%dT%H:%M:%S.%f'"


CAMERA_SQL = "\nUNION ALL\n".join([
    f"""SELECT 'store_' || CAST(user_id % 4 AS VARCHAR) AS store_id, 'observations' AS source_table,
  'collector.sqlite3:observations:' || CAST(event_id AS VARCHAR) AS external_id, strftime(ts, {_ISO}) AS occurred_at,
  'observation' AS kind, 0.9::DOUBLE AS confidence, CAST(event_id AS VARCHAR) AS camera_event_id,
  'collector.sqlite3' AS collector, CAST(user_id % 8 AS VARCHAR) AS camera_channel,
  CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) AS max_people, event_type AS detector,
  'activity_observation_only' AS camera_claim FROM events WHERE event_type = 'view'""",
    f"""SELECT 'store_' || CAST(user_id % 4 AS VARCHAR) AS store_id, 'detections' AS source_table,
  'collector.sqlite3:detections:' || CAST(event_id AS VARCHAR) AS external_id, strftime(ts, {_ISO}) AS occurred_at,
  'observation' AS kind, 0.9::DOUBLE AS confidence, CAST(event_id AS VARCHAR) AS camera_event_id,
  'collector.sqlite3' AS collector, CAST(user_id % 8 AS VARCHAR) AS camera_channel,
  NULL::VARCHAR AS max_people, 'yolo' AS detector,
  'activity_observation_only' AS camera_claim FROM events WHERE event_type = 'click'""",
])
ORACLES["scan_camera_events"] = CAMERA_SQL
ORACLES["scan_newest"] = f"""
SELECT * FROM ({CAMERA_SQL})
QUALIFY row_number() OVER (PARTITION BY store_id, source_table ORDER BY occurred_at DESC, external_id) <= 100"""

LABELS_SQL = f"""SELECT 'store_' || CAST(user_id % 4 AS VARCHAR) AS store_id,
  'collector.sqlite3:verified_label:' || CAST(event_id AS VARCHAR) AS external_id, strftime(ts, {_ISO}) AS occurred_at,
  'human_confirmation' AS kind, 1.0::DOUBLE AS confidence, CAST(event_id AS VARCHAR) AS camera_event_id,
  'confirm_' || event_type AS action, 'SKU-' || CAST(event_id % 97 AS VARCHAR) AS product_sku,
  CAST(floor(value) AS DOUBLE) AS quantity, 'zone_' || CAST(user_id % 3 AS VARCHAR) AS source_zone,
  'shelf_' || CAST(event_id % 5 AS VARCHAR) AS destination_shelf, 'collector_human_label' AS verification_method
  FROM events WHERE event_type = 'signup'"""
ORACLES["scan_verified_labels"] = LABELS_SQL

FACTS_SQL = """SELECT 'store_' || CAST(l_suppkey % 10 AS VARCHAR) AS store_id,
  'collector.sqlite3:sql_fact:' || fk AS external_id, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS occurred_at,
  'system_record' AS kind, 1.0::DOUBLE AS confidence, fk AS fact_key, l_linestatus AS fact_type,
  'P' || CAST(l_partkey AS VARCHAR) AS product_sku, l_quantity AS quantity,
  substr(sha256(CASE WHEN l_orderkey = 0 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END || '|' ||
                CASE WHEN l_linenumber = 0 THEN '' ELSE CAST(l_linenumber AS VARCHAR) END), 1, 16) AS source_record_hash
  FROM (SELECT *, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR)
                  || '-' || CAST(l_suppkey AS VARCHAR) || '-' || CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR)
                  || '-' || CAST(CAST(floor(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS fk FROM lineitem)"""
ORACLES["scan_system_facts"] = FACTS_SQL

ORACLES["camera_registry"] = """
WITH s AS (SELECT s_suppkey AS k, 'sup_' || CAST(s_suppkey AS VARCHAR) AS store_id FROM supplier),
docs AS (SELECT store_id, 'a_device.json' AS doc_path, CAST(k % 4 AS INTEGER) AS n,
                CAST(k % 4 AS INTEGER) + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS score FROM s
         UNION ALL
         SELECT store_id, 'b_config.json', CAST(k % 3 AS INTEGER), CAST(k % 3 AS INTEGER) + 1 FROM s),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY score DESC, doc_path) AS rn
                        FROM docs WHERE n > 0) WHERE rn = 1)
SELECT store_id, doc_path, score, CAST(i - 1 AS INTEGER) AS position, 'CH' || CAST(i AS VARCHAR) AS channel,
       'cam' || CAST(i AS VARCHAR) AS name, (['receiving', 'shelf', 'godown'])[i % 3 + 1] AS role,
       i % 2 = 0 AS enabled, NULL::BOOLEAN AS entry_counter
FROM best, generate_series(1, n) AS t(i)"""

ORACLES["detect_event_tables"] = "WITH " + CAT_CTES.strip() + """
SELECT store_id, source, "table", max(row_count) AS row_count FROM fx_cat
GROUP BY 1, 2, 3
HAVING bool_or(contains(normalized, 'camera') OR contains(normalized, 'channel') OR contains(normalized, 'snapshot')
               OR contains(normalized, 'detector'))
   AND bool_or(contains(normalized, 'startedat') OR contains(normalized, 'endedat') OR contains(normalized, 'occurredat')
               OR contains(normalized, 'eventid'))"""

_KEEP = "store_id, external_id, occurred_at, kind, confidence"
ORACLES["merge_ordered"] = (f"SELECT {_KEEP} FROM ({CAMERA_SQL}) UNION ALL SELECT {_KEEP} FROM ({LABELS_SQL}) "
                            f"UNION ALL SELECT {_KEEP} FROM ({FACTS_SQL})")


def _drops(where: str) -> str:
    return f"""SELECT 'store ' || CAST(user_id % 4 AS VARCHAR) AS store_id, 'feed_' || event_type AS connector, dayofyear(ts) // 7 AS seq,
  CAST(event_id AS VARCHAR) AS external_id, strftime(ts, {_ISO}) AS occurred_at,
  CASE WHEN event_type IN ('view', 'click') THEN 'observation' ELSE 'system_record' END AS kind, value / 100 AS confidence,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, event_id AS lot_no
FROM events {where}"""


ORACLES["collector_source"] = _drops("WHERE user_id % 4 IN (1, 3) AND event_type IN ('view', 'click')")
ORACLES["collector_source_stream"] = _drops("")
ORACLES["payload_facts"] = f"""
SELECT 'evt_' || sha256('evd_' || sha256('store ' || CAST(user_id % 4 AS VARCHAR) || '|feed_' || event_type || '|' || CAST(event_id AS VARCHAR))) AS id,
       'store ' || CAST(user_id % 4 AS VARCHAR) AS store_id, 'sale' AS event_type, strftime(ts, {_ISO}) AS occurred_at,
       'SKU-' || CAST(user_id AS VARCHAR) AS product_id, value AS quantity, event_id AS lot_no, 'k,lot' AS unknown_keys
FROM events"""
