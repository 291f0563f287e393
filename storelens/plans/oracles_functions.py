"""DuckDB oracles of the scalar-helper projections."""

from __future__ import annotations

from storelens.oracle_sql import with_fx
from storelens.plans.oracles import ORACLES, ratio4_sql

_ISO = "'%Y-%m-%dT%H:%M:%S.%f'"

ORACLES["normalize_name"] = "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS normalized FROM part"

ORACLES["parse_timestamp"] = f"""
SELECT event_id,
  CASE event_id % 12 WHEN 0 THEN strftime(ts, {_ISO}) WHEN 1 THEN strftime(ts, {_ISO}) || 'Z'
       WHEN 2 THEN strftime(ts + INTERVAL 330 MINUTE, {_ISO}) || '+05:30' WHEN 3 THEN strftime(ts, '%Y-%m-%d')
       WHEN 4 THEN strftime(ts, '%Y%m%dT%H%M%S') WHEN 6 THEN strftime(ts, '%H:%M:%S') WHEN 7 THEN strftime(ts, '%Y')
       WHEN 8 THEN strftime(ts, '%Y-%m') WHEN 9 THEN strftime(ts, '%G-W%V-%u') WHEN 10 THEN strftime(ts, '%Y-%m-%d %H:%M:%S,%g')
       WHEN 11 THEN strftime(ts, {_ISO}) || ' Europe/Paris' ELSE 'unknown' END AS text,
  CASE WHEN event_id % 12 IN (0, 1, 2) THEN epoch_us(ts) WHEN event_id % 12 IN (3, 9) THEN epoch_us(date_trunc('day', ts))
       WHEN event_id % 12 = 4 THEN epoch_us(date_trunc('second', ts))
       WHEN event_id % 12 = 10 THEN epoch_us(date_trunc('millisecond', ts)) END AS occurred_us
FROM events"""

ORACLES["compose_occurred_at"] = """
SELECT o_orderkey,
  CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:15:00'
       WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:15:00.123'
       WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '09:00:00' END AS occurred_at
FROM orders"""

ORACLES["to_number"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE v WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN q WHEN 3 THEN q || 'd' WHEN 4 THEN q || '.5F' WHEN 5 THEN q || '_000'
         WHEN 6 THEN q || 'e3' ELSE ' ' || printf('%.2f', l_extendedprice) || ' ' END AS text,
  CASE v WHEN 2 THEN CAST(q AS DOUBLE) WHEN 5 THEN CAST(q AS DOUBLE) * 1000 WHEN 6 THEN CAST(q AS DOUBLE) * 1000
         WHEN 7 THEN CAST(printf('%.2f', l_extendedprice) AS DOUBLE) END AS value
FROM (SELECT *, l_orderkey % 8 AS v, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q FROM lineitem)"""

ORACLES["record_hash16"] = """
SELECT l_orderkey, l_linenumber,
  substr(sha256(CASE WHEN l_orderkey = 0 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END || '|' ||
                CASE WHEN l_linenumber % 2 = 0 THEN '0' ELSE CAST(l_linenumber AS VARCHAR) END || '|' ||
                CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE CAST(l_orderkey % 3 AS VARCHAR) END || '|' ||
                CASE WHEN l_orderkey % 2 = 0 THEN 'true' ELSE '' END), 1, 16) AS hash16
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"""

ORACLES["record_hash20"] = """
SELECT l_orderkey, l_linenumber,
  substr(sha256('purchase|' || CAST(l_orderkey AS VARCHAR) || '|' ||
                coalesce(CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_linenumber AS VARCHAR) END, 'None')), 1, 20) AS hash20
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"""


def role_sql(x: str) -> str:
    base = f"translate(lower(trim(coalesce({x}, ''))), '- ', '__')"
    return f"""coalesce(nullif(CASE {base}
         WHEN 'staff' THEN 'shelfer' WHEN 'shelf_staff' THEN 'shelfer' WHEN 'shelf' THEN 'shelfer'
         WHEN 'godown' THEN 'godown_incharge' WHEN 'data_entry_operator' THEN 'deo'
         WHEN 'product_assistance' THEN 'product_manager' WHEN 'product_assistant' THEN 'product_manager'
         WHEN 'productmanager' THEN 'product_manager' WHEN 'purchase_accounts' THEN 'purchase_incharge'
         WHEN 'purchase_account' THEN 'purchase_incharge' ELSE {base} END, ''), 'unassigned')"""


ORACLES["normalize_role"] = f"""
SELECT c_custkey, raw, {role_sql('raw')} AS role
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0
        THEN (['staff', 'Shelf Staff', ' godown ', 'Data-Entry-Operator', '', 'ProductManager'])[c_custkey % 6 + 1]
        ELSE c_mktsegment END AS raw FROM customer)"""

_YES = "('yes','true','confirmed','verified','received','complete')"
_NO = "('no','false','rejected','mismatch','missing')"
ORACLES["confirmation_value"] = with_fx(["fx_task"], f"""
SELECT id AS task_id,
  coalesce(CASE WHEN lower(trim(answer_confirmed)) IN {_YES} THEN true WHEN lower(trim(answer_confirmed)) IN {_NO} THEN false END,
           CASE WHEN lower(trim(answer_received)) IN {_YES} THEN true WHEN lower(trim(answer_received)) IN {_NO} THEN false END)
  AS confirmation
FROM fx_task WHERE status = 'answered'""")

ORACLES["clamp_confidence"] = "SELECT event_id, least(greatest(value / 100 - 1, 0.0), 1.0) AS confidence FROM events"

ORACLES["ratio4"] = f"""
SELECT l_suppkey, n, d, {ratio4_sql('n', 'd')} AS ratio
FROM (SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n, count(*) AS d
      FROM lineitem GROUP BY l_suppkey)"""

ORACLES["json_value_type"] = """
SELECT event_id,
  CASE event_id % 4 WHEN 0 THEN json_extract_string(props, '$.k') WHEN 1 THEN 'true'
       WHEN 2 THEN json_extract_string(props, '$.k') || '.5' ELSE '"' || event_type || '"' END AS value,
  CASE event_id % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'boolean' WHEN 2 THEN 'number' ELSE 'string' END AS json_type
FROM events"""

ORACLES["base_units"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  l_quantity * l_linenumber + l_suppkey % 5 AS units,
  CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) * l_linenumber + l_suppkey % 5 AS units_from_text
FROM lineitem"""

_FMT = "(CASE WHEN quantity IS NULL THEN 'None' WHEN quantity = floor(quantity) THEN CAST(CAST(floor(quantity) AS BIGINT) AS VARCHAR) ELSE CAST(quantity AS VARCHAR) END)"
ORACLES["summarize_facts"] = with_fx(["fx_facts"], f"""
SELECT id, event_type || ': destination_id=' || coalesce(destination_id, 'None') || ', product_id=' ||
       coalesce(product_id, 'None') || ', quantity=' || {_FMT} || ', value=' || {_FMT.replace('quantity', '(quantity * 1234567.25)')} AS summary
FROM fx_facts""")
