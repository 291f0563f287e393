"""DuckDB oracles of the state-fold and health queries."""

from storelens.oracle_sql import with_fx
from storelens.plans.oracles import ORACLES
from storelens.plans.oracles_catalog import CAT_CTES

ANSWERS_CTE = """
answers AS (
  SELECT 'ans_' || CAST(n AS VARCHAR) || '_a' AS answer_id, store_id, 'task_' || CAST(n AS VARCHAR) AS task_id,
         occurred_at AS answered_at, CASE WHEN n % 2 = 0 THEN 'yes' ELSE 'no' END AS confirmed FROM fx_op_event WHERE n % 4 <> 0
  UNION ALL
  SELECT 'ans_' || CAST(n AS VARCHAR) || '_b', store_id, 'task_' || CAST(n AS VARCHAR), occurred_at || 'x', 'no'
  FROM fx_op_event WHERE n % 8 = 1
  UNION ALL
  SELECT 'ans_' || CAST(n AS VARCHAR) || '_c', store_id, 'task_missing_' || CAST(n AS VARCHAR), occurred_at, 'yes'
  FROM fx_op_event WHERE n % 10 = 3),
ranked AS (
  SELECT a.*, row_number() OVER (PARTITION BY a.store_id, a.task_id ORDER BY a.answered_at, a.answer_id) AS rn,
         t.id IS NOT NULL AS is_open
  FROM answers a LEFT JOIN fx_task t ON t.id = a.task_id AND t.store_id = a.store_id AND t.status = 'open'),
accepted AS (SELECT * FROM ranked WHERE is_open AND rn = 1)"""

ORACLES["answer_tasks"] = with_fx(["fx_task"], """
SELECT t.id, t.store_id, CASE WHEN a.task_id IS NOT NULL THEN 'answered' ELSE t.status END AS status,
       CASE WHEN a.task_id IS NOT NULL THEN a.confirmed ELSE t.answer_confirmed END AS answer_confirmed,
       CASE WHEN a.task_id IS NOT NULL THEN 'evd_' || sha256(a.store_id || '|' || a.answer_id) ELSE t.answer_evidence_id END
         AS answer_evidence_id,
       a.answered_at
FROM fx_task t LEFT JOIN accepted a ON a.task_id = t.id AND a.store_id = t.store_id""", [ANSWERS_CTE])

ORACLES["answer_tasks_rejected"] = with_fx(["fx_task"], """
SELECT answer_id, store_id, task_id,
       CASE WHEN NOT is_open THEN 'unknown_or_not_open_task' ELSE 'task_already_answered' END AS reason
FROM ranked WHERE NOT is_open OR rn > 1""", [ANSWERS_CTE])

ORACLES["answer_tasks_evidence"] = with_fx(["fx_task"], """
SELECT 'evd_' || sha256(store_id || '|' || answer_id) AS id, store_id, 'human_confirmation' AS kind, 'gateway' AS source,
       1.0::DOUBLE AS confidence, answered_at AS occurred_at,
       '{"task_id":"' || task_id || '","answer":{"confirmed":"' || confirmed || '"}}' AS payload
FROM accepted""", [ANSWERS_CTE])

_ANSWERED = "WITH " + CAT_CTES.strip() + """,
ans AS (
  SELECT q.store_id, q.key, split_part(q.key, ':', 2) AS canonical_field, split_part(q.key, ':', 1) AS kind,
         m.source_path AS cur,
         CASE WHEN q.key LIKE 'verify:%' THEN
                CASE CAST(substr(q.store_id, 5) AS BIGINT) % 4 WHEN 0 THEN 'yes' WHEN 1 THEN m.source_path
                     WHEN 2 THEN 'corrected.table.column' ELSE 'none_of_these' END
              WHEN CAST(substr(q.store_id, 5) AS BIGINT) % 2 = 0 THEN 'shop_export.ItemMaster.ItemCode' ELSE 'nodot' END AS answer
  FROM questions q LEFT JOIN mappings m ON m.store_id = q.store_id AND 'verify:' || m.canonical_field = q.key),
outcome AS (
  SELECT *, CASE WHEN kind = 'verify' AND cur IS NOT NULL AND (lower(answer) IN ('yes', 'true') OR answer = cur) THEN 'verified'
                 WHEN kind = 'verify' AND cur IS NOT NULL AND contains(answer, '.') AND answer <> 'none_of_these' THEN 'corrected'
                 WHEN kind = 'map' AND contains(answer, '.') AND answer <> 'none_of_these' THEN 'mapped'
                 ELSE 'rejected' END AS o
  FROM ans),
good AS (SELECT * FROM outcome WHERE o <> 'rejected')
"""

ORACLES["answer_questions_resolved"] = _ANSWERED + """
SELECT q.store_id, q.key, g.key IS NOT NULL AS resolved, g.answer
FROM questions q LEFT JOIN good g ON g.store_id = q.store_id AND g.key = q.key"""

ORACLES["answer_questions_rejected"] = _ANSWERED + """
SELECT store_id, key, answer, 'owner' AS actor FROM outcome WHERE o = 'rejected'"""

ORACLES["answer_questions"] = _ANSWERED + """
SELECT coalesce(m.store_id, g.store_id) AS store_id, coalesce(m.canonical_field, g.canonical_field) AS canonical_field,
       CASE WHEN g.o IS NULL THEN m.source_path WHEN g.o = 'verified' THEN g.cur ELSE g.answer END AS source_path,
       CASE WHEN g.o IN ('corrected', 'mapped') THEN 1.0 ELSE CAST(m.confidence AS DOUBLE) END AS confidence,
       CASE WHEN g.o IS NOT NULL THEN true ELSE m.verified END AS verified
FROM mappings m FULL OUTER JOIN good g ON g.store_id = m.store_id AND g.canonical_field = m.canonical_field"""

ACTIONS_CTE = """
req AS (
  SELECT 'act_' || CAST(event_id AS VARCHAR) AS id, 'store_' || CAST(user_id % 4 AS VARCHAR) AS store_id,
         (['open_drawer', 'restart_camera', 'write_stock'])[event_id % 3 + 1] AS action,
         'target_' || CAST(user_id % 5 AS VARCHAR) AS target,
         (['observe','local_work','external_reversible','system_change','official_record','prohibited'])[event_id % 6 + 1] AS authority,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS requested_at, event_id AS n
  FROM events WHERE event_type = 'error'),
base AS (
  SELECT *, CASE WHEN authority = 'prohibited' THEN 'denied' WHEN authority IN ('observe', 'local_work') THEN 'allowed'
                 ELSE 'pending_approval' END AS initial_status FROM req),
dec AS (
  SELECT id AS action_id, 'approve' AS decision, 'boss' AS actor, requested_at || 'a' AS decided_at, n, store_id FROM req WHERE n % 4 <= 1
  UNION ALL SELECT id, 'approve', 'boss3', requested_at || 'a', n, store_id FROM req WHERE n % 16 = 0
  UNION ALL SELECT id, 'execute', 'executor', requested_at || 'b', n, store_id FROM req WHERE n % 4 = 0
  UNION ALL SELECT id, 'execute', 'executor', requested_at || 'b', n, store_id FROM req WHERE n % 4 = 2
  UNION ALL SELECT id, 'approve', 'boss2', requested_at || 'c', n, store_id FROM req WHERE n % 8 = 0),
ordered AS (
  SELECT d.action_id, d.decision, d.actor, d.decided_at,
         CASE WHEN d.n % 12 = 1 THEN NULL ELSE b.initial_status END AS initial_status,
         row_number() OVER (PARTITION BY d.action_id ORDER BY d.decided_at, d.decision, d.actor) AS rn
  FROM dec d JOIN base b ON b.id = d.action_id),
appr AS (
  SELECT action_id, arg_min(actor, rn) AS approved_by, arg_min(decided_at, rn) AS approved_at, min(rn) AS rn FROM ordered
  WHERE decision = 'approve' AND initial_status IN ('pending_approval', 'allowed') GROUP BY 1),
exe AS (
  SELECT o.action_id, arg_min(o.decided_at, o.rn) AS executed_at, min(o.rn) AS rn FROM ordered o JOIN appr a ON a.action_id = o.action_id
  WHERE o.decision = 'execute' AND o.rn > a.rn GROUP BY 1),
actions AS (
  SELECT b.id, b.store_id, b.action, b.target, b.authority, b.requested_at, b.initial_status,
         CASE WHEN e.executed_at IS NOT NULL THEN 'executed' WHEN a.approved_at IS NOT NULL THEN 'approved'
              ELSE b.initial_status END AS status, a.approved_by, a.approved_at, e.executed_at
  FROM base b LEFT JOIN appr a ON a.action_id = b.id LEFT JOIN exe e ON e.action_id = b.id)"""

ORACLES["action_status"] = f"""WITH {ACTIONS_CTE.strip()}
SELECT id, store_id, authority, initial_status, status, approved_by, approved_at, executed_at FROM actions"""

ORACLES["action_status_rejected"] = f"""WITH {ACTIONS_CTE.strip()}
SELECT o.action_id, o.decision, o.actor, o.decided_at,
       CASE WHEN o.initial_status IS NULL THEN 'unknown_action' WHEN o.initial_status = 'denied' THEN 'prohibited_action'
            ELSE 'illegal_transition' END AS reason
FROM ordered o LEFT JOIN appr a ON a.action_id = o.action_id LEFT JOIN exe e ON e.action_id = o.action_id
WHERE o.rn IS DISTINCT FROM a.rn AND o.rn IS DISTINCT FROM e.rn"""

ORACLES["open_action_dedupe"] = f"""WITH {ACTIONS_CTE.strip()},
new AS (SELECT 'new_' || id AS id, store_id, action, 'target_' || CAST(n % 7 AS VARCHAR) AS target, authority, requested_at || 'z' AS requested_at
        FROM req WHERE n % 5 = 0),
fresh AS (SELECT * FROM new n WHERE NOT EXISTS (
  SELECT 1 FROM actions a WHERE a.status IN ('pending_approval', 'approved', 'allowed')
    AND a.store_id = n.store_id AND a.action = n.action AND a.target = n.target))
SELECT id, store_id, action, target, authority, requested_at FROM (
  SELECT *, row_number() OVER (PARTITION BY store_id, action, target ORDER BY requested_at, id) AS rn FROM fresh)
WHERE rn = 1"""

ORACLES["collector_health"] = """
WITH nowc AS (SELECT epoch_us(max(ts)) AS now_us FROM events),
hb AS (
  SELECT 'hb_' || CAST(user_id AS VARCHAR) AS store_id,
         arg_max(lower((['RUNNING', 'stopped', 'error', 'starting'])[event_id % 4 + 1]), epoch_us(ts)) AS status,
         arg_max((['running', 'running', 'offline'])[event_id % 3 + 1], epoch_us(ts)) AS camera_status,
         max(epoch_us(ts)) AS hb_us
  FROM events WHERE event_type = 'error' GROUP BY 1),
le AS (SELECT 'hb_' || CAST(user_id AS VARCHAR) AS store_id, max(epoch_us(ts)) AS ev_us
       FROM events WHERE event_type = 'view' GROUP BY 1),
j AS (
  SELECT coalesce(hb.store_id, le.store_id) AS store_id, hb.status, hb.camera_status, hb.hb_us IS NOT NULL AS has_hb,
         (SELECT now_us FROM nowc) - hb.hb_us AS hb_age, (SELECT now_us FROM nowc) - le.ev_us AS ev_age
  FROM hb FULL OUTER JOIN le ON hb.store_id = le.store_id)
SELECT store_id,
  CASE WHEN hb_age IS NOT NULL AND hb_age <= 180000000 AND coalesce(status, 'unknown') = 'running'
            AND coalesce(camera_status, 'unknown') = 'running' THEN 'running'
       WHEN hb_age IS NOT NULL AND hb_age > 180000000 THEN 'stale_heartbeat'
       WHEN has_hb AND coalesce(status, 'unknown') IN ('stopped', 'error') THEN 'not_running'
       WHEN ev_age IS NOT NULL AND ev_age > 180000000 THEN 'stale_event_store'
       ELSE 'unmonitored' END AS state,
  coalesce(status, 'unknown') AS collector_status, coalesce(camera_status, 'unknown') AS camera_status,
  CASE WHEN has_hb THEN 'ok' ELSE 'unknown' END AS sql_status,
  hb_age / 1000000.0::DOUBLE AS heartbeat_age_seconds, ev_age / 1000000.0::DOUBLE AS event_store_age_seconds,
  (hb_age IS NOT NULL AND hb_age <= 180000000 AND coalesce(status, 'unknown') = 'running'
   AND coalesce(camera_status, 'unknown') = 'running') AS live_camera_ready
FROM j"""

ORACLES["cycle_health"] = """
WITH log AS (
  SELECT 'store_' || CAST(user_id % 4 AS VARCHAR) AS store_id, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H') AS cycle_id,
         CASE event_type WHEN 'purchase' THEN 'import' WHEN 'signup' THEN 'primed' WHEN 'view' THEN 'event'
              WHEN 'error' THEN 'error' ELSE 'other' END AS kind,
         (['sql', 'camera_runtime', 'snapshot'])[event_id % 3 + 1] AS component
  FROM events),
g AS (
  SELECT store_id, cycle_id, CAST(sum(CASE WHEN kind = 'import' THEN 1 ELSE 0 END) AS BIGINT) AS imported,
         CAST(sum(CASE WHEN kind = 'primed' THEN 1 ELSE 0 END) AS BIGINT) AS primed,
         CAST(sum(CASE WHEN kind = 'event' THEN 1 ELSE 0 END) AS BIGINT) AS events_created,
         CAST(sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS error_count
  FROM log GROUP BY 1, 2),
e AS (
  SELECT store_id, cycle_id, string_agg(component || '=' || CAST(n AS VARCHAR), ', ' ORDER BY component, n) AS errors
  FROM (SELECT store_id, cycle_id, component, count(*) AS n FROM log WHERE kind = 'error' GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT g.*, coalesce(e.errors, '') AS errors, g.error_count = 0 AS healthy
FROM g LEFT JOIN e ON e.store_id = g.store_id AND e.cycle_id = g.cycle_id"""

ORACLES["rescan_due"] = """
SELECT 'cat_' || CAST(c_custkey AS VARCHAR) AS store_id, reason IS NOT NULL AS due, reason FROM (
  SELECT c.c_custkey,
    CASE WHEN c.c_custkey % 17 = 0 THEN 'forced'
         WHEN c.c_custkey % 29 = 0 THEN 'no_profile'
         WHEN c.c_custkey % 23 <> 0 AND o.last IS NULL THEN 'never_rescanned'
         WHEN c.c_custkey % 23 = 0 THEN 'unparseable_last_rescan'
         WHEN epoch_us(TIMESTAMP '2001-01-01 00:00:00') - epoch_us(o.last) >= 31536000000000 THEN 'interval_elapsed'
    END AS reason
  FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) o
    ON o.o_custkey = c.c_custkey)"""
