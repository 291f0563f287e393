"""DuckDB oracles of the extension-surface queries."""

from storelens.oracle_sql import with_fx
from storelens.plans.oracles import _TASK_COLS, ORACLES, WF_RULES_SQL, wf_tasks_sql
from storelens.plans.oracles_catalog import CAT_CTES
from storelens.plans.oracles_sources import CAMERA_SQL, FACTS_SQL, LABELS_SQL

_K = "store_id, external_id, occurred_at, kind, confidence"
ORACLES["register_evidence_source"] = (
    f"SELECT {_K}, 'local_camera_events' AS connector FROM ({CAMERA_SQL}) "
    f"UNION ALL SELECT {_K}, 'local_verified_labels' FROM ({LABELS_SQL}) "
    f"UNION ALL SELECT {_K}, 'local_sql_facts' FROM ({FACTS_SQL})")

ORACLES["mapping_provider"] = "WITH " + CAT_CTES.strip() + """,
lastc AS (SELECT store_id, canonical_field, arg_max(path, rank) AS last_path FROM cands GROUP BY 1, 2)
SELECT p.store_id, p.canonical_field,
       CASE WHEN p.best_score < 0.80 THEN l.last_path ELSE p.best_path END AS source_path,
       CAST(CAST(round(CASE WHEN p.best_score < 0.80 THEN greatest(p.best_score, 0.70) ELSE p.best_score END, 2)
            AS DECIMAL(4,2)) AS DOUBLE) AS confidence,
       CASE WHEN p.best_score < 0.80 THEN 'Chosen by a custom provider.'
            ELSE 'Matched normalized column name and canonical vocabulary.' END AS reasoning,
       (CASE WHEN p.best_score < 0.80 THEN greatest(p.best_score, 0.70) ELSE p.best_score END) >= 0.95
         AND NOT coalesce(p.requires_confirmation, false) AS verified
FROM proposals0 p JOIN lastc l ON l.store_id = p.store_id AND l.canonical_field = p.canonical_field"""

_extra = ("receiving", "quantity > 40", "'manager'", "'Approve this large receipt.'",
          "Quantity above the review threshold.", True)
_rules = WF_RULES_SQL[:5] + [_extra] + WF_RULES_SQL[5:]
ORACLES["workflow_rules"] = with_fx(["fx_facts"], f"SELECT {_TASK_COLS} FROM wf_tasks", [wf_tasks_sql("fx_facts", _rules)])
ORACLES["task_sink"] = ORACLES["evaluate_workflows"]
