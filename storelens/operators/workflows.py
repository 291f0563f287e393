"""Rule evaluation: events -> role-routed verification tasks.

Each event type is a list of rules ``(condition, role, question, reason,
official)`` over the typed ``facts`` struct.  Evaluation is one projection to
``array<struct>`` (null entries dropped) followed by ``posexplode``; there is no
Python on the row path.  Users add rules with ``WorkflowRule`` Column
expressions (the ``workflow_rules`` extension point).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.cache import session_cached
from storelens.functions.scalar import falsy_bool, falsy_num, falsy_str, fmt_number
from storelens.schemas import ANSWER, EVENT_TYPES, FACT_TYPES


@dataclass(frozen=True)
class WorkflowRule:
    condition: Column
    role: Column | str
    question: Column | str
    reason: str
    official: bool = False


def _f(name: str) -> Column:
    return F.col("facts").getField(name)


def _lit(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# ---------------------------------------------------------------------------
# Fixed rule texts (questions, reasons, summaries) of the nine workflows.
# ---------------------------------------------------------------------------
@session_cached
def default_rules() -> dict[str, list[WorkflowRule]]:
    sent, received = _f("sent_quantity"), _f("received_quantity")
    expected, counted = _f("expected_quantity"), _f("counted_quantity")
    return {
        "receiving": [
            WorkflowRule(_f("mapping_verified").eqNullSafe(False), "manager",
                         "Confirm the discovered product and quantity mapping for this source.",
                         "The transaction is real, but its newly discovered schema meaning is not yet human-confirmed."),
            WorkflowRule(falsy_str(_f("product_id")), "data_entry_operator",
                         "Which SKU was received?", "Receiving evidence has no verified product identity."),
            WorkflowRule(_f("cartons").isNotNull() & falsy_num(_f("pack_size")), "data_entry_operator",
                         "What is the verified pieces-per-carton pack size?",
                         "Cartons cannot become base units without pack size."),
            WorkflowRule(falsy_str(_f("destination_id")), "data_entry_operator",
                         "Which godown or shelf received this product?", "Purchase entry has no physical destination."),
            WorkflowRule(falsy_bool(_f("receiver_confirmed")),
                         F.when(_f("destination_type") == "shelf", "shelfer").otherwise("godown_staff"),
                         "Confirm the quantity actually received at your location.",
                         "DEO entry is not yet corroborated by the receiver.", official=True),
        ],
        "stock_movement": [
            WorkflowRule(falsy_str(_f("from_location")) | falsy_str(_f("to_location")), "godown_staff",
                         "Confirm both source and destination locations.", "Movement route is incomplete."),
            WorkflowRule(sent.isNull(), "godown_staff",
                         "How many base units left the source location?", "Movement has no sender quantity."),
            WorkflowRule(received.isNull(), "shelfer",
                         "How many base units arrived at the shelf?", "Movement has no receiver confirmation.",
                         official=True),
            WorkflowRule(received.isNotNull() & sent.isNotNull() & (sent != received), "manager",
                         F.concat(F.lit("Resolve movement mismatch: sent "), fmt_number(sent),
                                  F.lit(", received "), fmt_number(received), F.lit(".")),
                         "Sender and receiver records conflict.", official=True),
        ],
        "damage": [
            WorkflowRule(falsy_num(_f("quantity")), "godown_staff",
                         "Count the damaged base units.", "Damage observation has no verified quantity."),
            WorkflowRule(falsy_bool(_f("human_confirmed")), "manager",
                         "Review and approve this damage adjustment.",
                         "Camera or staff observation cannot alter stock by itself.", official=True),
        ],
        "expiry": [
            WorkflowRule(falsy_bool(_f("human_confirmed")), "manager",
                         "Confirm the batch, expiry date, quantity, and disposition.",
                         "Expiry requires a traceable human decision.", official=True),
        ],
        "attendance": [
            WorkflowRule(falsy_str(_f("staff_id")) & falsy_str(_f("badge_id")), "manager",
                         "Identify this attendance observation using an approved badge or staff record.",
                         "Uniform/camera evidence alone is not official attendance."),
            WorkflowRule((_f("source") == "camera") & falsy_bool(_f("human_confirmed")), "manager",
                         "Confirm attendance before recording it officially.",
                         "Camera presence is supporting evidence only.", official=True),
        ],
        "sale": [
            WorkflowRule(_f("mapping_verified").eqNullSafe(False), "manager",
                         "Confirm the discovered sale-line mapping for this source.",
                         "The POS row is real, but its newly discovered schema meaning is not yet human-confirmed."),
            WorkflowRule(falsy_str(_f("product_id")) | _f("quantity").isNull(), "data_entry_operator",
                         "Repair the sale line with a product and base-unit quantity.",
                         "POS sale record is incomplete."),
            WorkflowRule(_f("stock_after").isNotNull() & (_f("stock_after") < 0), "shelfer",
                         "Recount shelf stock for this SKU.", "The recorded sale produced negative stock."),
        ],
        "purchase": [
            WorkflowRule(_f("cartons").isNotNull() & falsy_num(_f("pack_size")), "data_entry_operator",
                         "Confirm pack size for this purchase line.", "Carton quantity is ambiguous."),
        ],
        "return": [
            WorkflowRule(falsy_bool(_f("approved")), "manager",
                         "Approve the return and its stock effect.", "Returns change official stock and value.",
                         official=True),
        ],
        "stock_count": [
            WorkflowRule(counted.isNull(), "godown_staff",
                         "Count this SKU in base units.", "No physical count was recorded."),
            WorkflowRule(counted.isNotNull() & expected.isNotNull() & (counted != expected), "manager",
                         F.concat(F.lit("Review stock variance: system "), fmt_number(expected),
                                  F.lit(", physical "), fmt_number(counted), F.lit(".")),
                         "Physical count conflicts with the system record.", official=True),
        ],
    }


# (summary when no task, summary when tasks; '{n}' is the task count)
SUMMARIES = {
    "receiving": ("Receiving reconciled", "Receiving needs {n} verification step(s)"),
    "stock_movement": ("Stock movement reconciled", "Stock movement needs {n} verification step(s)"),
    "damage": ("Damage verified", "Damage needs {n} verification step(s)"),
    "expiry": ("Expiry verified", "Expiry needs manager verification"),
    "attendance": ("Attendance corroborated", "Attendance needs {n} verification step(s)"),
    "sale": ("Sale reconciled", "Sale needs {n} verification step(s)"),
    "purchase": ("Purchase normalized", "Purchase needs pack conversion"),
    "return": ("Return approved", "Return awaits approval"),
    "stock_count": ("Stock count reconciled", "Stock count needs {n} verification step(s)"),
}
UNSUPPORTED_TEXT = ("manager", "Review this unsupported operational event.",
                    "No approved workflow is configured for this event type.")
UNSUPPORTED_SUMMARY = "Unsupported event routed to manager"
# ---------------------------------------------------------------------------

TASK_FIELDS = ("role", "question", "reason", "required_authority")


def conform_facts(events: DataFrame) -> DataFrame:
    """Make ``facts`` carry the full closed fact set (missing keys -> null)."""
    if "facts" not in events.columns:
        present: set[str] = set()
    else:
        present = {f.name for f in events.schema["facts"].dataType.fields}
    fields = [
        (F.col("facts").getField(k).cast(t) if k in present else F.lit(None).cast(t)).alias(k)
        for k, t in FACT_TYPES.items()
    ]
    return events.withColumn("facts", F.struct(*fields))


def _rule_struct(rule: WorkflowRule) -> Column:
    authority = "official_record" if rule.official else "external_reversible"
    return F.when(
        rule.condition,
        F.struct(
            _lit(rule.role).alias("role"),
            _lit(rule.question).alias("question"),
            F.lit(rule.reason).alias("reason"),
            F.lit(authority).alias("required_authority"),
        ),
    )


def _task_array_for(rules: dict[str, list[WorkflowRule]]) -> Column:
    et = F.col("event_type")
    expr = None
    for etype, rs in rules.items():
        arr = F.filter(F.array(*[_rule_struct(r) for r in rs]), lambda x: x.isNotNull())
        expr = F.when(et == etype, arr) if expr is None else expr.when(et == etype, arr)
    return expr.otherwise(F.array(_rule_struct(WorkflowRule(F.lit(True), *UNSUPPORTED_TEXT))))


@session_cached
def _default_task_array() -> Column:
    return _task_array_for(default_rules())


def _task_array(rules) -> Column:
    return _default_task_array() if rules is None else _task_array_for(rules)


@session_cached
def _summary_default() -> Column:
    return _summary(F.size("_tasks"), SUMMARIES)


def summaries_for(rules: dict[str, list[WorkflowRule]], extra: dict[str, tuple[str, str]] | None = None) -> dict[str, tuple[str, str]]:
    """Summary texts of every event type in ``rules``: the given ones, else the fixed
    ones, else texts made from the type's name."""
    named = {t: (t.replace("_", " ").capitalize() + " reconciled", t.replace("_", " ").capitalize() + " needs {n} verification step(s)")
             for t in rules}
    return {t: ((extra or {}).get(t) or SUMMARIES.get(t) or named[t]) for t in rules}


def _summary(n: Column, texts: dict[str, tuple[str, str]]) -> Column:
    et = F.col("event_type")
    expr = None
    for etype, (clear, pending) in texts.items():
        if "{n}" in pending:
            head, tail = pending.split("{n}")
            pend = F.concat(F.lit(head), n.cast("string"), F.lit(tail))
        else:
            pend = F.lit(pending)
        val = F.when(n == 0, F.lit(clear)).otherwise(pend)
        expr = F.when(et == etype, val) if expr is None else expr.when(et == etype, val)
    return expr.otherwise(F.lit(UNSUPPORTED_SUMMARY))


def evaluate_workflows(
    events: DataFrame, rules: dict[str, list[WorkflowRule]] | None = None,
    summaries: dict[str, tuple[str, str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(events with status/summary/task_count, tasks).

    ``summaries`` gives (no task, tasks with {n}) texts of event types in ``rules``.

    status is ``verified`` without tasks, else ``needs_verification``; task ids
    are ``<event id>:<position>`` so reruns are idempotent.
    """
    staged = conform_facts(events)
    staged = staged.select(*staged.columns, _task_array(rules).alias("_tasks"))
    n = F.size("_tasks")
    evaluated = staged.select(
        *staged.columns,
        n.alias("task_count"),
        F.when(n == 0, F.lit("verified")).otherwise(F.lit("needs_verification")).alias("status"),
        (_summary_default() if rules is None else _summary(n, summaries_for(rules, summaries))).alias("summary"),
    )
    out_events = evaluated.drop("_tasks")
    tasks = evaluated.select(
        F.col("id").alias("related_event_id"), "store_id", "event_type", "occurred_at",
        F.posexplode("_tasks").alias("position", "t"),
    ).select(
        F.concat(F.col("related_event_id"), F.lit(":"), F.col("position").cast("string")).alias("id"),
        "store_id",
        "related_event_id",
        "event_type",
        "position",
        *[F.col("t").getField(f).alias(f) for f in TASK_FIELDS],
        F.lit("open").alias("status"),
        F.lit(None).cast(ANSWER).alias("answer"),
        F.col("occurred_at").alias("created_at"),
    )
    return out_events, tasks


def workflow_tasks(events: DataFrame, event_type: str | None = None) -> DataFrame:
    """Tasks of one event type's workflow (or all when ``event_type`` is None)."""
    if event_type is not None and event_type not in EVENT_TYPES and event_type != "unsupported":
        raise ValueError(f"unknown event type {event_type}")
    _, tasks = evaluate_workflows(events)
    if event_type == "unsupported":
        return tasks.where(~F.col("event_type").isin(*EVENT_TYPES) | F.col("event_type").isNull())
    return tasks if event_type is None else tasks.where(F.col("event_type") == event_type)
