"""Registered queries of the extension surface."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from storelens import extensions as ext
from storelens.plans.queries import register
from storelens.session import ensure_checkpoint_dir
from storelens.sources import collector_fixture as cfx
from storelens.sources import collectors as col
from storelens.sources import fixtures as fx

_KEEP = ["store_id", "connector", "external_id", "occurred_at", "kind", "confidence"]


@register("register_evidence_source")
def q_register_evidence_source(spark, sf_dir):
    ext.clear_evidence_sources()
    ext.register_evidence_source("local_camera_events", lambda s: col.scan_camera_events(
        cfx.fx_camera_tables(s, sf_dir)))
    ext.register_evidence_source("local_verified_labels", lambda s: col.scan_verified_labels(
        cfx.fx_verified_labels(s, sf_dir)))
    ext.register_evidence_source("local_sql_facts", lambda s: col.scan_system_facts(cfx.fx_sql_facts(s, sf_dir)))
    return ext.poll_all(spark).select(*_KEEP)


@register("mapping_provider")
def q_mapping_provider(spark, sf_dir):
    from storelens.operators import catalog as co
    from storelens.sources import catalog_fixture as cf

    cat, stores = cf.fx_catalog(spark, sf_dir), cf.fx_stores(spark, sf_dir)
    m = co.propose_mappings(co.score_mappings(cat), stores, provider=ext.last_candidate_provider())
    return m.select("store_id", "canonical_field", "source_path", F.col("confidence").cast("double").alias("confidence"),
                    "reasoning", "verified")


def _large_receipt_rule():
    from storelens.operators.workflows import WorkflowRule

    return {"receiving": [WorkflowRule(F.col("facts.quantity") > 40, "manager", "Approve this large receipt.",
                                       "Quantity above the review threshold.", official=True)]}


@register("workflow_rules")
def q_workflow_rules(spark, sf_dir):
    from storelens.operators.workflows import evaluate_workflows

    _, tasks = evaluate_workflows(fx.fx_facts(spark, sf_dir), ext.with_rules(_large_receipt_rule()))
    return tasks.drop("answer")


@register("task_sink")
def q_task_sink(spark, sf_dir):
    from storelens.operators.workflows import evaluate_workflows

    _, tasks = evaluate_workflows(fx.fx_facts(spark, sf_dir))
    path = os.path.join(ensure_checkpoint_dir(spark), "task_sink", uuid.uuid4().hex)
    tasks = tasks.drop("answer")
    for _ in range(2):  # the second is a retry of the first
        ext.deliver_tasks(tasks, path)
    return spark.read.schema(tasks.schema).parquet(path).select(*tasks.columns)
