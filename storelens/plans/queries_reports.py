"""Registered report, artifact, status and awareness queries."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from storelens.plans import reports as rp
from storelens.plans.queries import _channels, _events_with_status, _mappings, _questions, register
from storelens.session import ensure_checkpoint_dir
from storelens.sources import fixtures as fx


@register("exception_report")
def q_exception_report(spark, sf_dir):
    return rp.exception_report(_events_with_status(spark, sf_dir))


@register("store_report_lines")
def q_store_report_lines(spark, sf_dir):
    cat, stores, contracts, scores, mappings = _mappings(spark, sf_dir)
    return rp.mapping_lines(mappings).unionByName(rp.readiness_lines(mappings, stores))


@register("store_snapshot_lines")
def q_store_snapshot_lines(spark, sf_dir):
    from storelens.plans.queries import q_operational_snapshot, q_proof_state_counts

    return rp.snapshot_lines(q_operational_snapshot(spark, sf_dir)).unionByName(
        rp.proof_state_lines(q_proof_state_counts(spark, sf_dir)))


@register("write_artifacts")
def q_write_artifacts(spark, sf_dir):
    from storelens.operators.proofs import operation_proofs, proofs_report

    proofs = proofs_report(operation_proofs(
        fx.fx_op_event(spark, sf_dir), fx.fx_all_evidence(spark, sf_dir), fx.fx_task(spark, sf_dir), 15))
    path = os.path.join(ensure_checkpoint_dir(spark), "artifacts", os.path.basename(sf_dir.rstrip("/")), "proofs")
    rp.write_artifacts(proofs, path)
    return spark.read.schema(proofs.schema).json(path)


@register("store_status")
def q_store_status(spark, sf_dir):
    from storelens.plans.queries_state import fx_actions

    req, _ = fx_actions(spark, sf_dir)
    return rp.store_status(_questions(spark, sf_dir)[1], fx.fx_task(spark, sf_dir), fx.fx_op_event(spark, sf_dir),
                           fx.fx_all_evidence(spark, sf_dir), req)


@register("attention_items")
def q_attention_items(spark, sf_dir):
    from storelens.plans.queries import q_operational_snapshot

    return q_operational_snapshot(spark, sf_dir).select("store_id", "attention")


@register("store_awareness")
def q_store_awareness(spark, sf_dir):
    from storelens.operators import catalog as co
    from storelens.sources import catalog_fixture as cf

    cat, stores, contracts = cf.fx_catalog(spark, sf_dir), cf.fx_stores(spark, sf_dir), cf.fx_contracts(spark, sf_dir)
    cands = co.role_candidates(co.score_table_roles(cat))
    caps = co.capabilities(cands, contracts, stores)
    return rp.store_awareness(cat, cands, cf.fx_declared_relationships(spark, sf_dir),
                              co.infer_relationships(cands, cat), caps, _channels(spark, sf_dir))


@register("rank_collectors")
def q_rank_collectors(spark, sf_dir):
    from storelens.operators.catalog import rank_collectors
    from storelens.sources.collector_fixture import fx_camera_configs
    from storelens.sources.collectors import CONFIG_SCHEMA
    from storelens.sources.tables import table

    docs = fx_camera_configs(spark, sf_dir)
    ch = docs.select("store_id", F.col("doc_path").alias("root"), F.explode(F.filter(
        F.from_json("doc", CONFIG_SCHEMA)["cameras"], lambda c: c["channel"].isNotNull())).alias("c"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    et = s.select(F.concat(F.lit("sup_"), F.col("s_suppkey").cast("string")).alias("store_id"),
                  F.explode(F.array(
                      F.struct(F.lit("a_device.json").alias("root"), (F.col("s_suppkey") % 2).alias("n")),
                      F.struct(F.lit("b_config.json").alias("root"), (F.col("s_suppkey") % 5).alias("n")))).alias("x"))
    n = F.col("x.n")
    et = et.select("store_id", "x.root", F.explode(
        F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    ).alias("t"))
    return rank_collectors(ch, et).select("store_id", "root", "camera_channels", "event_tables", "score", "eligible",
                                          "selected")
