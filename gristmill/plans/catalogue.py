"""The catalogue of queries over the driver's tables."""

from __future__ import annotations

from gristmill.plans import bench_plans, conversation_plans, geometry_plans, io_plans, record_plans, sampling_plans, score_plans, sequence_plans, text_plans

GROUPS = (score_plans, text_plans, geometry_plans, sampling_plans, conversation_plans, sequence_plans, bench_plans, record_plans, io_plans)


def queries():
    return {name: q for g in GROUPS for name, q in g.QUERIES.items()}


def oracle_sql():
    return {name: sql for g in GROUPS for name, sql in g.ORACLE.items()}
