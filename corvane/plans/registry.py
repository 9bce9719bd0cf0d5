"""All queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from . import queries_graph, queries_ops, queries_paths, queries_rank, queries_rules, queries_selection, queries_stages

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (queries_rank, queries_graph, queries_ops, queries_paths, queries_rules, queries_selection, queries_stages):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.SQL


def flagship(spark, sf_dir):
    """The stemmed fielded ranking."""
    return QUERIES["fielded_rank"](spark, sf_dir)
