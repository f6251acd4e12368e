"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from skein.plans import contract_queries, operator_queries, pipeline_queries, reward_queries, scalar_queries, selection_queries, source_queries, windows_queries

_MODULES = [windows_queries, scalar_queries, operator_queries, pipeline_queries, reward_queries, selection_queries, contract_queries, source_queries]


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
