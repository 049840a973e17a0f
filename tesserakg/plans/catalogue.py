"""All queries of the core and their SQL."""

from __future__ import annotations

from tesserakg.plans import candidate_queries, cluster_queries, dataset_queries, function_queries, kg_queries, record_queries

MODULES = [record_queries, kg_queries, candidate_queries, dataset_queries, cluster_queries, function_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
