"""All registered queries of the library with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    from trackloom.plans import manifest_queries, signal_queries, similarity_queries, workflow_queries

    return similarity_queries, signal_queries, manifest_queries, workflow_queries


def queries() -> dict[str, Query]:
    return {name: query for module in _modules() for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, (_, sql) in module.QUERIES.items() if sql}
