"""All registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from normwerk.plans import corpus_queries, review_queries, search_queries, source_queries, traffic_queries

_MODULES = (search_queries, traffic_queries, corpus_queries, review_queries, source_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
