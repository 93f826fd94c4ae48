"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.plans import archive_queries, named_queries, orphan_queries, text_queries

_PARTS = [archive_queries, named_queries, text_queries, orphan_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for p in _PARTS for k, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in _PARTS for k, s in p.SQL.items()}


def flagship(spark: SparkSession, data: str) -> DataFrame:
    return archive_queries.flagship(spark, data)
