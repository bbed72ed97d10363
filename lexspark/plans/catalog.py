"""All queries of the core, by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexspark.plans import data_queries, maintenance, relational, retrieval

_MODULES = [data_queries, relational, retrieval, maintenance]


def flagship(spark: SparkSession, root: str) -> DataFrame:
    return data_queries.p4_found(spark, root)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out |= m.SQL
    return out
