"""Registered queries over the given tables, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.catalog import ledger_queries, record_queries  # noqa: F401  (register on import)
from tallyspark.catalog.registry import ORACLES, QUERIES, Query, flat, staged


def _bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: flat(fn(staged(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(fn) for name, fn in sorted(QUERIES.items())}


def oracle_sql() -> dict[str, str]:
    return dict(sorted(ORACLES.items()))
