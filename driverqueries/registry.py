"""Registration of queries with their check SQL, and a comparison of both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driverqueries.adapters import Inputs, with_adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``key`` with its DuckDB text."""
    def register(fn: Callable[[Inputs], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir))

        run.__name__ = key
        QUERIES[key] = run
        if sql is not None:
            CHECKS[key] = with_adapters(sql)
        return fn

    return register
