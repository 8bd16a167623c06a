"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from suite.views import Fixtures, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RAW_ORACLES: dict[str, str] = {}  # before the views are added


def query(name: str, oracle: str | None = None):
    """Register ``fn(fixtures) -> DataFrame`` under ``name`` with an optional oracle."""

    def register(fn: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixtures(spark, sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            RAW_ORACLES[name] = oracle
            ORACLES[name] = with_views(oracle)
        return fn

    return register
