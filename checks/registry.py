"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.tables import comparable
from faultline.session import require_settings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; ``sql`` is its DuckDB form, if it has one."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            require_settings(spark)
            return comparable(build(spark, sf_dir))

        name = build.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
