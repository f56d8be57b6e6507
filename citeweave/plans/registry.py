"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeweave.plans.fixtures import Inputs, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of Inputs under its name, and the SQL that returns the same rows (none: not expressible)."""

    def register(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if sql:
            ORACLES[build.__name__] = with_fixtures(sql)
        return build

    return register
