"""Registry of queries: a Spark form for each, and a DuckDB text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .dialect import DUCK, SPARK
from .domain import duck_sql, run_sql, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def both(name: str, text: Callable) -> None:
    """A query whose SQL text is stated once for both dialects."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text(SPARK))
    ORACLES[name] = duck_sql(text(DUCK))


def frame(name: str, views: list[str], oracle: Callable | None = None):
    """A query that applies a DataFrame function to domain views; ``oracle``: its DuckDB text."""

    def put(function: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: function(*(view(spark, sf_dir, v) for v in views))
        if oracle:
            ORACLES[name] = duck_sql(oracle(DUCK))
        return function

    return put
