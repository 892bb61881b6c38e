"""Registry of the queries on the driver's tables: name -> (Spark callable, DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "chronology_refuted"


def query(name: str, oracle: str | None = None):
    """Register a query function ``f(spark, sf_dir)`` under ``name`` with its oracle."""

    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put
