"""Registry of named queries: a Spark builder and, where SQL can state it,
the DuckDB oracle text over the same binding views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from epilake.plans.oracle_views import with_views
from epilake.sources.bind import Bindings


@dataclass
class Query:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(key: str, sql: str | None = None, raw_sql: bool = False):
    """Register `fn(b: Bindings) -> DataFrame` under `key` with its oracle body."""
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Bindings(spark, sf_dir))
        build.__name__ = f"q_{key}"
        build.__doc__ = fn.__doc__
        full = None if sql is None else (sql if raw_sql else with_views(sql))
        REGISTRY[key] = Query(key, build, full)
        return fn
    return deco
