"""Join helpers: size-checked broadcast.

A side is broadcast only when its row count is proven small. The proof is
a `limit(n + 1).count()` on a table whose row count bounds the side (for
the geography view that is `nation`: one geography per nation row), so
the check reads at most n + 1 rows. Beyond the bound the side is left
unhinted and Spark/AQE choose a shuffle join from runtime sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Row bound under which a dimension is broadcast to every task.
BROADCAST_MAX_ROWS = 1_000_000

_checked: dict[tuple[str, str], bool] = {}


def rows_at_most(df: DataFrame, max_rows: int, cache_key: str | None = None) -> bool:
    """True when `df` has at most `max_rows` rows; reads at most max_rows + 1."""
    key = (df.sparkSession.sparkContext.applicationId, cache_key) if cache_key else None
    if key is not None and key in _checked:
        return _checked[key]
    ok = df.limit(max_rows + 1).count() <= max_rows
    if key is not None:
        _checked[key] = ok
    return ok


def bounded_broadcast(df: DataFrame, bound_by: DataFrame | None = None,
                      max_rows: int = BROADCAST_MAX_ROWS,
                      cache_key: str | None = None) -> DataFrame:
    """Broadcast `df` if `bound_by` (default: `df`) has at most `max_rows` rows."""
    probe = df if bound_by is None else bound_by
    if rows_at_most(probe, max_rows, cache_key):
        return F.broadcast(df)
    return df


def constant_dim(df: DataFrame) -> DataFrame:
    """Broadcast a dimension built from literal rows (size fixed in code)."""
    return F.broadcast(df)


_literal: dict[tuple[str, str], DataFrame] = {}


def literal_table(spark, name: str, rows, schema: str) -> DataFrame:
    """A small table from literal rows, created once per application."""
    key = (spark.sparkContext.applicationId, name)
    df = _literal.get(key)
    if df is None:
        df = spark.createDataFrame(rows, schema)
        _literal[key] = df
    return df
