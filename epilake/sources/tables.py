"""Readers for the driver's Parquet tables.

Every read is lazy: Catalyst prunes columns and pushes filters into the
Parquet scan, so callers select what they need and nothing more is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """Named access to `<sf_dir>/<name>.parquet`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        """The table as a DataFrame; one reader per (application, path), so repeated
        use does not list files and read footers again."""
        if name not in TABLES:
            raise KeyError(f"unknown table {name!r}")
        key = (self.spark.sparkContext.applicationId, self.path(name))
        df = _READERS.get(key)
        if df is None:
            df = self.spark.read.parquet(self.path(name))
            _READERS[key] = df
        return df


_READERS: dict[tuple[str, str], DataFrame] = {}
