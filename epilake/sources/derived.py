"""Derived tables written once to the shared folder and read back.

Used for tables that many queries share and that are small relative to
their inputs (the climate table: one row per geography-day, built from
orders x customer). Writing it once:
* avoids recomputing the large join in every query that uses it;
* cuts the lineage, so a lost executor recomputes from the written table;
* makes the row count cheap, which is the proof a broadcast needs.

Tables are keyed by (application, input folder, name): within one
application the input folder is treated as immutable.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from epilake.sources.lake import tagged_path

_written: dict[tuple[str, str, str], str] = {}
_lock = threading.RLock()  # re-entrant: building one table may build another


def materialized_path(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> str:
    """Path of the written table, writing it on first use in this application."""
    app = spark.sparkContext.applicationId
    key = (app, sf_dir.rstrip("/"), name)
    with _lock:  # queries built from several threads write each table once
        path = _written.get(key)
        if path is None:
            path = tagged_path(spark, sf_dir, "derived", app, name)
            build().write.mode("overwrite").parquet(path)
            _written[key] = path
    return path


def materialized(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    return spark.read.parquet(materialized_path(spark, sf_dir, name, build))
