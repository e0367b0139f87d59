"""Co-located storage: tables bucketed on their join keys, so that joins and aggregates on these keys read
them without a shuffle (L1, L4, M17).

Rows go to their bucket in one shuffle at write time, one sorted file a bucket. Bucket on all keys of the join:
facility and day rather than the facility alone, so that a facility with a third of all reports is spread over
buckets. Tables of equal keys and bucket counts join bucket by bucket. They are entries of the session's catalog over
files of the caller's folder; `drop` removes the entry, not the files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int | None = None) -> str:
    """Writes `df` bucketed and sorted by `keys`; returns the name of the table."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    (df.repartition(n, *keys).sortWithinPartitions(*keys).write.format("parquet").mode("overwrite")
     .bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name))
    return name


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
