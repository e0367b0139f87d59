"""Shared-folder tables, size checks, range layouts and skew-safe lookups.

Every intermediate table is written as Parquet below `spark.checkpoint.dir`
(`epilake.session.work_path`), so a lost executor re-reads files instead of
recomputing a lineage.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epilake.session import ensure_work_dir

#: Bytes (estimated from rows and columns) up to which a written table is broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024
#: A key is hot if it holds more than one in HOT_SHARE rows; so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared folder."""
    bound_batches(spark)
    return f"{ensure_work_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


_made = threading.local()


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """`df` written to the shared folder and read back with the same schema."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    out = df.write
    if partition_by:
        out = out.partitionBy(partition_by)
    out.parquet(path)
    if getattr(_made, "paths", None):
        _made.paths[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def only(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """`build()` written and read back; tables that were written on the way are deleted.

    So a step of several jobs leaves its result alone on the disk. Calls may be nested; an inner result is one of the
    outer call's tables.
    """
    _made.paths = [*getattr(_made, "paths", []), []]
    try:
        path = fresh_path(spark, name)
        df = build()
        df.write.parquet(path)
        schema = df.schema
    finally:
        spent = _made.paths.pop()
        for p in spent:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(p)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    if _made.paths:
        _made.paths[-1].append(path)
    return spark.read.schema(schema).parquet(path)


#: Rows of an Arrow batch, if the session has Spark's default: whole texts make 10,000 rows too large for a worker.
ARROW_ROWS = 1000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once; a setting of the session's own stays."""
    if spark.conf.get(_ARROW, "10000") == "10000":
        spark.conf.set(_ARROW, str(ARROW_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_points(df: DataFrame, col: str, parts: int) -> list[int]:
    """At most `parts - 1` values of integer column `col` that cut its rows into even ranges.

    The list is as long as the number of partitions, not as the data. It is a
    value, so every evaluation of a plan that uses it lays rows out alike.
    """
    if parts < 2:
        return []
    got = df.agg(F.percentile_approx(col, [k / parts for k in range(1, parts)], max(10000, 20 * parts))).first()[0]
    return sorted(set(got or []))


def range_bucket(col: Column | str, points: list[int]) -> Column:
    """Number of split points <= col, by a binary search over nested comparisons; null is 0."""
    col = F.col(col) if isinstance(col, str) else col

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(col >= F.lit(points[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(points))


def prefix_sums(counts: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Sum of `value` over smaller `by`; one row for each partition of a layout, so one task is enough."""
    w = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def ranked(df: DataFrame, order: list[Column], rank: str, name: str) -> DataFrame:
    """A written copy of `df` with `rank` = 0, 1, ... in `order` (a total order), without one global task.

    Rows are range-partitioned and sorted; each partition is written with its
    number, and the counts of earlier partitions are added to positions.
    """
    spark = df.sparkSession
    parts = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    parts = parts.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    parts = written(parts, name)
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    counts = prefix_sums(counts, "_part", "_n", "_before").select("_part", "_first", "_before")
    out = parts.join(F.broadcast(counts), "_part")  # one row for each partition
    return out.withColumn(rank, F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def row_bytes(df: DataFrame) -> int:
    """Estimated bytes of a row of fixed-width columns (64 for a string or binary one)."""
    width = {"long": 8, "double": 8, "integer": 4, "boolean": 1, "float": 4}
    return 16 + sum(width.get(f.dataType.typeName(), 64) for f in df.schema.fields)


def lookup(left: DataFrame, right: DataFrame, key: str, name: str, how: str = "left",
           weight: str | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a table that has one row for each key, where a key may hold much of `left`.

    `right` is written first. If its estimated bytes are within `limit` it is
    broadcast. Beyond that the rows of hot keys (more than 1/HOT_SHARE of all by
    column `weight`, so fewer than HOT_SHARE keys) are looked up by broadcast and
    the others by a shuffle join.
    """
    right = written(right, name)
    drop = [weight] if weight else []
    if right.count() * row_bytes(right) <= limit:
        return left.join(F.broadcast(right.drop(*drop)), key, how)
    if not weight:
        return left.join(right, key, how)
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.where(F.col(weight) > total / HOT_SHARE).drop(*drop)
    rest = right.where(F.col(weight) <= total / HOT_SHARE).drop(*drop)
    marks = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    marked = left.join(marks, key, "left")
    heavy = marked.where("_hot").drop("_hot").join(F.broadcast(hot), key, "inner")
    light = marked.where("_hot is null").drop("_hot").join(rest, key, how)
    return heavy.unionByName(light)
