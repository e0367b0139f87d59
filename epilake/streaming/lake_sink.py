"""Sinks that a replayed micro-batch cannot fill twice.

`LakeTable` is a partitioned Parquet table with a ledger. A batch writes its rows to
`data/<partition>/_batch=<id>` by dynamic partition overwrite, then one ledger entry with
its partitions and row counts. Readers see only what the ledger lists. So a batch that
fails half-way leaves nothing visible, a replay before the entry overwrites the same folders,
and a replay behind it is skipped. Entries belong to one checkpoint: a table is written by
one stream, whose batch ids only grow.

On it stand
* `append_cases`: reports into the lake, partitioned by month and region;
* `Trend`: sums by disease, country, region and month, of which a batch rewrites only
  the months that it touches, as a new version;
* `DailyCounts`: counts by event day that are final behind the watermark, with the rows
  that came too late kept beside them. Spark's own windowed aggregate drops those; here the
  watermark of a batch is read from the ledger of the batches before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epilake import fixed as X

BATCH = "_batch"


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def _same(left: DataFrame, right: DataFrame, cols: list[str]):
    """Null-safe equality of columns (a partition value may be null)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


class LakeTable:
    """A table of `schema` below `path`, partitioned by `parts`, written batch by batch."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, parts: list[str]):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), list(parts)
        body = [f for f in schema.fields if f.name not in parts]
        self.schema = T.StructType(body + [schema[p] for p in parts])
        self._stored = T.StructType([*self.schema.fields, T.StructField(BATCH, T.LongType())])
        self._entry = T.StructType([*[schema[p] for p in parts], T.StructField(BATCH, T.LongType()), T.StructField("n_rows", T.LongType())])

    def _ledger_path(self, batch_id: int) -> str:
        return f"{self.path}/ledger/batch-{batch_id}"

    def committed(self, batch_id: int) -> bool:
        """The entry's marker is written behind its last row."""
        return _exists(self.spark, f"{self._ledger_path(batch_id)}/_SUCCESS")

    def ledger(self) -> DataFrame:
        """Partition, batch and number of rows of all committed batches."""
        if not _exists(self.spark, f"{self.path}/ledger"):
            return self.spark.createDataFrame([], self._entry)
        # an entry without its marker is of a batch that failed
        return self.spark.read.schema(self._entry).option("recursiveFileLookup", "true").parquet(f"{self.path}/ledger")

    def write(self, rows: DataFrame, batch_id: int) -> bool:
        """Writes a batch and commits it; False if it was committed before."""
        if self.committed(batch_id):
            return False
        rows = rows.select(*self.schema.names).withColumn(BATCH, F.lit(batch_id).cast("long"))
        (rows.hint("rebalance", *self.parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*self.parts, BATCH).parquet(f"{self.path}/data"))
        entry = rows.groupBy(*self.parts, BATCH).agg(F.count(F.lit(1)).alias("n_rows"))
        entry.select(*self._entry.names).coalesce(1).write.mode("overwrite").parquet(self._ledger_path(batch_id))
        return True

    def read(self, latest: bool = False) -> DataFrame:
        """Rows of committed batches; latest: of each partition those of its last batch only."""
        if not _exists(self.spark, f"{self.path}/data"):
            return self.spark.createDataFrame([], self.schema)
        data = self.spark.read.schema(self._stored).option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")
        known = self.ledger()
        if latest:
            known = known.groupBy(*self.parts).agg(F.max(BATCH).alias(BATCH))
        else:
            known = known.select(*self.parts, BATCH)
        return data.join(known, _same(data, known, [*self.parts, BATCH]), "left_semi").select(*self.schema.names)


def run_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream over everything available, each micro-batch through `sink`."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


# ----------------------------------------------------------------- T1 + L1: reports into the lake
def with_partition(cases: DataFrame, geography: DataFrame) -> DataFrame:
    """Cases with the lake's partition columns: report month and region (null without a geography)."""
    region = geography.select("geography_id", "region_name")
    return cases.join(region, "geography_id", "left").withColumn("report_month", F.date_format("report_date", "yyyy-MM")) \
        .select(*cases.columns, "report_month", "region_name")


def case_lake(spark: SparkSession, path: str, schema: T.StructType) -> LakeTable:
    return LakeTable(spark, path, schema, ["report_month", "region_name"])


# ----------------------------------------------------------------- L6: maintained aggregates
class Trend:
    """Sums by disease, country, region and month that grow batch by batch."""

    KEYS = ["disease", "country_code", "region_name", "report_month"]
    SCHEMA = T.StructType([*[T.StructField(k, T.StringType()) for k in KEYS], T.StructField("cases", T.LongType()),
                           T.StructField("n_reports", T.LongType())])

    def __init__(self, spark: SparkSession, path: str):
        self.table = LakeTable(spark, path, self.SCHEMA, ["report_month"])

    def add(self, cases: DataFrame, batch_id: int) -> bool:
        """Merges a batch (KEYS and new_cases): only its months are read and written anew."""
        if self.table.committed(batch_id):
            return False
        new = cases.groupBy(*self.KEYS).agg(F.sum("new_cases").cast("long").alias("cases"), F.count(F.lit(1)).alias("n_reports"))
        old = self.table.read(latest=True)
        months = new.select("report_month").distinct()
        old = old.join(months, old["report_month"].eqNullSafe(months["report_month"]), "left_semi")
        merged = old.unionByName(new).groupBy(*self.KEYS).agg(F.sum("cases").alias("cases"), F.sum("n_reports").alias("n_reports"))
        return self.table.write(merged, batch_id)

    def rollup(self) -> DataFrame:
        """The maintained sums rolled up over country > region > month, as `region_trend` gives them."""
        sets = [self.KEYS[:i] for i in range(len(self.KEYS), 0, -1)]
        return self.table.read(latest=True).groupingSets(sets, *self.KEYS).agg(
            F.sum("cases").alias("cases"), F.sum("n_reports").alias("n_reports"), F.grouping_id().alias("grouping_level"))


# ----------------------------------------------------------------- T2: final counts and late rows
class DailyCounts:
    """Counts by event day, disease and geography; rows behind the watermark are kept as late.

    A batch's watermark is the largest event day of the batches before it less `delay` days. A row is late
    if its day ended at or before it (or if it has no day). A day's counts are final, and written once, when the
    watermark passes its end. Partial counts of each batch are combined, so a hot day or geography is a few rows
    a batch, and each final day is the sum of at most one row a batch and key.
    """

    KEYS = ["event_day", "disease", "geography_id"]

    def __init__(self, spark: SparkSession, path: str, rows: T.StructType, event: str, delay: int = X.MAX_REPORT_DELAY_DAYS):
        self.spark, self.event, self.delay = spark, event, delay
        month = T.StructField("event_month", T.StringType())
        counts = T.StructType([T.StructField("event_day", T.DateType()), T.StructField("disease", T.StringType()),
                               T.StructField("geography_id", T.StringType()), T.StructField("n_reports", T.LongType()),
                               T.StructField("cases", T.LongType()), month])
        self.late_table = LakeTable(spark, f"{path}/late", T.StructType([*rows.fields, month]), ["event_month"])
        self.open_table = LakeTable(spark, f"{path}/open", counts, ["event_month"])
        self.final_table = LakeTable(spark, f"{path}/final", counts, ["event_month"])
        #: One row a batch: its largest event day.
        self.seen = LakeTable(spark, f"{path}/seen", T.StructType([T.StructField("last_day", T.DateType()), T.StructField("of", T.LongType())]), ["of"])
        self.rows = rows

    def _last(self, seen: DataFrame):
        return seen.agg(F.max("last_day")).first()[0]

    def add(self, rows: DataFrame, batch_id: int) -> None:
        rows = rows.withColumn("event_month", F.date_format(self.event, "yyyy-MM"))
        before = self._last(self.seen.read().where(F.col("of") < batch_id))
        end = F.date_add(self.event, 1)
        behind = end <= F.date_sub(F.lit(before), self.delay) if before is not None else F.lit(False)
        late = F.col(self.event).isNull() | behind
        self.late_table.write(rows.where(late), batch_id)
        timely = rows.where(~late).withColumn("event_day", F.col(self.event))
        self.open_table.write(timely.groupBy(*self.KEYS, "event_month").agg(
            F.count(F.lit(1)).alias("n_reports"), F.sum("new_cases").cast("long").alias("cases")), batch_id)
        self.seen.write(rows.agg(F.max(self.event).alias("last_day")).withColumn("of", F.lit(batch_id).cast("long")), batch_id)
        now = self._last(self.seen.read().where(F.col("of") <= batch_id))
        done = F.lit(False)
        if now is not None:
            upto = F.date_sub(F.lit(now), self.delay)
            done = F.date_add("event_day", 1) <= upto
            if before is not None:
                done = done & (F.date_add("event_day", 1) > F.date_sub(F.lit(before), self.delay))
                # partitions that hold no such day are not read
                done = done & (F.col("event_month") >= F.date_format(F.date_sub(F.lit(before), self.delay + 1), "yyyy-MM"))
        days = self.open_table.read().where(done).groupBy(*self.KEYS, "event_month").agg(
            F.sum("n_reports").alias("n_reports"), F.sum("cases").alias("cases"))
        self.final_table.write(days, batch_id)

    def final(self) -> DataFrame:
        return self.final_table.read().drop("event_month")

    def late(self) -> DataFrame:
        return self.late_table.read().select(*self.rows.names)

    def still_open(self) -> DataFrame:
        """Counts of days that the watermark has not passed."""
        last = self._last(self.seen.read())
        days = self.open_table.read()
        days = days.where(F.date_add("event_day", 1) > F.date_sub(F.lit(last), self.delay)) if last is not None else days
        return days.groupBy(*self.KEYS).agg(F.sum("n_reports").alias("n_reports"), F.sum("cases").alias("cases"))
