"""Structured Streaming forms.

Sources are file streams over Parquet (the driver's lineitem file, or a
climate table Spark wrote to the shared folder). Sinks are Parquet with
their checkpoints in the shared folder, so a restarted query resumes
from its offsets and state. `run_available` drives a query with
`availableNow` and returns the sink read back as a batch DataFrame.

Event time is the report day as a UTC timestamp; the 14-day watermark is
the reference's maximum reporting delay.
"""

from __future__ import annotations

import logging
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from epilake import fixed as X
from epilake.sources.bind import Bindings
from epilake.sources.lake import tagged_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELAY = f"{X.MAX_REPORT_DELAY_DAYS} days"


def table_stream(spark: SparkSession, path: str, schema: T.StructType,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet file stream over a table: a folder of part files, or a single file.

    A path without any file is an error, not an empty stream. `max_files_per_trigger`
    bounds a micro-batch; files that then arrive out of event-time order by more than
    the watermark lose rows, which `run_available` reports.
    """
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        raise FileNotFoundError(f"no table at {path}")
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if not fs.getFileStatus(jpath).isDirectory():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    if not any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(jpath)):
        raise FileNotFoundError(f"no data file in {path}")
    return reader.option("recursiveFileLookup", "true").parquet(path)


def late_rows(query) -> int:
    """Rows that stateful operators of a finished query dropped behind the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def run_available(df: DataFrame, spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Run a streaming query over everything available, then read its sink.

    Rows behind the watermark are dropped by the stateful operators; their number is logged.
    """
    base = tagged_path(spark, sf_dir, "stream", name, uuid.uuid4().hex[:12])
    q = (df.writeStream.outputMode("append").format("parquet")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    if late := late_rows(q):
        logging.getLogger(__name__).warning("%s: %d rows behind the watermark were dropped", name, late)
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def case_stream(b: Bindings, max_files_per_trigger: int | None = None) -> DataFrame:
    """Lineitem file stream -> case rows (stream-static join with facility)."""
    li_schema = b.t("lineitem").select(*Bindings.LINEITEM_COLS).schema
    li = table_stream(b.spark, b.t.path("lineitem"), li_schema, max_files_per_trigger)
    return b.case_from(li.select(*Bindings.LINEITEM_COLS))


def day_start_ts(date_col: str) -> F.Column:
    """Midnight UTC of a date as a timestamp, independent of the session time zone."""
    return F.timestamp_seconds(F.unix_date(F.col(date_col)).cast("long") * 86400)


def ts_day(ts: F.Column) -> F.Column:
    """The UTC day of a timestamp, independent of the session time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int"))


def with_event_time(cases: DataFrame) -> DataFrame:
    return cases.withColumn("event_ts", day_start_ts("report_date"))


def enrich(b: Bindings, cases: DataFrame) -> DataFrame:
    """Arriving reports joined to static geography (J1 on a stream)."""
    g = b.geography_b().select("geography_id", "population", "urban_rural")
    return cases.join(g, "geography_id", "left")


def daily_counts(cases: DataFrame) -> DataFrame:
    """Tumbling daily counts by disease and geography; a day is final once the
    watermark (latest report - 14 days) passes its end."""
    ev = with_event_time(cases).withWatermark("event_ts", DELAY)
    agg = (ev.groupBy(F.window("event_ts", "1 day"), "disease", "geography_id")
           .agg(F.count(F.lit(1)).alias("n_reports"), F.sum("new_cases").alias("cases")))
    return agg.select(ts_day(F.col("window.start")).alias("window_start"),
                      ts_day(F.col("window.end")).alias("window_end"),
                      "disease", "geography_id", "n_reports", "cases")


def dedupe(cases: DataFrame) -> DataFrame:
    """T4: one whole report for each case id while its copies are within the watermark
    (the copy that is seen first)."""
    ev = with_event_time(cases).withWatermark("event_ts", DELAY)
    return ev.dropDuplicatesWithinWatermark(["case_id"]).select(*cases.columns)


def dedupe_first(cases: DataFrame) -> DataFrame:
    """T4, deterministic: of the reports of a case id that follow each other within the watermark's delay, the
    first by report day, facility, disease and all other columns, whatever order they arrive in.

    A session of the id holds the smallest report (a struct) as its state and releases it when the watermark passes
    the session's end. Copies are merged inside each task before the shuffle, so an id with very many copies reaches
    its state as one row a task. A session is looked up by a scan of its id's keys, which would pass all that released
    sessions leave behind in the store until it is compacted; so each commit compacts it, and rows are not counted.
    """
    use_rocksdb(cases.sparkSession)
    conf = cases.sparkSession.conf
    conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
    conf.set("spark.sql.streaming.stateStore.rocksdb.compactOnCommit", "true")
    first = ["report_date", "facility_id", "disease"]
    first = [c for c in first if c in cases.columns]
    order = first + [c for c in cases.columns if c not in first and c != "case_id"]
    ev = with_event_time(cases).withWatermark("event_ts", DELAY)
    got = ev.groupBy(F.session_window("event_ts", DELAY), "case_id").agg(F.min(F.struct(*order)).alias("_first"))
    return got.select("case_id", "_first.*").select(*cases.columns)


def climate_stream(b: Bindings) -> DataFrame:
    """Climate as a file stream over the climate table Spark wrote to the shared folder."""
    clim = b.climate()
    return b.spark.readStream.schema(clim.schema).parquet(b.climate_path())


RAIN_WATERMARK = "1 day"


def rain_21d(climate: DataFrame) -> DataFrame:
    """Sliding 21-day rain with a 1-day slide; the window ending at day d holds
    days d-21..d-1, i.e. the batch trailing sum W1 at day d."""
    ev = climate.withColumn("event_ts", day_start_ts("obs_date")).withWatermark("event_ts", RAIN_WATERMARK)
    w = F.window("event_ts", f"{X.MALARIA_HISTORY_DAYS} days", "1 day")
    agg = ev.groupBy(w, "geography_id").agg(
        F.sum(F.col("rainfall_mm").cast("decimal(18,1)")).cast("double").alias("rain_21d"),
        F.count(F.lit(1)).alias("n_days"))
    return agg.select("geography_id", ts_day(F.col("window.end")).alias("window_end"), "rain_21d", "n_days")


MS_PER_DAY = 86_400_000

RING_OUT = T.StructType([T.StructField("geography_id", T.StringType()), T.StructField("window_end", T.IntegerType()),
                         T.StructField("tenths", T.LongType()), T.StructField("n_days", T.LongType())])


class RainRing(StatefulProcessor):
    """Trailing rain of a geography: a ring of day buckets and one running sum.

    Rows are final day sums (tenths of a millimetre, null if no row of the day has rain; rows and rows with rain),
    one a day. Each day enters the sum once and leaves it once, when the window moves past it; its bucket is
    deleted then. So a geography at rest holds at most HISTORY_DAYS buckets, the sum and a timer, and a row costs one
    update instead of one for each window that it is in. Windows without any row are not emitted.
    """

    HISTORY_DAYS = X.MALARIA_HISTORY_DAYS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        bucket = T.StructType([T.StructField(c, T.LongType()) for c in ("tenths", "rows", "with_rain")])
        self.days = handle.getMapState("days", T.StructType([T.StructField("day", T.IntegerType())]), bucket)
        self.sums = handle.getValueState("sums", T.StructType([T.StructField(c, T.LongType()) for c in ("next_end", "tenths", "rows", "with_rain")]))

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for pdf in rows:
            for day, tenths, n, with_rain in zip(pdf["day"], pdf["tenths"], pdf["n_rows"], pdf["n_rain"]):
                self.days.updateValue((int(day),), (0 if pd.isna(tenths) else int(tenths), int(n), int(with_rain)))
                first = int(day) if first is None else min(first, int(day))
        if first is not None and not self.sums.exists():
            self.sums.update((first + 1, 0, 0, 0))
        return self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self._advance(key, timerValues)

    def _advance(self, key, timerValues):
        """All windows that end at or before the watermark."""
        if not self.sums.exists():
            return iter([])
        upto = timerValues.getCurrentWatermarkInMs() // MS_PER_DAY
        end, tenths, n, with_rain = self.sums.get()
        out = []
        while end <= upto:
            for day, sign in ((end - 1, 1), (end - 1 - self.HISTORY_DAYS, -1)):
                if self.days.containsKey((day,)):
                    t, r, w = self.days.getValue((day,))
                    tenths, n, with_rain = tenths + sign * t, n + sign * r, with_rain + sign * w
                    if sign < 0:
                        self.days.removeKey((day,))
            if n:
                out.append((key[0], end, tenths if with_rain else None, n))
                end += 1
                continue
            # no row in the window: on to the next day that has one
            later = [int(k[0]) for k in self.days.keys() if k[0] >= end]
            if not later:
                self.sums.clear()
                return self._rows(out)
            end = min(later) + 1
        self.sums.update((end, tenths, n, with_rain))
        self.handle.registerTimer(end * MS_PER_DAY)
        return self._rows(out)

    @staticmethod
    def _rows(out):
        if not out:
            return iter([])
        pdf = pd.DataFrame(out, columns=["geography_id", "window_end", "tenths", "n_days"])
        return iter([pdf.astype({"tenths": "Int64"})])

    def close(self) -> None:
        pass


def rain_21d_ring(climate: DataFrame) -> DataFrame:
    """T3, incremental: the rows of `rain_21d` from one state update a geography-day.

    Rows are summed to geography-days first (combined before the shuffle), which a hot geography spreads over tasks.
    """
    use_rocksdb(climate.sparkSession)
    ev = climate.withColumn("event_ts", day_start_ts("obs_date")).withWatermark("event_ts", RAIN_WATERMARK)
    rain = F.col("rainfall_mm").cast("decimal(18,1)")
    days = ev.groupBy(F.window("event_ts", "1 day"), "geography_id").agg(
        F.sum((rain * 10).cast("long")).alias("tenths"), F.count(F.lit(1)).alias("n_rows"), F.count("rainfall_mm").alias("n_rain"))
    days = days.select("geography_id", F.window_time("window").alias("event_ts"),
                       F.unix_date(ts_day(F.col("window.start"))).alias("day"), "tenths", "n_rows", "n_rain")
    got = days.groupBy("geography_id").transformWithStateInPandas(
        statefulProcessor=RainRing(), outputStructType=RING_OUT, outputMode="Append", timeMode="EventTime")
    return got.select("geography_id", F.date_from_unix_date("window_end").alias("window_end"),
                      (F.col("tenths") / F.lit(10.0)).alias("rain_21d"), "n_days")


def use_rocksdb(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# ------------------------------------------------------------- M5 from two streams
def trigger_days_of_streams(cases: DataFrame, climate: DataFrame) -> DataFrame:
    """M5 with both sides arriving: cholera report days with rain above the bound, one row a geography-day.

    Each side is summed to geography-days under its own watermark (its copies and a hot geography combine before
    the shuffle); the day sums are joined on geography and day window, so the state of a day goes when the slower side's
    watermark passes it. Climate may come before or after its cases, as long as it is within the delay.
    """
    cholera = (F.col("disease") == "Cholera") & (F.col("new_cases") > 0)
    # conditional sums keep every report in the watermark, also of other diseases
    order = F.struct(F.length("facility_id").alias("n"), F.col("facility_id").alias("id"))
    day = F.window("event_ts", "1 day").alias("day")
    reports = with_event_time(cases).withWatermark("event_ts", DELAY).groupBy(day, "geography_id").agg(
        F.count(F.when(cholera, 1)).alias("n_reports"), F.min(F.when(cholera, order)).alias("first"))
    rain = climate.withColumn("event_ts", day_start_ts("obs_date")).withWatermark("event_ts", DELAY).groupBy(day, "geography_id").agg(
        F.max("rainfall_mm").alias("rainfall_mm"))
    met = reports.where("n_reports > 0").join(rain.where(F.col("rainfall_mm") > X.OUTBREAK_TRIGGER_RAIN), ["day", "geography_id"])
    return met.select("geography_id", ts_day(F.col("day.start")).alias("start_date"), "n_reports", F.col("first.id").alias("first_facility_id"),
                      "rainfall_mm")


# ------------------------------------------------------------- T5 outbreak tracker
TRACKER_OUT = T.StructType([
    T.StructField("geography_id", T.StringType()),
    T.StructField("trigger_day", T.IntegerType()),
    T.StructField("earliest_day", T.IntegerType()),
    T.StructField("n_active", T.LongType()),
])


class OutbreakTracker(StatefulProcessor):
    """Per geography, in event time: outbreaks start on trigger days and stay active
    while their age (day - start) is under 60 days.

    Trigger days are buffered in `pending` with a timer at the end of the day. When
    the watermark (latest report - 14 days) passes a day, every report of it has
    arrived, so due days are taken in day order: the active list (`starts`) is
    pruned, the day appended, and (day, earliest active start, number active)
    emitted. Reports arriving out of order within the watermark are therefore
    handled exactly; rows are reduced chunk by chunk to distinct days, so a
    geography with many reports holds only its days in state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        day = T.StructType([T.StructField("day", T.IntegerType())])
        self.starts = handle.getListState("starts", day)
        self.pending = handle.getListState("pending", day)

    @staticmethod
    def _days(state) -> list[int]:
        return [int(r[0]) for r in state.get()] if state.exists() else []

    def handleInputRows(self, key, rows, timerValues):
        days: set[int] = set()
        for pdf in rows:
            days.update(int(d) for d in pdf["trigger_day"].unique())
        done = self._days(self.starts)
        last_done = max(done) if done else None
        pending = set(self._days(self.pending))
        new = sorted(d for d in days - pending if last_done is None or d > last_done)
        for d in new:
            self.handle.registerTimer((d + 1) * MS_PER_DAY)
        if new:
            self.pending.appendList([(d,) for d in new])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        wm = timerValues.getCurrentWatermarkInMs()
        pending = sorted(set(self._days(self.pending)))
        due = [d for d in pending if (d + 1) * MS_PER_DAY <= wm]
        if not due:
            return iter([])
        active = self._days(self.starts)
        out = []
        for d in due:
            active = [s for s in active if d - s < X.OUTBREAK_ACTIVE_DAYS]
            active.append(d)
            out.append((key[0], d, min(active), len(active)))
        self.starts.put([(s,) for s in active])
        rest = [d for d in pending if (d + 1) * MS_PER_DAY > wm]
        if rest:
            self.pending.put([(d,) for d in rest])
        else:
            self.pending.clear()
        return iter([pd.DataFrame(out, columns=["geography_id", "trigger_day", "earliest_day", "n_active"])])

    def close(self) -> None:
        pass


def trigger_stream(b: Bindings, cases: DataFrame) -> DataFrame:
    """Cholera reports with cases > 0 on a day with rain > 80 (stream-static join
    with the climate table)."""
    # static side: the written climate table, so each micro-batch reads a small
    # table instead of recomputing it
    clim = b.geo_day_side(b.climate().filter(F.col("rainfall_mm") > X.OUTBREAK_TRIGGER_RAIN)
                          .select("geography_id", F.col("obs_date").alias("report_date")))
    t = (cases.filter((F.col("disease") == "Cholera") & (F.col("new_cases") > 0))
         .join(clim, ["geography_id", "report_date"], "inner"))
    keep = ["event_ts"] if "event_ts" in cases.columns else []
    return t.select("geography_id", F.unix_date("report_date").alias("trigger_day"), *keep)


def outbreak_tracker(b: Bindings, cases: DataFrame) -> DataFrame:
    """T5: stateful outbreak tracker (`transformWithStateInPandas`, ListState)."""
    use_rocksdb(b.spark)
    trig = trigger_stream(b, with_event_time(cases).withWatermark("event_ts", DELAY))
    # one row per geography-day before the per-geography state: the dedupe state is
    # keyed by (geography, day), so a geography with many reports is spread over tasks
    # and only its distinct days reach the tracker
    trig = trig.dropDuplicatesWithinWatermark(["geography_id", "trigger_day"])
    return track(trig)


def track(triggers: DataFrame) -> DataFrame:
    """Run the tracker over (geography_id, trigger_day) rows of a watermarked stream."""
    return triggers.groupBy("geography_id").transformWithStateInPandas(
        statefulProcessor=OutbreakTracker(), outputStructType=TRACKER_OUT, outputMode="Append",
        timeMode="EventTime")


def tracker_as_dates(df: DataFrame) -> DataFrame:
    return df.select("geography_id", F.date_from_unix_date("trigger_day").alias("trigger_date"),
                     F.date_from_unix_date("earliest_day").alias("earliest_active_start"), "n_active")
