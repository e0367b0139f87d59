"""Streaming state across micro-batches: two files, one per batch, against brute force."""

import datetime as dt
import os
import random
import time

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epilake import fixed as X
from epilake.streaming import streams as ST


def _write_two_batches(folder, first: pd.DataFrame, second: pd.DataFrame):
    os.makedirs(folder, exist_ok=True)
    first.to_parquet(os.path.join(folder, "b1.parquet"), index=False)
    time.sleep(1.1)  # the file source takes files in modification-time order
    second.to_parquet(os.path.join(folder, "b2.parquet"), index=False)


def _run(df, base):
    q = (df.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    assert q.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/out")


def test_outbreak_tracker_event_time_out_of_order(spark, tmp_path):
    """Batch 2 brings late trigger days (70..89, behind batch 1's latest day but inside
    the 30-day watermark): they must be slotted in day order. Only days the final
    watermark has passed are emitted."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.ROCKSDB)
    rnd = random.Random(5)
    rows = [(g, d) for g in ["HOT", "A"] for d in range(0, 200) if rnd.random() < (0.3 if g == "HOT" else 0.1)]
    rows += [("HOT", 10)] * 5                      # repeated reports of one day
    df = pd.DataFrame(rows, columns=["geography_id", "trigger_day"]).astype({"trigger_day": "int32"})
    late = (df.trigger_day >= 70) & (df.trigger_day < 90)
    first, second = df[(df.trigger_day < 90) & ~late], df[(df.trigger_day >= 90) | late].iloc[::-1]
    src = str(tmp_path / "src")
    _write_two_batches(src, first, second)
    schema = T.StructType([T.StructField("geography_id", T.StringType()),
                           T.StructField("trigger_day", T.IntegerType())])
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
              .withColumn("event_ts", F.timestamp_seconds(F.col("trigger_day").cast("long") * 86400))
              .withWatermark("event_ts", "30 days"))
    got = {(r.geography_id, r.trigger_day): (r.earliest_day, r.n_active)
           for r in _run(ST.track(stream), str(tmp_path / "run")).collect()}
    final_wm_day = df.trigger_day.max() - 30
    want = {}
    for g in ["HOT", "A"]:
        days = sorted({d for gg, d in rows if gg == g})
        for d in days:
            if d + 1 <= final_wm_day:
                active = [s for s in days if 0 <= d - s < X.OUTBREAK_ACTIVE_DAYS]
                want[(g, d)] = (min(active), len(active))
    assert got == want


def test_dedupe_across_batches(spark, tmp_path):
    d0 = dt.date(2023, 5, 1)
    first = pd.DataFrame({"case_id": [f"C{i}" for i in range(50)],
                          "report_date": [d0 + dt.timedelta(days=i % 5) for i in range(50)]})
    # second batch repeats 20 ids (within the watermark) and adds 30 new ones
    second = pd.DataFrame({"case_id": [f"C{i}" for i in range(30, 80)],
                           "report_date": [d0 + dt.timedelta(days=5 + i % 3) for i in range(50)]})
    src = str(tmp_path / "src")
    _write_two_batches(src, first, second)
    schema = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("report_date", T.DateType())])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = sorted(r.case_id for r in _run(ST.dedupe(stream), str(tmp_path / "run")).collect())
    assert got == sorted(f"C{i}" for i in range(80))


def test_daily_counts_emit_only_final_days(spark, tmp_path):
    d0 = dt.date(2023, 1, 1)
    rows = [(f"C{i}", d0 + dt.timedelta(days=i % 40), "Malaria", "G", 1) for i in range(400)]
    df = pd.DataFrame(rows, columns=["case_id", "report_date", "disease", "geography_id", "new_cases"])
    src = str(tmp_path / "src")
    _write_two_batches(src, df[df.report_date < d0 + dt.timedelta(days=20)],
                       df[df.report_date >= d0 + dt.timedelta(days=20)])
    schema = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("report_date", T.DateType()),
                           T.StructField("disease", T.StringType()), T.StructField("geography_id", T.StringType()),
                           T.StructField("new_cases", T.LongType())])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = _run(ST.daily_counts(stream), str(tmp_path / "run"))
    last = d0 + dt.timedelta(days=39)
    # a day is emitted once the watermark (latest day - 14) reaches its end
    want_days = [d0 + dt.timedelta(days=i) for i in range(40)
                 if d0 + dt.timedelta(days=i + 1) <= last - dt.timedelta(days=X.MAX_REPORT_DELAY_DAYS)]
    got = sorted(r.window_start for r in out.collect())
    assert got == want_days
    assert out.agg(F.sum("n_reports")).first()[0] == 10 * len(want_days)


def test_daily_counts_independent_of_session_time_zone(spark, tmp_path):
    d0 = dt.date(2023, 3, 1)
    rows = [(f"C{i}", d0 + dt.timedelta(days=i % 30), "Cholera", "G", 2) for i in range(300)]
    df = pd.DataFrame(rows, columns=["case_id", "report_date", "disease", "geography_id", "new_cases"])
    src = str(tmp_path / "src")
    _write_two_batches(src, df.iloc[:150], df.iloc[150:])
    schema = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("report_date", T.DateType()),
                           T.StructField("disease", T.StringType()), T.StructField("geography_id", T.StringType()),
                           T.StructField("new_cases", T.LongType())])
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        stream = spark.readStream.schema(schema).parquet(src)
        out = _run(ST.daily_counts(stream), str(tmp_path / "run")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert all(r.window_end == r.window_start + dt.timedelta(days=1) for r in out)
    assert {r.window_start for r in out} == {d0 + dt.timedelta(days=i) for i in range(15)}
    assert all(r.n_reports == 10 for r in out)


def test_streams_read_folders_of_part_files(spark, tmp_path):
    """A table stored as part files streams the same rows as a single file; a missing table is an error."""
    import pytest
    from conftest import SF_SMALL
    from epilake.sources.bind import Bindings
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.ROCKSDB)
    folder = tmp_path / "parts"
    folder.mkdir()
    for t in ("region", "nation", "customer", "supplier", "orders"):
        os.symlink(f"{SF_SMALL}/{t}.parquet", folder / f"{t}.parquet")
    one = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    one.repartition(4).write.parquet(str(folder / "lineitem.parquet"))
    single, parts = Bindings(spark, SF_SMALL), Bindings(spark, str(folder))
    for name, build in (("ingest", lambda b: ST.case_stream(b)), ("counts", lambda b: ST.daily_counts(ST.case_stream(b))),
                        ("enrich", lambda b: ST.enrich(b, ST.case_stream(b)))):
        a, c = (ST.run_available(build(b), spark, b.t.sf_dir, name) for b in (single, parts))
        assert a.count() == c.count() > 0 and a.exceptAll(c).count() == 0
    cases = parts.case()
    whole = ST.run_available(ST.dedupe(ST.case_stream(parts)), spark, parts.t.sf_dir, "dedupe")
    assert whole.columns == cases.columns and whole.exceptAll(cases).count() == 0
    assert whole.count() == cases.select("case_id").distinct().count()
    seen = ST.run_available(ST.case_stream(parts, max_files_per_trigger=1), spark, parts.t.sf_dir, "bounded")
    assert seen.count() == cases.count()
    with pytest.raises(FileNotFoundError):
        ST.table_stream(spark, str(tmp_path / "nothing.parquet"), one.schema)


def _deliver(spark, folder, batches, schema):
    """One file a batch; the source takes them in order of time."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)


def test_dedupe_first_is_independent_of_arrival(spark, tmp_path):
    d0 = dt.date(2023, 1, 1)
    day = lambda n: d0 + dt.timedelta(days=n)
    schema = "case_id string, report_date date, facility_id string, disease string, new_cases int"
    hot = [("HOT", day(10 + i % 5), f"F{i % 7}", "M", i % 3 or None) for i in range(400)]
    rows = hot + [(f"C{i}", day(i % 30), f"F{j}", "M", j) for i in range(60) for j in range(1 + i % 3)]
    rows += [("FAR", day(1), "F1", "M", 1), ("FAR", day(25), "F0", "M", 1), ("END", day(100), "F1", "M", 1), (None, day(3), "F1", "M", None)]
    want = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2], r[3], r[4] is not None, r[4] or 0)):
        if r[0] != "END":
            want.setdefault((r[0], r[1] >= day(20) if r[0] == "FAR" else 0), r)
    for seed in (1, 2):
        shuffled = [r for r in rows if r[0] != "END" and r[1] < day(14)]
        random.Random(seed).shuffle(shuffled)
        later = [r for r in rows if r[0] != "END" and r[1] >= day(14)]
        random.Random(seed).shuffle(later)
        src = str(tmp_path / f"src{seed}")
        _deliver(spark, src, [shuffled, later, [r for r in rows if r[0] == "END"]], schema)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        got = [tuple(r) for r in _run(ST.dedupe_first(stream), str(tmp_path / f"run{seed}")).collect()]
        assert sorted(got, key=str) == sorted(want.values(), key=str)


def test_ring_gives_the_sliding_windows(spark, tmp_path):
    """Gaps longer than the window, nulls, repeated days and several batches."""
    d0 = dt.date(2023, 1, 1)
    rng = random.Random(9)
    rows = [(g, d0 + dt.timedelta(days=n), rng.choice([None, 0.0, 1.5, 80.1]), 1) for g in ("HOT", "A", "B") for n in range(120)
            if (g == "HOT" or rng.random() < 0.3) and not (g == "A" and 30 <= n < 70) and not (g == "B" and n > 50)]
    rows += [("HOT", d0 + dt.timedelta(days=7), 2.5, 1)] * 3 + [("N", d0 + dt.timedelta(days=4), None, 1)]
    schema = "geography_id string, obs_date date, rainfall_mm double, other int"
    batches = [[r for r in rows if a <= (r[1] - d0).days < b] for a, b in ((0, 40), (40, 41), (41, 90), (90, 120))]
    src = str(tmp_path / "src")
    _deliver(spark, src, batches, schema)

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)

    ring = _run(ST.rain_21d_ring(stream()), str(tmp_path / "ring"))
    plain = _run(ST.rain_21d(stream()), str(tmp_path / "plain"))
    assert sorted((tuple(r) for r in ring.collect()), key=str) == sorted((tuple(r) for r in plain.collect()), key=str)
    assert ring.count() > 200
    days = spark.read.format("statestore").option("stateVarName", "days").option("path", str(tmp_path / "ring" / "ck")).option("operatorId", 0).load()
    held = {r.key.geography_id if hasattr(r.key, "geography_id") else r.key[0]: r.n for r in days.groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert held and max(held.values()) <= X.MALARIA_HISTORY_DAYS + 1


def test_triggers_of_two_streams(spark, tmp_path):
    """Climate that comes after its cases, and before them, still triggers; days that are not final do not."""
    d0 = dt.date(2023, 1, 1)
    day = lambda n: d0 + dt.timedelta(days=n)
    rng = random.Random(4)
    cases = [(day(n), f"F{rng.randint(1, 12)}", g, rng.choice(["Cholera", "Cholera", "Malaria"]), rng.choice([None, 0, 3]))
             for n in range(80) for g in ("HOT", "HOT", "A") if rng.random() < 0.7]
    rain = [(g, day(n), rng.choice([None, 10.0, 80.0, 90.0, 120.5])) for n in range(80) for g in ("HOT", "A", "B")]
    c_schema = "report_date date, facility_id string, geography_id string, disease string, new_cases int"
    k_schema = "geography_id string, obs_date date, rainfall_mm double"
    c_src, k_src = str(tmp_path / "c"), str(tmp_path / "k")
    got = None

    def run():
        streams = (spark.readStream.schema(c_schema).parquet(c_src), spark.readStream.schema(k_schema).parquet(k_src))
        return _run(ST.trigger_days_of_streams(*streams), str(tmp_path / "run"))

    # cases run ahead of the climate by 10 days, then the climate ahead of the cases
    for c_to, k_to in ((20, 10), (40, 30), (50, 62), (80, 80)):
        c_from, k_from = (0, 0) if got is None else last
        spark.createDataFrame([r for r in cases if c_from <= (r[0] - d0).days < c_to], c_schema).write.mode("append").parquet(c_src)
        spark.createDataFrame([r for r in rain if k_from <= (r[1] - d0).days < k_to], k_schema).write.mode("append").parquet(k_src)
        last, got = (c_to, k_to), run()
    want = {}
    wet = {(g, d): mm for g, d, mm in rain if mm is not None and mm > X.OUTBREAK_TRIGGER_RAIN}
    for d, f, g, disease, n in cases:
        if disease == "Cholera" and n and (g, d) in wet and d + dt.timedelta(days=1) <= day(79 - X.MAX_REPORT_DELAY_DAYS):
            k, first = want.get((g, d), (0, None))
            want[g, d] = (k + 1, min(filter(None, (first, f)), key=lambda x: (len(x), x)))
    assert {(r.geography_id, r.start_date): (r.n_reports, r.first_facility_id) for r in got.collect()} == want and len(want) > 10
