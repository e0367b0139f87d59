"""Ledger sink under failures and replays; maintained sums; late rows, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from epilake.streaming import lake_sink as LS

CASE = "case_id string, report_date date, case_date date, disease string, geography_id string, new_cases int"
LAKE = "case_id string, n int, month string, region string"


def _rows(spark, batch, schema=LAKE):
    return spark.createDataFrame(batch, schema)


def _table(spark, tmp_path):
    schema = spark.createDataFrame([], LAKE).schema
    return LS.LakeTable(spark, str(tmp_path / "lake"), schema, ["month", "region"])


def _content(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_replays_and_failures_leave_each_batch_once(spark, tmp_path, monkeypatch):
    table = _table(spark, tmp_path)
    assert _content(table) == []
    one = [("a", 1, "2023-01", "X"), ("b", 2, "2023-02", None), ("c", None, None, "Y"), ("a", 1, "2023-01", "X")]
    two = [("d", 4, "2023-01", "X"), ("e", 5, "2023-03", "Z")]
    assert table.write(_rows(spark, one), 0)
    assert not table.write(_rows(spark, one), 0)
    want = sorted(one, key=str)
    assert _content(table) == want
    # a failure between the rows and the ledger entry: nothing of the batch is seen
    known = LS.LakeTable._ledger_path
    monkeypatch.setattr(LS.LakeTable, "_ledger_path", lambda self, i: "no-such-store://x")
    with pytest.raises(Exception):
        table.write(_rows(spark, two + [("stale", 9, "2023-09", "X")]), 1)
    monkeypatch.setattr(LS.LakeTable, "_ledger_path", known)
    assert _content(table) == want
    # its replay: rows of the failed attempt in other partitions stay hidden
    assert table.write(_rows(spark, two), 1)
    assert _content(table) == sorted(one + two, key=str)
    assert {(r.month, r.region, r._batch): r.n_rows for r in table.ledger().collect()} == {
        ("2023-01", "X", 0): 2, ("2023-02", None, 0): 1, (None, "Y", 0): 1, ("2023-01", "X", 1): 1, ("2023-03", "Z", 1): 1}
    # an empty batch is committed too
    assert table.write(_rows(spark, []), 2) and not table.write(_rows(spark, two), 2)
    assert _content(table) == sorted(one + two, key=str)


def test_stream_restarted_before_its_offsets_are_committed(spark, tmp_path):
    """The last batch runs again after a restart whose commit log lacks it; the lake stays the same."""
    import pathlib
    src, ck = str(tmp_path / "src"), tmp_path / "ck"
    table = _table(spark, tmp_path)
    rows = [(f"c{i}", i, f"2023-0{1 + i % 3}", "R") for i in range(30)]
    seen = []

    def sink(df, batch_id):
        seen.append(batch_id)
        table.write(df, batch_id)

    def run():
        LS.run_batches(spark.readStream.schema(LAKE).parquet(src), sink, str(ck))

    for part in (rows[:10], rows[10:]):
        _rows(spark, part).write.mode("append").parquet(src)
        run()
    for f in pathlib.Path(ck / "commits").iterdir():
        if f.name.strip(".").split(".")[0] == "1":
            f.unlink()
    run()
    assert seen == [0, 1, 1]
    assert _content(table) == sorted(rows, key=str)


def test_trend_rewrites_only_touched_months(spark, tmp_path):
    rng = random.Random(1)
    trend = LS.Trend(spark, str(tmp_path / "trend"))
    schema = "disease string, country_code string, region_name string, report_month string, new_cases int"
    batches = [[(rng.choice("AB"), rng.choice(["KE", None]), rng.choice("xy"), f"2023-0{rng.randint(a, a + 1)}", rng.choice([None, 1, 5, -2]))
                for _ in range(80)] for a in (1, 2, 5)]
    for k, rows in enumerate(batches):
        assert trend.add(_rows(spark, rows, schema), k)
        assert not trend.add(_rows(spark, rows, schema), k)
    want: dict = {}
    for r in [r for rows in batches for r in rows]:
        for size in (4, 3, 2, 1):
            key = r[:size] + (None,) * (4 - size) + ((1 << (4 - size)) - 1,)
            cases, n = want.get(key, (None, 0))
            want[key] = (cases if r[4] is None else (cases or 0) + r[4], n + 1)
    got = {(r.disease, r.country_code, r.region_name, r.report_month, r.grouping_level): (r.cases, r.n_reports) for r in trend.rollup().collect()}
    assert got == want
    written = {(r.report_month, r._batch) for r in trend.table.ledger().collect()}
    assert written == {(r[3], k) for k, rows in enumerate(batches) for r in rows}


def test_late_rows_are_kept(spark, tmp_path):
    rng = random.Random(2)
    d0 = dt.date(2023, 1, 1)
    batches = []
    for k in range(4):
        batches.append([(f"{k}-{i}", d0, d0 + dt.timedelta(days=rng.randint(20 * k - 25, 20 * k + 20)), rng.choice("MC"), "HOT" if i % 3 else "G", rng.choice([None, 2]))
                        for i in range(200)])
        batches[-1].append((f"{k}-null", d0, None, "M", None, 1))
    batches.insert(2, [])
    schema = spark.createDataFrame([], CASE).schema
    for k, rows in enumerate(batches):
        counts = LS.DailyCounts(spark, str(tmp_path / "counts"), schema, "case_date")
        counts.add(_rows(spark, rows, CASE), k)
        if k == 1:
            counts.add(_rows(spark, rows, CASE), k)  # a replay
    late, days, last = [], {}, None
    for rows in batches:
        mark = last - dt.timedelta(days=14) if last else None
        for r in rows:
            if r[2] is None or (mark and r[2] + dt.timedelta(days=1) <= mark):
                late.append(r)
            else:
                n, c = days.get((r[2], r[3], r[4]), (0, None))
                days[r[2], r[3], r[4]] = (n + 1, c if r[5] is None else (c or 0) + r[5])
        last = max([r[2] for r in rows if r[2]] + ([last] if last else []), default=None)
    assert sorted((tuple(r) for r in counts.late().collect()), key=str) == sorted(late, key=str) and len(late) > 10
    upto = last - dt.timedelta(days=14)
    got = {(r.event_day, r.disease, r.geography_id): (r.n_reports, r.cases) for r in counts.final().collect()}
    assert got == {k: v for k, v in days.items() if k[0] + dt.timedelta(days=1) <= upto}
    rest = {(r.event_day, r.disease, r.geography_id): (r.n_reports, r.cases) for r in counts.still_open().collect()}
    assert rest == {k: v for k, v in days.items() if k[0] + dt.timedelta(days=1) > upto}
    assert counts.final().agg(F.sum("n_reports")).first()[0] + sum(n for n, _ in rest.values()) + len(late) == sum(map(len, batches))
