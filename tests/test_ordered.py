"""As-of join and gap intervals against plain Python, with a key that fills most ranges."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from epilake.operators import ordered as O
from epilake.operators import warehouse as WH

D0 = dt.date(2023, 1, 1)


def day(n):
    return None if n is None else D0 + dt.timedelta(days=n)


@pytest.fixture(params=[1, 7])
def ranges(spark, request):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_asof_join(spark, ranges):
    rng = random.Random(3)
    versions, facts = [], []
    for k in ["HOT", *(f"F{i}" for i in range(12)), "none"]:
        at = rng.randint(0, 30)
        for v in range(0 if k == "none" else rng.randint(1, 5)):
            end = at + rng.randint(1, 60)
            open_end = rng.random() < 0.2
            versions.append((k, day(at), None if open_end else day(end), f"{k}-{v}", rng.choice([None, v])))
            if open_end:
                break
            at = end + rng.choice([0, 0, 5])
    versions += [(None, day(1), None, "null key", 1), ("F1", None, None, "null start", 1)]
    for i in range(1500):
        k = "HOT" if i % 3 else rng.choice(["F0", "F3", "F11", "none", "other", None])
        facts.append((k, rng.choice([None, *map(day, range(0, 220))]) if i % 50 == 0 else day(rng.randint(0, 220)), i, "clash"))
    facts += [facts[0]] * 3
    f = spark.createDataFrame(facts, "key string, day date, id int, name string")
    v = spark.createDataFrame(versions, "key string, valid_from date, valid_to date, label string, n int")
    got = O.asof_join(f, v, "key", "day", payload=["label", "n"])
    assert got.columns == ["key", "day", "id", "name", "label", "n"]
    want = []
    for k, d, i, name in facts:
        hit = [x for x in versions if x[0] is not None and x[0] == k and x[1] is not None and d is not None and x[1] <= d and (x[2] is None or d < x[2])]
        assert len(hit) <= 1
        want.append((k, d, i, name, *(hit[0][3:] if hit else (None, None))))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert O.asof_join(f.limit(0), v, "key", "day", payload=["label"]).count() == 0
    assert O.asof_join(f, v.limit(0), "key", "day", payload=["label"]).where("label is not null").count() == 0


def test_history_of_three_extracts_and_hash(spark):
    schema = "facility_id string, capacity int, staff_count int, operational_status string, facility_type string"
    one = [("A", 1, 1, "x", "t"), ("B", 1, 1, "x", "t"), ("C", 1, None, "a|b", "t")]
    two = [("A", 1, 1, "x", "t"), ("B", 2, 1, "x", "t"), ("C", 1, None, "a", "b|t"), ("D", 1, 1, "x", "t")]
    three = [("B", 2, 1, "x", "t"), ("C", 1, None, "a", "b|t"), ("D", 1, 1, "x", "t"), ("A", None, 1, "x", "t")][:3]
    extracts = [(day(10 * i), spark.createDataFrame(rows, schema)) for i, rows in enumerate((one, two, three))]
    got = {(r.facility_id, r.valid_from): (r.capacity, r.operational_status, r.valid_to, r.is_current) for r in WH.history_of(extracts).collect()}
    assert got == {("A", day(0)): (1, "x", day(20), False), ("B", day(0)): (1, "x", day(10), False), ("B", day(10)): (2, "x", None, True),
                   ("C", day(0)): (1, "a|b", day(10), False), ("C", day(10)): (1, "a", None, True), ("D", day(10)): (1, "x", None, True)}


def test_gaps(spark, ranges):
    rng = random.Random(5)
    keys = ["HOT", "A", "B", "empty", "full"]
    seen = {(k, n) for k in keys[:3] for n in range(0, 300) if rng.random() < (0.9 if k == "HOT" else 0.3)} | {("full", n) for n in range(5, 251)}
    rows = [(k, day(n)) for k, n in seen] + [("other", day(7)), ("A", None), (None, day(9)), ("A", day(20)), ("A", day(20))]
    seen.add(("A", 20))
    df = spark.createDataFrame(rows, "g string, d date")
    want = []
    for k in keys:
        missing = [n for n in range(5, 251) if (k, n) not in seen]
        for n in missing:
            if n - 1 in missing:
                want[-1][2] = n
            else:
                want.append([k, n, n])
    got = O.gaps(spark.createDataFrame([(k,) for k in keys], "g string"), "g", df, "d", F.lit(day(5)), F.lit(day(250)))
    assert sorted(tuple(r) for r in got.collect()) == sorted((k, day(a), day(b), b - a + 1) for k, a, b in want)


def test_intervals_expand_to_the_missing_days(spark):
    from conftest import SF_SMALL
    from epilake.plans.catalog import all_queries
    qs = all_queries()
    days = qs["climate_gap_intervals"](spark, SF_SMALL).select("geography_id", F.explode(F.sequence("gap_start", "gap_end")).alias("obs_date"))
    missing = qs["climate_panel_gaps"](spark, SF_SMALL)
    assert days.count() == missing.count() > 0 and days.exceptAll(missing).count() == 0
