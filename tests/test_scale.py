"""Work that grows with the input is dealt to tasks that grow with it (findings of round 3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from epilake.functions import measures as M
from epilake.operators import incidence as I

D0 = dt.date(2021, 3, 1)
N = 3 * I.FACILITIES_PER_TASK


@pytest.fixture
def panel(spark, fake):
    """One file of facilities (one task) in a geography with three days of climate, an outbreak from the first day."""
    days = [("G", D0 + dt.timedelta(days=i), 100.0 if i == 0 else 0.0, 20.0, 25.0, 50.0) for i in range(3)]
    fac = spark.range(N).coalesce(1).select(
        F.format_string("FAC-%05d", "id").alias("facility_id"), F.lit("G").alias("geography_id"), F.lit("Operational").alias("operational_status"))
    b = fake(
        spark, facility=fac,
        geography=spark.createDataFrame([("G", 100000.0, "Rural")], "geography_id string, population double, urban_rural string"),
        climate=spark.createDataFrame(days, "geography_id string, obs_date date, rainfall_mm double, temperature_min_c double, "
                                            "temperature_max_c double, humidity_pct double"),
        case=spark.createDataFrame([("FAC-00001", "G", D0, "Cholera", 3)],
                                   "facility_id string, geography_id string, report_date date, disease string, new_cases int"))
    b.geo_day_side = F.broadcast  # as Bindings does below its bound
    return b


def tasks(df) -> int:
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_outbreak_facility_days_are_dealt_by_facilities(panel):
    rows = I.facility_days_outbreaks(panel)
    assert tasks(rows) == 3
    by_age = {(r.age_days, r.outbreak_curve): r.n for r in rows.groupBy("age_days", "outbreak_curve").agg(F.count(F.lit(1)).alias("n")).collect()}
    # on the day itself the outbreak holds for the facilities behind the first one that reported
    assert by_age == {(None, None): 2, (0, M.outbreak_curve_value(0)): N - 2, (1, M.outbreak_curve_value(1)): N, (2, M.outbreak_curve_value(2)): N}


@pytest.mark.parametrize("measure", [I.expected_tb, I.expected_malaria])
def test_expected_facility_days_are_dealt_by_facilities(panel, measure):
    rows = measure(panel)
    assert tasks(rows) == 3 and rows.count() == 3 * N


def test_spine_is_dealt_by_facilities(panel):
    from epilake.plans.q_cases import facility_day_spine
    rows = facility_day_spine(panel)
    assert tasks(rows) == 3 and rows.count() == 3 * N


def test_first_rows_reads_the_table_once_a_column(spark):
    """The cut is looked for in the counts of a column's values, however many there are."""
    from epilake.operators.generic import first_rows
    read = spark.sparkContext.accumulator(0)
    rows = spark.sparkContext.parallelize([(i % 2000, i) for i in range(4000)], 2).map(lambda r: read.add(1) or r)
    got = first_rows(spark.createDataFrame(rows, "a int, b int"), 1001, ["a", "b"])
    assert read.value == 2 * 4000
    assert sorted(tuple(r) for r in got.collect()) == sorted([(i % 2000, i) for i in range(4000) if i % 2000 < 500] + [(500, 500)])


def test_sample_hashes_each_row_once(spark):
    from epilake.operators.generic import sample_n
    df = spark.range(10).select(F.col("id").cast("string").alias("k"))
    top = [x for x in sample_n(df, 3, ["k"])._jdf.queryExecution().executedPlan().toString().split("\n") if "TakeOrderedAndProject" in x][0]
    assert "md5" not in top


def test_sorted_files_grow_with_the_rows_and_are_proved_by_pieces(spark, tmp_path):
    from pyspark.sql import types as T
    from epilake.sources import lake as L
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).cast("int").alias("a"), F.lit("x").alias("b"))
    path = L.write_csv_sorted(df, f"{tmp_path}/good", ["a", "b"], file_rows=50)
    manifest = L.sorted_manifest(spark, path, schema, ["a", "b"], piece_bits=3)
    assert manifest.count() > 10  # 4 shuffle partitions
    got = L.prove_order(manifest).first()
    assert (got.n_rows, got["first"].a, got["last"].a, got.in_order) == (1000, 0, 999, True)
    for name, rows in (("inside", [1, 2, 4, 3]), ("between", list(range(8, 16)) + list(range(8)))):  # the latter: pieces in order alone
        L.write_csv(spark.createDataFrame([(a, "x") for a in rows], schema).coalesce(1), f"{tmp_path}/{name}")
        assert not L.prove_order(L.sorted_manifest(spark, f"{tmp_path}/{name}", schema, ["a", "b"], piece_bits=3)).first().in_order


def test_expected_count_is_evaluated_once(spark):
    assert str(M.positive_or_zero(F.col("counted"))).count("counted") == 1
    df = spark.createDataFrame([(0, None), (1, -1.0), (2, -0.0), (3, 2.5), (4, float("nan"))], "i int, e double")
    assert [str(r.p) for r in df.select("i", M.positive_or_zero(F.col("e")).alias("p")).orderBy("i").collect()] == ["0.0", "0.0", "0.0", "2.5", "nan"]


def test_excess_panel_is_unpivoted_without_objects_and_stored_narrow(spark):
    """reports join no facility, no array is built a facility-day, and the bucketed panel holds what the join reads."""
    from epilake.plans.catalog import all_queries
    for key in ("excess_cases", "excess_cases_bucketed"):
        df = all_queries()[key](spark, "/root/testdata/sf0.001")
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        assert "explode(" not in plan and "Expand" in plan
        if key == "excess_cases":
            scans = [x for x in plan.split("\n\n") if "Scan parquet" in x and "/facility]" in x]
            assert not any("s_suppkey" in x for x in scans)
        else:
            scans = [x for x in plan.split("\n\n") if "Bucketed: true" in x]
            assert scans
    stored = [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_") and "Malaria" in spark.table(t.name).columns]
    assert stored and all(spark.table(t.name).columns == ["facility_id", "obs_date", "Malaria", "Cholera", "Tuberculosis"] for t in stored)


def test_checked_read_stays_in_generated_code(spark, tmp_path):
    """the steps of a checked read are in generated code, and no field is typed more than once a line."""
    from epilake.sources import lake as L
    L.write_csv(spark.createDataFrame([(D0, 1)], "day date, n int"), str(tmp_path / "x"))
    rows = L.read_csv_checked(spark, str(tmp_path / "x"), spark.createDataFrame([], "day date, n int").schema)
    good = L.split_checked(rows)[0]
    plan = spark._jvm.PythonSQLUtils.explainString(good._jdf.queryExecution(), "formatted")
    filters = [line for line in plan.split("\n") if line.startswith("(") and ") Filter" in line]
    assert filters and all("codegen id" in line for line in filters)
    assert plan.count("try_cast(_text_0") == 1
    assert [tuple(r) for r in good.collect()] == [(D0, 1)]


def test_released_sessions_leave_the_store(spark, tmp_path):
    """the store of `dedupe_first` is compacted at each commit, whatever the session had set."""
    from epilake.streaming import streams as ST
    rows = spark.createDataFrame([("a", D0)], "case_id string, report_date date")
    rows.write.parquet(str(tmp_path / "in"))
    names = [f"spark.sql.streaming.stateStore.{x}" for x in ("providerClass", "rocksdb.compactOnCommit", "rocksdb.trackTotalNumberOfRows")]
    for name in names:
        spark.conf.unset(name)
    assert ST.dedupe_first(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).columns == rows.columns
    assert [spark.conf.get(name) for name in names] == [ST.ROCKSDB, "true", "false"]


CASE_SCHEMA = ("case_id string, report_date date, case_date date, facility_id string, geography_id string, disease string, "
               "new_cases int, deaths int, recoveries int, age_group string, gender string")


def cases_of(spark, rows):
    """Cases of (case id, facility, new cases, deaths, age group); the rest is alike."""
    return spark.createDataFrame([(i, D0, D0, f, "G", "Malaria", n, d, 0, age, "M") for i, f, n, d, age in rows], CASE_SCHEMA)


def test_report_reads_the_cases_once_and_makes_no_row_a_violation(spark):
    """violations of cases and their repeated ids are counted by case id in one pass."""
    from epilake.plans.catalog import all_queries
    plan = spark._jvm.PythonSQLUtils.explainString(all_queries()["dq_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution(), "formatted")
    assert plan.count("lineitem.parquet]") == 1


def test_rules_are_counted_by_record(spark):
    from epilake.operators import quality as Q
    rows = [("a", "F", 1, 2, "x"), ("a", "F", 1, 2, "0-5"), ("b", "F", None, None, "x"), (None, "F", -1, 0, "0-5"), (None, "F", -1, 0, "0-5"), ("c", "F", 5, 0, "0-5")]
    df, rules = cases_of(spark, rows), [r for group in Q.case_rules().values() for r in group]
    got = {r.rule: (r.n_violations, r.n_records) for r in Q.count_rules(df, "case", "case_id", rules).collect()}
    made = Q.emit(df, "case", F.col("case_id"), rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record_key").alias("k"))
    expected = {r.rule: (r.n, r.k) for r in made.collect()} | {"duplicate_key": (2, 1)}
    assert got == expected and got["negative_count"] == (2, 0) and got["bad_domain"] == (2, 2)
    assert Q.count_rules(df.limit(0), "case", "case_id", rules).count() == 0


def test_quarantine_is_the_cases_without_the_clean_ones(spark, fake):
    """no join and no second search for the first rows; equal and unequal copies, bad rows and null ids stay."""
    from epilake.operators import quality as Q
    rows = [("a", "F", 4, 0, "0-5")] * 3 + [("a", "E", 4, 0, "0-5"), ("b", "F", -1, 0, "x"), ("b", "F", -1, 0, "x"), (None, "F", 4, 0, "0-5"), (None, "E", 4, 0, "0-5")]
    b = fake(spark, case=cases_of(spark, rows))
    clean = spark.createDataFrame(Q.clean_cases(b).collect(), CASE_SCHEMA)
    held = Q.quarantined_cases(b, clean)
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "min(" not in plan
    got = sorted((r.case_id or "", r.facility_id, r.reasons) for r in held.collect())
    assert got == [("", "F", "duplicate_key")] + [("a", "F", "duplicate_key")] * 3 + [("b", "F", "negative_count,deaths_gt_cases,outcomes_gt_cases,bad_domain")] * 2
    assert held.exceptAll(Q.quarantined_cases(b)).count() == 0


def test_days_are_dealt_by_month(spark):
    """a month has as many tasks as its rows need, short months share one; rows without a day are kept."""
    from epilake.operators.generic import spread_by_month
    days = spark.range(120).select(F.date_add(F.lit(dt.date(2021, 1, 1)), F.col("id").cast("int")).alias("day"))
    df = days.crossJoin(spark.range(10).select(F.col("id").cast("string").alias("key"))).unionByName(spark.createDataFrame([(None, "0")], "day date, key string"))
    groups = lambda rows: rows.select(F.spark_partition_id().alias("p"), F.month("day").alias("m")).distinct().collect()
    many = spread_by_month(df, "day", "key", 1201, days, 100)
    assert many.count() == 1201 and many.rdd.getNumPartitions() == 16  # 310 rows a month: four tasks each
    assert all(len({r.m for r in groups(many) if r.p == p and r.m}) <= 1 for p in range(16))
    few = spread_by_month(df, "day", "key", 1201, days, 10_000)
    assert few.count() == 1201 and len({r.p for r in groups(few)}) == 4
    assert spread_by_month(df, "day", "key", 0, days.limit(0), 100).count() == 1201


def test_hashed_excess_has_the_same_rows(spark, monkeypatch):
    """in the batch job neither the panel nor the reports are sorted, and tasks grow with the reports."""
    from epilake.plans import q_cases
    from epilake.plans.q_outbreaks import expected_wide
    from epilake.sources.bind import Bindings
    b = Bindings(spark, "/root/testdata/sf0.001")
    wide, n = expected_wide(b), b.reports().count()
    monkeypatch.setattr(q_cases, "HASHED_REPORTS", -(-n // 7))
    hashed, same = q_cases.excess(b, wide, n_reports=n), q_cases.excess(b, wide)
    plan = spark._jvm.PythonSQLUtils.explainString(hashed._jdf.queryExecution(), "formatted")
    assert "ShuffledHashJoin FullOuter" in plan and "SortMergeJoin FullOuter" not in plan
    assert plan.count(", 7), REPARTITION_BY_NUM") == 2
    assert hashed.count() == same.count() and hashed.exceptAll(same).count() == 0


def test_steps_of_the_batch_job_run_at_once(spark, monkeypatch, tmp_path):
    """the report and the facility-days are under way at the same time; a step that fails ends the job with its error."""
    from threading import Barrier

    from epilake.operators import quality as Q
    from epilake.operators import warehouse as W
    from epilake.plans import q_outbreaks
    from epilake.plans.batch_job import build_surveillance
    both, met = Barrier(2, timeout=30), []

    def step(name, meet=True):
        def run(b):
            if meet:
                both.wait()
            met.append(name)
            raise RuntimeError(f"step {name}")
        return run
    monkeypatch.setattr(Q, "report", step("report"))
    monkeypatch.setattr(q_outbreaks, "expected_wide", step("wide"))
    monkeypatch.setattr(W, "fact_surveillance", step("fact", meet=False))
    with pytest.raises(RuntimeError, match="step report"):
        build_surveillance(spark, "/root/testdata/sf0.001", str(tmp_path))
    assert sorted(met) == ["fact", "report", "wide"]
