"""Boundary rows for single operators (inline data)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from epilake import fixed as X
from epilake.functions import measures as M
from epilake.operators import climate as C
from epilake.operators import facilities as FA
from epilake.operators import outbreaks as O
from epilake.operators.generic import first_per_key, repeat_rows, sample_n, sequence_id

D0 = dt.date(2021, 3, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def col(df, name):
    return [r[name] for r in df.collect()]


def test_temp_band(spark):
    vals = [19.9, 20.0, 24.9, 25.0, 30.0, 30.1, 35.0, 35.1, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, t double")
    got = col(df.select("i", M.temp_band("t").alias("f")).orderBy("i"), "f")
    assert got == [0.5, 1.0, 1.0, 1.5, 1.5, 1.0, 1.0, 0.5, 0.5]


def test_tb_season(spark):
    df = spark.createDataFrame([(m,) for m in [5, 6, 8, 9]], "m int")
    assert col(df.select(M.tb_season("m").alias("f")), "f") == [1.0, 1.2, 1.2, 1.0]


def test_outbreak_curve(spark):
    df = spark.createDataFrame([(a,) for a in [0, 8, 18, 28]], "a int")
    got = col(df.select(M.outbreak_curve("a").alias("c")), "c")
    assert got == pytest.approx([math.exp(-1.62), math.exp(-0.5), 1.0, math.exp(-0.5)])


def test_malaria_rain_factor(spark):
    df = spark.createDataFrame([(0, None), (3, None), (5, 500.0)], "h long, r double")
    assert col(df.select(M.malaria_rain_factor("h", "r").alias("f")), "f") == [1.0, 1.0, 2.0]


def test_expected_null_population_is_zero(spark):
    df = spark.createDataFrame([(None, True, 4)], "p double, u boolean, m int")
    assert col(df.select(M.expected_tb("p", "u", "m").alias("e")), "e") == [0.0]


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(0, None), (1, -1.0), (2, 250.0)], "i int, x double")
    got = col(df.select("i", M.clamp("x", 0.0, 200.0).alias("c")).orderBy("i"), "c")
    assert got == [None, 0.0, 200.0]


def test_rint_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert col(df.select(F.rint("x").alias("r")), "r") == [0.0, 2.0, 2.0]


def test_repeat_rows(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 3)], "k string, n int")
    out = repeat_rows(df, "n").groupBy("k").count()
    assert {r.k: r["count"] for r in out.collect()} == {"b": 1, "c": 3}


def test_trailing_rain_window(spark):
    rows = [("G", day(0), 10.0)] + [("G", day(n), 0.0) for n in (1, 21, 22)]
    clim = spark.createDataFrame(rows, "geography_id string, obs_date date, rainfall_mm double")
    out = C.with_rain_history(clim).orderBy("obs_date").collect()
    by_day = {(r.obs_date - D0).days: (r.rain_21d, r.history_days) for r in out}
    assert by_day[0] == (None, 0)
    assert by_day[1] == (10.0, 1)
    assert by_day[21] == (10.0, 2)
    assert by_day[22] == (0.0, 2)      # day 0 left the frame; days 1 and 21 remain


def _outbreak_fixture(spark, fake, query_days, trig_facility="FAC-00002"):
    geo = spark.createDataFrame([("G", 1000.0, "Rural")], "geography_id string, population double, urban_rural string")
    clim_rows = [("G", day(n), 100.0 if n == 0 else 0.0, 20.0, 25.0, 50.0) for n in sorted(set(query_days) | {0})]
    clim = spark.createDataFrame(clim_rows, "geography_id string, obs_date date, rainfall_mm double, "
                                            "temperature_min_c double, temperature_max_c double, humidity_pct double")
    case = spark.createDataFrame([(trig_facility, "G", day(0), "Cholera", 3)],
                                 "facility_id string, geography_id string, report_date date, disease string, "
                                 "new_cases int")
    return fake(spark, geography=geo, climate=clim, case=case)


def test_active_daily_age_window(spark, fake):
    b = _outbreak_fixture(spark, fake, [1, 59, 60])
    out = {(r.obs_date - D0).days: r.outbreak_start for r in O.active_daily(b).collect()}
    assert out[0] == day(0) and out[1] == day(0) and out[59] == day(0)
    assert out[60] is None


def test_interval_join_start_day_order(spark, fake):
    b = _outbreak_fixture(spark, fake, [1])
    fd = spark.createDataFrame([(f, "G", day(0)) for f in ["FAC-00001", "FAC-00002", "FAC-00003"]]
                               + [("FAC-00001", "G", day(1))],
                               "facility_id string, geography_id string, obs_date date")
    out = {(r.facility_id, (r.obs_date - D0).days): r.outbreak_start
           for r in O.active_for_facility_days(b, fd).collect()}
    assert out[("FAC-00001", 0)] is None
    assert out[("FAC-00002", 0)] is None
    assert out[("FAC-00003", 0)] == day(0)
    assert out[("FAC-00001", 1)] == day(0)


def test_type_mix_density_boundaries(spark):
    dens = [0.0, 0.5, 10.0, 10.5, 1000.0, 1000.5]
    geo = spark.createDataFrame([(f"g{i}", "Rural", d) for i, d in enumerate(dens)],
                                "geography_id string, urban_rural string, population_density double")
    mix = FA.type_mix(geo)
    types = {}
    for r in mix.collect():
        types.setdefault(r.geography_id, set()).add(r.facility_type)
    assert types["g0"] == {"Health Center", "Clinic", "Dispensary"}        # fallback
    assert types["g1"] == {"Dispensary"} and types["g2"] == {"Dispensary"}
    assert types["g3"] == {"Dispensary", "Clinic"}
    assert len(types["g4"]) == 5 and len(types["g5"]) == 6
    sums = mix.groupBy("geography_id").agg(F.sum("type_share").alias("s")).collect()
    assert all(abs(r.s - 1.0) < 1e-12 for r in sums)


def test_type_mix_urban_weights(spark):
    geo = spark.createDataFrame([("u", "Urban", 1000.5)], "geography_id string, urban_rural string, "
                                                           "population_density double")
    w = sorted(col(FA.type_mix(geo), "weight"))
    assert w == [1.0, 2.0, 3.0, 15.0, 24.0, 30.0]


def test_allocation_rounding_and_floor(spark):
    # weights 1, 3, 5, 7 (sum 16) with total 8 give exactly 0.5, 1.5, 2.5, 3.5
    geo = spark.createDataFrame([("a", "Rural", 1.0), ("b", "Rural", 3.0), ("c", "Rural", 5.0), ("d", "Rural", 7.0)],
                                "geography_id string, urban_rural string, population_density double")
    out = {r.geography_id: r.n_facilities for r in FA.allocation(geo, total=8).collect()}
    assert out == {"a": 1, "b": 2, "c": 2, "d": 4}


def test_allocation_urban_doubles_and_null_density(spark):
    geo = spark.createDataFrame([("u", "Urban", 1.0), ("r", "Rural", 1.0), ("n", "Rural", None)],
                                "geography_id string, urban_rural string, population_density double")
    out = {r.geography_id: (r.weight, r.n_facilities) for r in FA.allocation(geo, total=3).collect()}
    assert out == {"u": (2.0, 2), "r": (1.0, 1), "n": (0.0, 1)}


def test_district_quota_n30(spark):
    rows = [(f"{cc}{i}", cc, name) for cc, names in X.REGIONS.items() for i, name in enumerate(names)]
    geo = spark.createDataFrame(rows, "geography_id string, country_code string, region_name string")
    q = FA.district_quota(geo, 30).collect()
    tot = {}
    for r in q:
        tot[r.country_code] = tot.get(r.country_code, 0) + r.region_districts
    assert tot == {"KE": 9, "NG": 8, "ZA": 8}
    first = {r.region_name: r.region_districts for r in q if r.region_idx == 1}
    assert first == {"Nairobi": 3, "Lagos": 2, "Gauteng": 2}


def test_district_quota_missing_and_unknown_regions(spark):
    """A missing region changes no other's quota; unknown countries and regions follow in name order."""
    rows = [("k", "KE", "Western"), ("k", "KE", "Nairobi"), ("x", "XX", "B"), ("x", "XX", "A"), ("k", "KE", "Atlantis")]
    geo = spark.createDataFrame(rows, "geography_id string, country_code string, region_name string")
    got = {(r.country_code, r.region_name): (r.n_regions, r.region_idx, r.region_districts) for r in FA.district_quota(geo, 30).collect()}
    assert got == {("KE", "Nairobi"): (7, 1, 3), ("KE", "Western"): (7, 6, 1), ("KE", "Atlantis"): (7, 8, 1),
                   ("XX", "A"): (2, 1, 0), ("XX", "B"): (2, 2, 1)}


def test_climate_normal(spark):
    geo = spark.createDataFrame([("G", -3.0, "Coast")], "geography_id string, latitude double, region_name string")
    clim = spark.createDataFrame([("G", dt.date(2021, 12, 31), 20.0, 25.0)],
                                 "geography_id string, obs_date date, temperature_min_c double, "
                                 "temperature_max_c double")
    n = C.normals(clim, geo).collect()[0]
    assert n.is_coastal and n.temp_normal_c == pytest.approx(29.0)


def test_rain_regime(spark):
    geo = spark.createDataFrame([(cc, cc) for cc in ["KE", "NG", "ZA", "XX"]], "geography_id string, country_code string")
    clim = spark.createDataFrame([(cc, dt.date(2021, 4, 10), 1.0, 50.0) for cc in ["KE", "NG", "ZA", "XX"]],
                                 "geography_id string, obs_date date, rainfall_mm double, humidity_pct double")
    got = {r.country_code: r.rainy_season for r in C.rain_regime(clim, geo).collect()}
    assert got == {"KE": True, "NG": True, "ZA": False, "XX": False}


def test_first_per_key_total_order(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "z"), ("k", 1, "a"), ("j", 5, "x")],
                               "key string, o int, v string")
    got = {r.key: (r.o, r.v) for r in first_per_key(df, ["key"], ["o"]).collect()}
    assert got == {"k": (1, "a"), "j": (5, "x")}


def test_sequence_id_dense_in_order(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("x"))
    out = sequence_id(df, ["x"], "seq", num_partitions=5).collect()
    assert sorted((r.x, r.seq) for r in out) == [(i, i + 1) for i in range(1000)]


def test_sample_n_deterministic(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "k")
    a = [r.k for r in sample_n(df, 10, ["k"], 42).collect()]
    b = [r.k for r in sample_n(df.repartition(7), 10, ["k"], 42).collect()]
    assert a == b and len(set(a)) == 10


def test_cluster_settings_scale():
    from epilake.session import cluster_settings
    small = cluster_settings(10 * 1024 ** 2)
    assert small["spark.sql.shuffle.partitions"] == "200"
    big = cluster_settings(100 * 1024 ** 4)        # 100 TiB read
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 1024 ** 4 // (256 * 1024 ** 2)
    assert big["spark.sql.files.maxPartitionBytes"] == "256m"


def test_outbreak_curve_table_matches_formula(spark):
    from epilake.operators.outbreaks import outbreak_curve_table
    t = outbreak_curve_table(spark)
    rows = t.select("age_days", "outbreak_curve", M.outbreak_curve("age_days").alias("f")).collect()
    assert sorted(r.age_days for r in rows) == list(range(60))
    assert all(abs(r.outbreak_curve - r.f) <= 1e-15 for r in rows)


def test_rain_history_sums_repeated_days(spark):
    """Every row of the days before counts; the day's own row is the first one."""
    d = dt.date(2021, 3, 1)
    rows = [("G", d, 20.0, 25.0, 10.0, 50.0), ("G", d, 20.0, 25.0, 20.0, 50.0), ("G", d + dt.timedelta(1), 20.0, 25.0, 1.0, 50.0)]
    clim = spark.createDataFrame(rows, "geography_id string, obs_date date, temperature_min_c double, "
                                       "temperature_max_c double, rainfall_mm double, humidity_pct double")
    got = sorted((r.obs_date, r.rainfall_mm, r.rain_21d, r.history_days) for r in C.climate_features(clim).collect())
    assert got == [(d, 10.0, None, 0), (d + dt.timedelta(1), 1.0, 30.0, 2)]


def test_facility_order_is_numeric(spark):
    rows = spark.createDataFrame([("FAC-99999",), ("FAC-100000",), ("FAC-00007",)], "id string")
    assert [r.id for r in rows.orderBy(O.facility_order("id")).collect()] == ["FAC-00007", "FAC-99999", "FAC-100000"]


def test_scd2_nulls_and_second_merge(spark):
    from epilake.operators import warehouse as WH
    schema = "facility_id string, capacity int, staff_count int, operational_status string, facility_type string"
    first = spark.createDataFrame([("F1", None, 5, "Operational", "Clinic"), ("F2", 3, 4, "Operational", "Clinic")], schema)
    later = spark.createDataFrame([("F1", 5, None, "Operational", "Clinic"), ("F2", 3, 4, "Operational", "Clinic")], schema)
    history = WH.scd2(first.withColumn("valid_from", F.lit(dt.date(2020, 1, 1))), later, dt.date(2021, 1, 1))
    assert sorted((r.facility_id, r.change_type, r.is_current) for r in history.collect()) == [
        ("F1", "changed", True), ("F1", "closed", False), ("F2", "unchanged", True)]
    merged = WH.scd2_merge(history, later.filter("facility_id = 'F1'"), dt.date(2022, 1, 1)).collect()
    assert sorted((r.facility_id, r.change_type, r.is_current, str(r.valid_to)) for r in merged) == [
        ("F1", "history", False, "2021-01-01"), ("F1", "unchanged", True, "None"), ("F2", "deleted", False, "2022-01-01")]
