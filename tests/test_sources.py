"""Sources: reading a geography file in the generator's CSV layout (invented rows)."""

import pytest
from pyspark.sql import functions as F

from epilake.operators import facilities as FA
from epilake.sources import lake as L

# Invented rows in the generator's layout: counts printed as floats because a
# missing value made the column float; one population is missing.
GEOGRAPHY_CSV = """geography_id,country_code,country_name,region_name,district_name,sub_district_name,population,urban_rural,latitude,longitude,population_density
KE-AAA-001,KE,Kenya,Alpha,Alpha District 1,Alpha District 1 Sub-district 1,16000.0,Rural,1.5,36.25,40.0
KE-AAA-002,KE,Kenya,Alpha,Alpha District 1,Alpha District 1 Sub-district 2,,Urban,-2.0,37.0,350.0
NG-BBB-003,NG,Nigeria,Beta,Beta District 1,Beta District 1 Sub-district 1,120000.0,Urban,9.0,7.5,800.0
ZA-CCC-004,ZA,South Africa,Gamma,Gamma District 1,Gamma District 1 Sub-district 1,8000.0,Rural,-30.0,25.0,0.0
"""


@pytest.fixture
def geography_csv(tmp_path):
    p = tmp_path / "geography.csv"
    p.write_text(GEOGRAPHY_CSV)
    return str(p)


def test_read_generator_layout(spark, geography_csv):
    g = L.read_csv(spark, geography_csv, L.REFERENCE_GEOGRAPHY_READ)
    rows = {r.geography_id: r for r in g.collect()}
    assert len(rows) == 4
    assert rows["KE-AAA-001"].population == 16000.0
    assert rows["KE-AAA-002"].population is None            # empty field -> NULL, never NaN
    assert g.agg(F.sum("population")).first()[0] == 144000.0  # sum skips the null
    # counts read as double, cast afterwards without error
    assert g.select(F.col("population").try_cast("int").alias("p")).filter("p = 120000").count() == 1


def test_allocation_on_generator_layout(spark, geography_csv):
    g = L.read_csv(spark, geography_csv, L.REFERENCE_GEOGRAPHY_READ)
    out = {r.geography_id: r.n_facilities for r in FA.allocation(g, total=100).collect()}
    # weights 40, 700 (urban x2), 1600 (urban x2), 0 -> rint(w / 2340 * 100); 0 becomes 1
    assert out == {"KE-AAA-001": 2, "KE-AAA-002": 30, "NG-BBB-003": 68, "ZA-CCC-004": 1}


DIRTY = """id,day,n,flag,rate
a,2023-01-05,3,true,1.5
b,2023-01-06,4.0,false,
c,,,,
d,2023-13-40,5,true,1
e,2023-1-5,5,true,1
f,2023-01-07,1.5,maybe,x
g,2023-01-07,99999999999,true,1
h,2023-01-07,1,true
i,2023-01-07,1,true,2,3

id,day,n,flag,rate
"quoted, text",2023-01-08,7,TRUE,1e3
"open quote,2023-01-08,7,true,1
j,2023-01-08,NaN,true,NaN
"""


def test_checked_read_names_every_bad_line(spark, tmp_path):
    import datetime as dt
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.csv").write_text(DIRTY)
    schema = spark.createDataFrame([], "id string, day date, n int, flag boolean, rate double").schema
    rows = L.read_csv_checked(spark, str(tmp_path), schema)
    good, bad = L.split_checked(rows)
    assert sorted(tuple(r) for r in good.collect()) == [
        ("a", dt.date(2023, 1, 5), 3, True, 1.5), ("b", dt.date(2023, 1, 6), 4, False, None), ("c", None, None, None, None),
        ("quoted, text", dt.date(2023, 1, 8), 7, True, 1000.0)]
    got = {r.line: r.reasons for r in bad.collect()}
    assert got == {"d,2023-13-40,5,true,1": "bad_day", "e,2023-1-5,5,true,1": "bad_day", "f,2023-01-07,1.5,maybe,x": "fractional_n,bad_flag,bad_rate",
                   "g,2023-01-07,99999999999,true,1": "out_of_range_n", "h,2023-01-07,1,true": "corrupt_line", "i,2023-01-07,1,true,2,3": "corrupt_line",
                   '"open quote,2023-01-08,7,true,1': "corrupt_line", "j,2023-01-08,NaN,true,NaN": "bad_n,bad_rate"}
    assert good.count() + bad.count() == len([x for x in DIRTY.split("\n") if x]) - 2


def test_counts_are_not_cut(spark):
    df = spark.createDataFrame([(1.5, 2.0), (3e12, None), (-0.0, -7.0)], "new_cases double, deaths double")
    assert [tuple(r) for r in L.cast_counts(df).collect()] == [(None, 2), (None, None), (0, -7)]


def test_sorted_files_and_a_broken_order(spark, tmp_path):
    rows = [(f"k{i % 7:03d}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, n int")
    L.write_csv_sorted(df, str(tmp_path / "ok"), ["k", "n"])
    got = L.prove_order(L.sorted_manifest(spark, str(tmp_path / "ok"), df.schema, ["k", "n"])).first()
    assert (got.n_rows, tuple(got["first"]), tuple(got["last"]), got.in_order) == (500, ("k000", 0), ("k006", 496), True)
    L.write_csv(df.repartition(4, "n"), str(tmp_path / "bad"))
    assert not L.prove_order(L.sorted_manifest(spark, str(tmp_path / "bad"), df.schema, ["k", "n"])).first().in_order
    L.write_csv(df.limit(0), str(tmp_path / "none"))
    assert L.prove_order(L.sorted_manifest(spark, str(tmp_path / "none"), df.schema, ["k"])).first().in_order
