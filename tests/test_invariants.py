"""Whole-table invariants on the small driver tables."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from epilake.operators import facilities as FA
from epilake.operators import incidence as I
from epilake.operators import quality as Q
from epilake.sources.bind import Bindings


def test_left_join_keeps_every_facility(spark):
    b = Bindings(spark, SF_SMALL)
    assert I.facility_geography(b).count() == b.facility().count()


def test_allocation_at_least_one(spark):
    b = Bindings(spark, SF_SMALL)
    assert FA.allocation(b.geography()).filter(F.col("n_facilities") < 1).count() == 0


def test_type_shares_sum_to_one(spark):
    b = Bindings(spark, SF_SMALL)
    s = FA.type_mix(b.geography()).groupBy("geography_id").agg(F.sum("type_share").alias("s"))
    assert s.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_every_case_row_is_clean_or_quarantined(spark):
    b = Bindings(spark, SF_SMALL)
    cases, clean, held = b.case(), Q.clean_cases(b), Q.quarantined_cases(b)
    assert clean.count() + held.count() == cases.count()
    assert clean.unionByName(held.select(*cases.columns)).exceptAll(cases).count() == 0
    assert clean.count() == clean.select("case_id").distinct().count()
    bad = None
    for c in Q.case_row_flags(cases).values():
        bad = c if bad is None else bad | c
    # no case id with a good row is missing
    assert cases.filter(~bad).select("case_id").distinct().count() == clean.count()


def test_bad_and_repeated_copies(spark, fake):
    """A bad copy that sorts first hides no good row; equal good copies are quarantined but one."""
    good = ("C1", "2020-01-05", "2020-01-03", "F", "G", "Malaria", 4, 0, 1, "0-5", "M")
    late = ("C1", "2020-01-06", "2020-01-03", "F", "G", "Malaria", 4, 0, 1, "0-5", "M")
    wrong = ("C1", "2020-01-04", "2020-01-03", "F", "G", "Malaria", -4, 0, 1, "0-5", "M")
    schema = ("case_id string, report_date string, case_date string, facility_id string, geography_id string, disease string, "
              "new_cases int, deaths int, recoveries int, age_group string, gender string")
    df = spark.createDataFrame([good, good, good, late, wrong], schema)
    df = df.withColumns({c: F.to_date(c) for c in ("report_date", "case_date")})
    b = fake(spark, case=df)
    assert [r.report_date.day for r in Q.clean_cases(b).collect()] == [5]
    held = sorted((r.report_date.day, "duplicate_key" in r.reasons) for r in Q.quarantined_cases(b).collect())
    assert held == [(4, False), (5, True), (5, True), (6, True)]


def _with_orphans(spark, folder):
    """The small tables with suppliers, customers and reports whose parent is missing."""
    import os
    for t in ("region", "nation"):
        os.symlink(f"{SF_SMALL}/{t}.parquet", folder / f"{t}.parquet")
    read = lambda t: spark.read.parquet(f"{SF_SMALL}/{t}.parquet")
    more = {
        "supplier": read("supplier").limit(1).withColumn("s_suppkey", F.lit(900001).cast("long")).withColumn("s_nationkey", F.lit(99).cast("long")),
        "customer": read("customer").limit(1).withColumn("c_custkey", F.lit(900001).cast("long")).withColumn("c_nationkey", F.lit(98).cast("long")),
        "orders": read("orders").limit(1).withColumn("o_orderkey", F.lit(900001).cast("long")).withColumn("o_custkey", F.lit(900001).cast("long")),
        "lineitem": read("lineitem").limit(10).withColumn("l_suppkey", F.lit(900002).cast("long")),
    }
    for t, rows in more.items():
        base = read(t)
        base.unionByName(rows.select(*[F.col(c).cast(base.schema[c].dataType) for c in base.columns])).write.parquet(str(folder / f"{t}.parquet"))
    return Bindings(spark, str(folder))


def test_orphans_reach_their_rule(spark, tmp_path):
    b = _with_orphans(spark, tmp_path)
    whole = Bindings(spark, SF_SMALL)
    assert b.case().count() == whole.case().count() + 10 == b.reports().count()
    assert b.facility().count() == whole.facility().count() + 1
    tables = lambda rows: sorted(r.table_name for r in rows.collect())
    extra = tables(Q.orphans(b))
    for t in tables(Q.orphans(whole)):
        extra.remove(t)
    assert extra == ["case"] * 10 + ["climate", "facility"]


def test_planted_defects_fire_their_rules(spark):
    """No rule is green because it never fires on the driver's tables."""
    b = Bindings(spark, "/root/testdata/sf0.01")
    fired = {(r.table_name, r.rule) for r in Q.report(b).collect()}
    for rule in (("climate", "station_offline"), ("case", "bad_domain"), ("facility", "bad_domain"), ("facility", "missing_services"),
                 ("facility", "level_mismatch"), ("case", "orphan_facility"), ("facility", "orphan_geography")):
        assert rule in fired


def test_case_queries_without_geography_join_no_facility(spark):
    from epilake.plans.catalog import all_queries
    for key in ("date_parts", "gender_share", "delay_histogram"):
        plan = all_queries()[key](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "supplier" not in plan and "s_suppkey" not in plan, key
