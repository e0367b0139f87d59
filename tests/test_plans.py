"""Plan properties that must hold at scale, checked on every batch query's physical plan."""

import contextlib
import io
import re

import pytest

from conftest import SF_SMALL
from epilake.plans.catalog import all_queries

QUERIES = all_queries()  # the training-data queries have tests of their own in tests/llm
# these run a stream or write a sink while being built; their plans are reads of the output
SIDE_EFFECT = {k for k in QUERIES if k.startswith("stream_")} | {
    "csv_round_trip", "csv_gzip_round_trip", "lake_cases", "lake_climate", "surveillance_batch"}


def plan(spark, key) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        QUERIES[key](spark, SF_SMALL).explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - SIDE_EFFECT))
def test_no_cartesian_no_python_udf_pruned_scans(spark, key):
    p = plan(spark, key)
    assert "CartesianProduct" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    for schema in re.findall(r"lineitem\.parquet\][^\n]*\n(?:[^\n]*\n)*?ReadSchema: (struct<[^\n]*>)", p):
        assert "l_extendedprice" not in schema and "l_tax" not in schema   # never used: pruned


def test_flagship_does_not_shuffle_facilities(spark):
    p = plan(spark, "expected_malaria")
    tree = p.split("\n\n")[0]
    # the only exchanges are on the climate side (geography-day windows); the facility
    # scan reaches the final join through broadcast joins only
    assert tree.count("BroadcastHashJoin") >= 2
    fac_scan = [b for b in p.split("\n\n") if "facility" in b and "Scan parquet" in b]
    assert fac_scan and "EqualTo(operational_status,Operational)" in fac_scan[0]


def test_quality_report_reads_cases_at_most_twice(spark):
    p = plan(spark, "dq_report")
    assert len(re.findall(r"Location: InMemoryFileIndex \[[^\]]*lineitem\.parquet\]", p)) <= 2


def test_recent_days_bound_reaches_the_lineitem_scan(spark):
    p = plan(spark, "bed_pressure")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_shipdate,", p)


def test_bucketed_excess_shuffles_neither_side(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(spark, "excess_cases_bucketed")
        assert "Exchange" not in p.split("\n\n")[0] and "Bucketed: true" in p
        assert "Exchange" in plan(spark, "excess_cases").split("\n\n")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
