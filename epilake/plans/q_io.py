"""Queries: CSV and Parquet sinks with their round trips, and the batch job.

Each writes under the shared work folder, then returns the table read
back; the oracle is the source table itself, so the round trip must be
lossless.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from epilake.plans.batch_job import build_surveillance
from epilake.plans import q_cases, q_outbreaks, q_quality, q_warehouse  # noqa: F401  (register what the batch job writes)
from epilake.plans.registry import REGISTRY, query
from epilake.sources import lake as L

CASE_SQL = "SELECT * FROM v_case"


def _run_id() -> str:
    """Each call writes its own folder, so a DataFrame returned earlier keeps its files."""
    return uuid.uuid4().hex[:12]


def _csv_round_trip(b, compress: bool):
    spark = b.spark
    name = "csv_gz" if compress else "csv"
    base = L.tagged_path(spark, b.t.sf_dir, name, _run_id())
    L.write_csv(b.geography(), f"{base}/geography", compress)
    L.write_csv(b.facility(), f"{base}/facility", compress)
    L.write_csv(b.climate(), f"{base}/climate", compress, sort_cols=["geography_id", "obs_date"])
    L.write_csv(b.case(), f"{base}/case", compress, sort_cols=["report_date", "facility_id", "disease"])
    back = L.read_csv(spark, f"{base}/case", L.CASE_READ)
    return L.cast_counts(back)


@query("csv_round_trip", CASE_SQL)
def csv_round_trip(b):
    """Write the four tables as CSV with header (cases in date,
    facility, disease order; climate in geography, date order within each file),
    read the cases back under an explicit schema (counts as double, cast after)."""
    return _csv_round_trip(b, compress=False)


@query("csv_gzip_round_trip", CASE_SQL)
def csv_gzip_round_trip(b):
    """The same with gzip-compressed part files."""
    return _csv_round_trip(b, compress=True)


def _read_back(b, name, df, schema, casts=()):
    base = L.tagged_path(b.spark, b.t.sf_dir, "csv_back", name, _run_id())
    back = L.read_csv(b.spark, L.write_csv(df, base), schema)
    return back.withColumns({c: L.whole_number(F.col(c), "int") for c in casts})


@query("csv_geography", "SELECT * FROM v_geography")
def csv_geography(b):
    """Geography written as CSV and read back whole."""
    return _read_back(b, "geography", b.geography(), L.GEOGRAPHY_READ)


@query("csv_facility", "SELECT * FROM v_facility")
def csv_facility(b):
    """Facilities written as CSV and read back whole (counts as double, cast after)."""
    return _read_back(b, "facility", b.facility(), L.FACILITY_READ, ("capacity", "staff_count"))


@query("csv_climate", "SELECT * FROM v_climate")
def csv_climate(b):
    """Climate written as CSV and read back whole."""
    return _read_back(b, "climate", b.climate(), L.CLIMATE_READ)


SORTED = {"geography": ("v_geography", L.GEOGRAPHY_READ, ["geography_id"]), "facility": ("v_facility", L.FACILITY_READ, ["facility_id"]),
          "climate": ("v_climate", L.CLIMATE_READ, ["geography_id", "obs_date"]),
          "case": ("v_case", L.CASE_READ, ["report_date", "facility_id", "disease"])}


def _key_sql(order, least):
    keys = ", ".join(f"CAST({c} AS VARCHAR)" for c in order)
    way = "" if least else " DESC"
    return "concat_ws('|', " + keys + ")", ", ".join(f"{c}{way}" for c in order)


@query("csv_sorted_sinks", "\nUNION ALL\n".join(
    f"SELECT '{name}' AS table_name, (SELECT count(*) FROM {view}) AS n_rows, "
    + ", ".join(f"(SELECT {_key_sql(order, least)[0]} FROM {view} ORDER BY {_key_sql(order, least)[1]} LIMIT 1) AS {alias}"
                for least, alias in ((True, "first_key"), (False, "last_key"))) + ", true AS in_order"
    for name, (view, _, order) in SORTED.items()))
def csv_sorted_sinks(b):
    """K3: the four tables as globally ordered CSV files; the files' manifest proves order and counts."""
    out = None
    for name, (_, schema, order) in SORTED.items():
        base = L.tagged_path(b.spark, b.t.sf_dir, "csv_sorted", name, _run_id())
        L.write_csv_sorted(getattr(b, name)(), base, order)
        row = L.prove_order(L.sorted_manifest(b.spark, base, schema, order))
        keys = [F.concat_ws("|", *[F.col(f"{at}.{c}").cast("string") for c in order]).alias(f"{at}_key") for at in ("first", "last")]
        row = row.select(F.lit(name).alias("table_name"), "n_rows", *keys, "in_order")
        out = row if out is None else out.unionByName(row)
    return out


def _mixed_folder(b):
    """A delivery folder of case files that also holds facility lines and a raw export of the line items."""
    base = L.tagged_path(b.spark, b.t.sf_dir, "csv_mixed", _run_id())
    L.write_csv(b.case(), f"{base}/case")
    b.facility().write.csv(f"{base}/facility")
    b.t("lineitem").write.csv(f"{base}/export")
    return L.read_csv_checked(b.spark, base, L.CASE_READ_WHOLE)


@query("csv_checked_good", CASE_SQL)
def csv_checked_good(b):
    """The good lines of a delivery folder that also holds files of another layout: the cases, typed."""
    return L.split_checked(_mixed_folder(b))[0]


@query("csv_checked_violations", """
, bad AS (
  SELECT 'corrupt_line' AS violation, count(*) AS n_lines FROM v_facility
  UNION ALL SELECT 'bad_report_date', count(l_partkey) FROM lineitem
  UNION ALL SELECT 'bad_case_date', count(l_suppkey) FROM lineitem
  UNION ALL SELECT 'fractional_new_cases', count(*) FILTER (WHERE l_discount <> floor(l_discount)) FROM lineitem
  UNION ALL SELECT 'fractional_deaths', count(*) FILTER (WHERE l_tax <> floor(l_tax)) FROM lineitem
  UNION ALL SELECT 'bad_recoveries', count(l_returnflag) FROM lineitem)
SELECT violation, n_lines FROM bad WHERE n_lines > 0
""")
def csv_checked_violations(b):
    """What is wrong with the lines of that folder that go to quarantine, by named violation."""
    rows = _mixed_folder(b).select(F.explode("violations").alias("violation"))
    return rows.groupBy("violation").agg(F.count(F.lit(1)).alias("n_lines"))


@query("lake_cases", """
SELECT c.*, strftime(c.report_date, '%Y-%m') AS report_month, g.region_name
FROM v_case c LEFT JOIN v_geography g ON c.geography_id = g.geography_id
""")
def lake_cases(b):
    """L1: cases partitioned by report month and region (month, not day, to keep
    files large), read back with partition columns."""
    spark = b.spark
    df = (b.case().join(b.geography_b().select("geography_id", "region_name"), "geography_id", "left")
          .withColumn("report_month", F.date_format("report_date", "yyyy-MM")))
    path = L.tagged_path(spark, b.t.sf_dir, "lake", "cases", _run_id())
    L.write_partitioned(df.select(*b.case().columns, "report_month", "region_name"), path,
                        ["report_month", "region_name"])
    back = spark.read.schema(df.select(*b.case().columns, "report_month", "region_name").schema).parquet(path)
    return back


@query("lake_climate", """
SELECT *, strftime(obs_date, '%Y-%m') AS obs_month FROM v_climate
""")
def lake_climate(b):
    """L2: climate partitioned by month, read back."""
    spark = b.spark
    df = b.climate().withColumn("obs_month", F.date_format("obs_date", "yyyy-MM"))
    path = L.tagged_path(spark, b.t.sf_dir, "lake", "climate", _run_id())
    L.write_partitioned(df, path, ["obs_month"])
    return spark.read.schema(df.schema).parquet(path)


@query("surveillance_batch", REGISTRY["dq_report"].sql, raw_sql=True)
def surveillance_batch(b):
    """Run the batch job (quality, quarantine, measures, partitioned writes) and
    return its data-quality report as written."""
    spark = b.spark
    out = build_surveillance(spark, b.t.sf_dir, L.tagged_path(spark, b.t.sf_dir, "surveillance", _run_id()))
    return spark.read.parquet(out["dq_report"])


# each output of the batch job with the SQL of its rows
OUTPUTS = {"dq_report": ("dq_report", "n_violations"), "quarantined_cases": ("quarantined_cases", "new_cases"), "clean_cases": ("clean_cases", "new_cases"),
           "expected_cases": ("expected_cases_long", None), "excess_cases": ("excess_cases", None), "fact_surveillance": ("fact_surveillance", "new_cases")}


@query("surveillance_outputs", "\nUNION ALL\n".join(
    f"SELECT '{name}' AS output, count(*) AS n_rows, CAST({f'sum({col})' if col else 'NULL'} AS BIGINT) AS total FROM ({REGISTRY[key].sql})"
    for name, (key, col) in OUTPUTS.items()), raw_sql=True)
def surveillance_outputs(b):
    """All outputs of the batch job read back, with their rows and the total of a count of theirs."""
    spark = b.spark
    written = build_surveillance(spark, b.t.sf_dir, L.tagged_path(spark, b.t.sf_dir, "surveillance", _run_id()))
    out = None
    for name, (_, col) in OUTPUTS.items():
        rows = spark.read.parquet(written[name]).agg(
            F.count(F.lit(1)).alias("n_rows"), (F.sum(col) if col else F.lit(None)).cast("long").alias("total"))
        rows = rows.select(F.lit(name).alias("output"), "n_rows", "total")
        out = rows if out is None else out.unionByName(rows)
    return out
