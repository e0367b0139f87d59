"""Queries: Structured Streaming forms, each compared with its batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from epilake import fixed as X
from epilake.plans import q_warehouse  # noqa: F401  (registers region_trend first)
from epilake.plans.q_outbreaks import TRIG
from epilake.plans.registry import REGISTRY, query
from epilake.sources.bind import Bindings
from epilake.sources.lake import tagged_path
from epilake.streaming import lake_sink as LS
from epilake.streaming import streams as ST


@query("stream_ingest", "SELECT * FROM v_case")
def stream_ingest(b):
    """File-stream ingest of reports into a Parquet sink."""
    return ST.run_available(ST.case_stream(b), b.spark, b.t.sf_dir, "ingest")


@query("stream_enrich", """
SELECT c.*, g.population, g.urban_rural FROM v_case c LEFT JOIN v_geography g ON c.geography_id = g.geography_id
""")
def stream_enrich(b):
    """Stream-static enrichment of arriving reports with geography."""
    return ST.run_available(ST.enrich(b, ST.case_stream(b)), b.spark, b.t.sf_dir, "enrich")


@query("stream_daily_counts", f"""
, d AS (SELECT report_date AS window_start, report_date + 1 AS window_end, disease, geography_id,
          count(*) AS n_reports, CAST(sum(new_cases) AS BIGINT) AS cases FROM v_case GROUP BY ALL)
SELECT * FROM d WHERE window_end <= (SELECT max(report_date) FROM v_case) - {X.MAX_REPORT_DELAY_DAYS}
""")
def stream_daily_counts(b):
    """Tumbling daily counts with a 14-day watermark (append: final days only)."""
    return ST.run_available(ST.daily_counts(ST.case_stream(b)), b.spark, b.t.sf_dir, "daily_counts")


@query("stream_dedupe", "SELECT DISTINCT case_id FROM v_case")
def stream_dedupe(b):
    """T4: repeated case ids dropped within the watermark."""
    out = ST.run_available(ST.dedupe(ST.case_stream(b)), b.spark, b.t.sf_dir, "dedupe")
    return out.select("case_id")  # which copy comes first depends on the files' order


@query("stream_rain_21d", f"""
, ends AS (SELECT DISTINCT geography_id, obs_date + CAST(i AS INTEGER) AS window_end FROM v_climate, range(1, {X.MALARIA_HISTORY_DAYS + 1}) r(i))
SELECT e.geography_id, e.window_end,
  CAST(sum(CAST(c.rainfall_mm AS DECIMAL(18,1))) AS DOUBLE) AS rain_21d, count(*) AS n_days
FROM ends e JOIN v_climate c ON c.geography_id = e.geography_id
  AND c.obs_date >= e.window_end - {X.MALARIA_HISTORY_DAYS} AND c.obs_date < e.window_end
WHERE e.window_end <= (SELECT max(obs_date) FROM v_climate) - 1
GROUP BY e.geography_id, e.window_end
""")
def stream_rain_21d(b):
    """Sliding 21-day rain windows (1-day slide, 1-day watermark)."""
    return ST.run_available(ST.rain_21d(ST.climate_stream(b)), b.spark, b.t.sf_dir, "rain_21d")


@query("stream_rain_21d_ring", REGISTRY["stream_rain_21d"].sql, raw_sql=True)
def stream_rain_21d_ring(b):
    """The same rows from a ring of day buckets and one running sum a geography."""
    return ST.run_available(ST.rain_21d_ring(ST.climate_stream(b)), b.spark, b.t.sf_dir, "rain_21d_ring")


@query("stream_triggers", TRIG + f"""
SELECT geography_id, start_date, n_reports, first_facility_id, rainfall_mm FROM trig
WHERE start_date + 1 <= (SELECT least((SELECT max(report_date) FROM v_case), (SELECT max(obs_date) FROM v_climate))) - {X.MAX_REPORT_DELAY_DAYS}
""")
def stream_triggers(b):
    """M5, T5: trigger days from two live streams, cases and climate; a day is final once both watermarks pass it."""
    got = ST.trigger_days_of_streams(ST.case_stream(b), ST.climate_stream(b))
    return ST.run_available(got, b.spark, b.t.sf_dir, "triggers")


@query("stream_outbreaks", TRIG + f"""
SELECT t.geography_id, t.start_date AS trigger_date, min(p.start_date) AS earliest_active_start, count(*) AS n_active
FROM trig t JOIN trig p ON p.geography_id = t.geography_id AND p.start_date BETWEEN t.start_date - 59 AND t.start_date
WHERE t.start_date + 1 <= (SELECT max(report_date) FROM v_case) - {X.MAX_REPORT_DELAY_DAYS}
GROUP BY t.geography_id, t.start_date
""")
def stream_outbreaks(b):
    """T5: stateful outbreak tracker in event time; per trigger day, once final under the
    14-day watermark, the earliest active start and the number of active outbreaks
    (expiry 60 days from start)."""
    out = ST.run_available(ST.outbreak_tracker(b, ST.case_stream(b)), b.spark, b.t.sf_dir, "outbreaks")
    return ST.tracker_as_dates(out)


# ------------------------------------------------------------------ arrivals into the lake
#: Years of reports in one delivery.
DELIVERY_YEARS = 3


def _deliveries(b, run, again: int = 0):
    """Delivers the reports (lineitem rows) by report year into a folder, a few years at a time (and the last `again`
    years before them once more), and calls `run(stream of cases, folder)` behind each delivery: a restart of the
    stream on its checkpoint."""
    base = tagged_path(b.spark, b.t.sf_dir, "arrivals", uuid.uuid4().hex[:12])
    li = b.t("lineitem").select(*Bindings.LINEITEM_COLS)
    first, last = li.agg(F.year(F.min("l_shipdate")), F.year(F.max("l_shipdate"))).first()
    for year in range(first, last + 1, DELIVERY_YEARS) if first is not None else []:
        new = li.where(F.year("l_shipdate").between(year - again, year + DELIVERY_YEARS - 1))
        new.write.mode("append").parquet(f"{base}/lineitem")
        run(b.case_from(ST.table_stream(b.spark, f"{base}/lineitem", li.schema)), base)
    return base


_LAKE = "SELECT c.*, strftime(c.report_date, '%Y-%m') AS report_month, g.region_name FROM v_case c LEFT JOIN v_geography g ON c.geography_id = g.geography_id"


@query("stream_lake", _LAKE)
def stream_lake(b):
    """Arriving reports into the partitioned lake through the ledger sink, over several deliveries with
    a restart behind each; every batch is then replayed, which adds no row."""
    schema = LS.with_partition(b.case(), b.geography_b()).schema

    def run(cases, base):
        table = LS.case_lake(b.spark, f"{base}/lake", schema)

        def sink(rows, batch_id):
            table.write(rows, batch_id)
            table.write(rows, batch_id)  # as a restart before the commit of the offsets would

        LS.run_batches(LS.with_partition(cases, b.geography_b()), sink, f"{base}/checkpoint")

    base = _deliveries(b, run)
    return LS.case_lake(b.spark, f"{base}/lake", schema).read()


@query("stream_region_trend", REGISTRY["region_trend"].sql, raw_sql=True)
def stream_region_trend(b):
    """Sums by disease, country, region and month that arriving reports keep up to date, rolled up."""
    places = b.geography_b().select("geography_id", "country_code", "region_name")

    def run(cases, base):
        cases = cases.join(places, "geography_id", "left").withColumn("report_month", F.date_format("report_date", "yyyy-MM"))
        LS.run_batches(cases, LS.Trend(b.spark, f"{base}/trend").add, f"{base}/checkpoint")

    base = _deliveries(b, run)
    return LS.Trend(b.spark, f"{base}/trend").rollup()


@query("stream_late_counts", f"""
, arrived AS (SELECT *, (year(report_date) - (SELECT min(year(report_date)) FROM v_case)) // {DELIVERY_YEARS} AS batch FROM v_case)
, marks AS (SELECT batch, max(max(case_date)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
              max(max(case_date)) OVER () AS last FROM arrived GROUP BY batch)
, marked AS (SELECT a.*, coalesce(a.case_date + 1 <= m.before - {X.MAX_REPORT_DELAY_DAYS}, false) AS late, m.last FROM arrived a JOIN marks m USING (batch))
SELECT CASE WHEN late THEN 'late' WHEN case_date + 1 <= last - {X.MAX_REPORT_DELAY_DAYS} THEN 'final' ELSE 'open' END AS state,
  case_date AS event_day, disease, geography_id, count(*) AS n_reports, CAST(sum(new_cases) AS BIGINT) AS cases
FROM marked GROUP BY 1, 2, 3, 4
""")
def stream_late_counts(b):
    """Daily counts by the day of the case with reports arriving by report day: final counts, days still open, and
    the reports that came behind the watermark, which are kept. Together they are the whole table."""
    schema = b.case().schema

    def counts(base):
        return LS.DailyCounts(b.spark, f"{base}/counts", schema, "case_date")

    base = _deliveries(b, lambda cases, base: LS.run_batches(cases, counts(base).add, f"{base}/checkpoint"))
    got = counts(base)
    late = got.late().groupBy(F.col("case_date").alias("event_day"), "disease", "geography_id").agg(
        F.count(F.lit(1)).alias("n_reports"), F.sum("new_cases").cast("long").alias("cases"))
    out = None
    for state, rows in (("final", got.final()), ("open", got.still_open()), ("late", late)):
        rows = rows.select(F.lit(state).alias("state"), "event_day", "disease", "geography_id", "n_reports", "cases")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("stream_dedupe_first", f"""
, steps AS (SELECT *, coalesce(report_date - lag(report_date) OVER (PARTITION BY case_id ORDER BY report_date) > {X.MAX_REPORT_DELAY_DAYS}, true) AS new FROM v_case)
, sessions AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY report_date RANGE UNBOUNDED PRECEDING) AS session FROM steps)
SELECT * EXCLUDE (new, session, rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id, session ORDER BY report_date NULLS FIRST, facility_id NULLS FIRST,
    disease NULLS FIRST, case_date NULLS FIRST, geography_id NULLS FIRST, new_cases NULLS FIRST,
    deaths NULLS FIRST, recoveries NULLS FIRST, age_group NULLS FIRST, gender NULLS FIRST) AS rn
  FROM sessions QUALIFY max(report_date) OVER (PARTITION BY case_id, session) + {X.MAX_REPORT_DELAY_DAYS}
    <= (SELECT max(report_date) FROM v_case) - {X.MAX_REPORT_DELAY_DAYS}) WHERE rn = 1
""")
def stream_dedupe_first(b):
    """T4: of the reports of a case id that follow each other within the delay the first, as a whole row, over deliveries
    that repeat a year of reports; ids whose copies can still come (the last two delays) are not released yet."""
    def run(cases, base):
        rows = ST.dedupe_first(cases)
        q = (rows.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()

    base = _deliveries(b, run, again=1)
    return b.spark.read.schema(b.case().schema).parquet(f"{base}/out")
