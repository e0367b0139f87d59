"""Queries: case-table measures, aggregates, sampling, set operations, spines."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from epilake import fixed as X
from epilake.functions import measures as M
from epilake.operators import climate as C
from epilake.operators import facilities as FA
from epilake.operators import incidence as I
from epilake.operators.generic import date_spine, first_per_key, first_rows, sample_n, sequence_id, share_within
from epilake.operators.joins import bounded_broadcast, constant_dim, literal_table
from epilake.plans import sql_parts as S
from epilake.plans.q_geo import REGIME, REGION_INDEX_SQL
from epilake.plans.q_outbreaks import CHOLERA, DISEASE_COLS, J8, expected_wide
from epilake.plans.registry import REGISTRY, query
from epilake.sources.bind import GEOGRAPHY_BROADCAST_ROWS
from epilake.sources.buckets import write_bucketed
from epilake.sources.lake import tagged_path

CASE_COLS = ["case_id", "report_date", "case_date", "facility_id", "geography_id", "disease", "new_cases",
             "deaths", "recoveries", "age_group", "gender"]
BUILD_ORDER = ["report_date", "facility_id", "disease", "case_id", "case_date", "geography_id", "new_cases",
               "deaths", "recoveries", "age_group", "gender"]
SAMPLE_SEED = 42
ORDER_SQL = ", ".join(f"{c} NULLS FIRST" for c in BUILD_ORDER)
MD5_SQL = ("md5(concat_ws(':', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in CASE_COLS)
           + f", '{SAMPLE_SEED}'))")
SAMPLE_ORDER_SQL = MD5_SQL + ", " + ", ".join(f"{c} NULLS FIRST" for c in CASE_COLS)


def sample_cases(df, n):
    return sample_n(df, n, CASE_COLS, SAMPLE_SEED)


def appended_cases(b):
    """U1 input: the case table plus 5 sampled rows appended (duplicate reports)."""
    cases = b.case()
    return cases.unionByName(sample_cases(cases, 5))


@query("date_parts", f"""
SELECT case_id, report_date, strftime(report_date, '%Y-%m-%d') AS report_text,
  CAST(strptime(strftime(report_date, '%Y-%m-%d'), '%Y-%m-%d') AS DATE) AS parsed_date,
  strftime(report_date, '%Y-%m') AS report_month, CAST(month(report_date) AS INTEGER) AS month,
  CAST(day(report_date) AS INTEGER) AS day_of_month, CAST(dayofyear(report_date) AS INTEGER) AS day_of_year,
  CAST(datediff('day', case_date, report_date) AS INTEGER) AS delay_days,
  report_date - CAST(datediff('day', case_date, report_date) AS INTEGER) AS case_date_back
FROM v_case
""")
def date_parts(b):
    """Date text, parsing, parts, differences."""
    c = b.reports()
    txt = F.date_format("report_date", "yyyy-MM-dd")
    delay = F.datediff("report_date", "case_date")
    return c.select("case_id", "report_date", txt.alias("report_text"),
                    F.try_to_date(txt, "yyyy-MM-dd").alias("parsed_date"),
                    F.date_format("report_date", "yyyy-MM").alias("report_month"),
                    F.month("report_date").alias("month"), F.dayofmonth("report_date").alias("day_of_month"),
                    F.dayofyear("report_date").alias("day_of_year"), delay.alias("delay_days"),
                    F.date_sub("report_date", delay).alias("case_date_back"))


@query("still_sick", """
SELECT disease, count(*) AS n_reports, CAST(sum(new_cases - deaths - recoveries) AS BIGINT) AS still_sick_total,
  CAST(sum(new_cases - deaths) AS BIGINT) AS survivors_total,
  sum(new_cases - deaths - recoveries) / nullif(sum(new_cases - deaths), 0) AS still_sick_share
FROM v_case GROUP BY disease
""")
def still_sick(b):
    """New cases - deaths - recoveries, by disease."""
    c = b.reports()
    ss = F.col("new_cases") - F.col("deaths") - F.col("recoveries")
    sv = F.col("new_cases") - F.col("deaths")
    return c.groupBy("disease").agg(
        F.count(F.lit(1)).alias("n_reports"), F.sum(ss).alias("still_sick_total"),
        F.sum(sv).alias("survivors_total"),
        F.try_divide(F.sum(ss), F.sum(sv)).alias("still_sick_share"))


@query("delay_histogram", """
, h AS (SELECT CAST(datediff('day', case_date, report_date) AS INTEGER) AS delay_days, count(*) AS n_reports
        FROM v_case GROUP BY 1)
SELECT delay_days, n_reports, n_reports / (SELECT sum(n_reports) FROM h) AS share,
  CAST(sum(n_reports) OVER (ORDER BY delay_days NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
    / (SELECT sum(n_reports) FROM h) AS cum_share,
  coalesce(delay_days > 14, false) AS is_late
FROM h
""")
def delay_histogram(b):
    """Reporting-delay distribution with cumulative share (the delay domain
    is small, so the running window is over a few dozen rows)."""
    h = b.reports().groupBy(F.datediff("report_date", "case_date").alias("delay_days")) \
        .agg(F.count(F.lit(1)).alias("n_reports"))
    total = h.select(F.sum("n_reports")).scalar()
    w = Window.orderBy("delay_days").rowsBetween(Window.unboundedPreceding, 0)
    return h.select("delay_days", "n_reports", (F.col("n_reports") / total).alias("share"),
                    (F.sum("n_reports").over(w) / total).alias("cum_share"),
                    F.coalesce(F.col("delay_days") > X.MAX_REPORT_DELAY_DAYS, F.lit(False)).alias("is_late"))


@query("delay_percentiles", """
SELECT disease, count(*) AS n_reports, avg(datediff('day', case_date, report_date)) AS mean_delay,
  quantile_cont(datediff('day', case_date, report_date), 0.5) AS p50_delay,
  quantile_cont(datediff('day', case_date, report_date), 0.9) AS p90_delay,
  avg(CAST(datediff('day', case_date, report_date) > 14 AS INTEGER)) AS share_late
FROM v_case GROUP BY disease
""")
def delay_percentiles(b):
    """Reporting-delay percentiles by disease (exact: the aggregate keeps a
    count per distinct delay, a small domain, and merges partial counts map-side)."""
    d = F.datediff("report_date", "case_date")
    return b.reports().groupBy("disease").agg(
        F.count(F.lit(1)).alias("n_reports"), F.avg(d).alias("mean_delay"),
        F.percentile(d, F.lit(0.5)).alias("p50_delay"), F.percentile(d, F.lit(0.9)).alias("p90_delay"),
        F.avg((d > X.MAX_REPORT_DELAY_DAYS).cast("int")).alias("share_late"))


CFR_SQL = S.values(X.CASE_FATALITY, ["disease", "configured_cfr"])


@query("case_fatality", f"""
SELECT c.disease, CAST(sum(new_cases) AS BIGINT) AS total_cases, CAST(sum(deaths) AS BIGINT) AS total_deaths,
  sum(deaths) / nullif(sum(new_cases), 0) AS observed_cfr, any_value(t.configured_cfr) AS configured_cfr
FROM v_case c LEFT JOIN {CFR_SQL} ON c.disease = t.disease GROUP BY c.disease
""")
def case_fatality(b):
    """Observed case fatality by disease beside the configured rate."""
    dim = constant_dim(literal_table(b.spark, "case_fatality", X.CASE_FATALITY, "disease string, configured_cfr double"))
    agg = b.reports().groupBy("disease").agg(F.sum("new_cases").alias("total_cases"),
                                          F.sum("deaths").alias("total_deaths"))
    return agg.join(dim, "disease", "left").select(
        "disease", "total_cases", "total_deaths",
        F.try_divide("total_deaths", "total_cases").alias("observed_cfr"), "configured_cfr")


@query("incidence_per_100k", """
, ag AS (SELECT geography_id, disease, strftime(report_date, '%Y-%m') AS report_month,
           CAST(sum(new_cases) AS BIGINT) AS cases FROM v_case GROUP BY ALL)
SELECT ag.geography_id, disease, report_month, cases, g.population,
  cases * 100000 / nullif(g.population, 0) AS rate_per_100k
FROM ag LEFT JOIN v_geography g ON ag.geography_id = g.geography_id
""")
def incidence_per_100k(b):
    """Cases per 100,000 by geography, disease and month (aggregate first,
    then one join to the bounded geography table)."""
    ag = b.case().groupBy("geography_id", "disease",
                          F.date_format("report_date", "yyyy-MM").alias("report_month")) \
        .agg(F.sum("new_cases").alias("cases"))
    g = b.geography_b().select("geography_id", "population")
    j = ag.join(g, "geography_id", "left")
    return j.select("geography_id", "disease", "report_month", "cases", "population",
                    F.try_divide(F.col("cases") * X.PER_POPULATION, F.col("population")).alias("rate_per_100k"))


EXL = J8 + f"""
, ex AS (
  SELECT facility_id, geography_id, obs_date,
    {S.pos(S.MALARIA)} AS m, {S.pos(CHOLERA)} AS c, {S.pos(S.TB)} AS t
  FROM fdc
)
, exl AS (
  SELECT * FROM (
    SELECT facility_id, geography_id, obs_date, 'Malaria' AS disease, m AS expected_cases FROM ex
    UNION ALL SELECT facility_id, geography_id, obs_date, 'Cholera', c FROM ex
    UNION ALL SELECT facility_id, geography_id, obs_date, 'Tuberculosis', t FROM ex
  ) WHERE expected_cases > 0
)
"""


@query("excess_cases", EXL + """
, obs AS (SELECT facility_id, report_date AS obs_date, disease, CAST(sum(new_cases) AS BIGINT) AS observed
          FROM v_case GROUP BY ALL)
SELECT coalesce(o.facility_id, e.facility_id) AS facility_id, coalesce(o.obs_date, e.obs_date) AS obs_date,
  coalesce(o.disease, e.disease) AS disease, o.observed, e.expected_cases,
  coalesce(o.observed, 0) - coalesce(e.expected_cases, 0e0) AS excess,
  CASE WHEN e.expected_cases > 0 THEN (coalesce(o.observed, 0) - coalesce(e.expected_cases, 0e0)) / sqrt(e.expected_cases) END
    AS z_score
FROM obs o FULL OUTER JOIN (SELECT facility_id, obs_date, disease, expected_cases FROM exl) e
  ON o.facility_id = e.facility_id AND o.obs_date = e.obs_date AND o.disease = e.disease
""")
def excess_cases(b):
    """Observed - expected per facility, day and disease (full outer join);
    z = excess / sqrt(expected) under a Poisson count."""
    return excess(b, expected_wide(b))


@query("excess_cases_bucketed", REGISTRY["excess_cases"].sql, raw_sql=True)
def excess_cases_bucketed(b):
    """The same from cases and expected counts that are stored bucketed by facility and day: no shuffle."""
    base = tagged_path(b.spark, b.t.sf_dir, "bucketed", uuid.uuid4().hex[:12])
    cases = write_bucketed(b.reports().select("facility_id", "report_date", "disease", "new_cases"), f"{base}/case", ["facility_id", "report_date"])
    wide = write_bucketed(expected_wide(b).select("facility_id", "obs_date", *DISEASE_COLS), f"{base}/expected", ["facility_id", "obs_date"])
    return excess(b, b.spark.table(wide), b.spark.table(cases))


#: Reports (with their keys and sums) that a task of `excess` holds in memory at once.
HASHED_REPORTS = 250_000


def excess(b, wide, cases=None, n_reports=None):
    """M17 against expected cases per facility-day with a column for each disease.

    Observed cases are summed to one row per facility-day too, the two are joined, and
    only the result is unpivoted: a third of the rows in the shuffle. Reports of a
    disease without a column have no expected cases and bypass the join.

    With `n_reports`, their number, the reports of a task are hashed and neither side is sorted; both go to as many
    tasks as the reports need for that. The number is explicit: AQE would merge tasks by their bytes, and a hash table
    does not spill. Sums are one row a facility-day, so that no key makes a task larger.
    """
    c = (b.reports() if cases is None else cases).withColumnRenamed("report_date", "obs_date")
    known = F.coalesce(F.col("disease").isin(DISEASE_COLS), F.lit(False))
    sums = [F.sum(F.when(F.col("disease") == d, F.col("new_cases"))).alias(f"_s_{d}") for d in DISEASE_COLS]
    seen = [F.count(F.when(F.col("disease") == d, F.lit(1))).alias(f"_n_{d}") for d in DISEASE_COLS]
    obs = c.filter(known).groupBy("facility_id", "obs_date").agg(*sums, *seen)
    keys, wide = ["facility_id", "obs_date"], wide.select("facility_id", "obs_date", *DISEASE_COLS)
    if n_reports is not None:
        tasks = max(b.spark.sparkContext.defaultParallelism, -(-n_reports // HASHED_REPORTS))
        obs, wide = obs.repartition(tasks, *keys).hint("shuffle_hash"), wide.repartition(tasks, *keys)
    j = obs.join(wide, keys, "full")
    wide_row = j.select("facility_id", "obs_date", *[c for d in DISEASE_COLS for c in (
        F.col(f"_s_{d}"), F.when(F.col(d) > 0, F.col(d)).alias(f"_e_{d}"), (F.coalesce(F.col(f"_n_{d}"), F.lit(0)) > 0).alias(f"_r_{d}"))])
    columns = ", ".join(f"(_s_{d}, _e_{d}, _r_{d}) AS {d}" for d in DISEASE_COLS)
    long = b.spark.sql("SELECT * FROM {rows} UNPIVOT INCLUDE NULLS ((observed, expected_cases, seen) FOR disease IN (" + columns + "))", rows=wide_row)
    long = long.filter(F.col("seen") | F.col("expected_cases").isNotNull()).drop("seen")
    other = c.filter(~known).groupBy("facility_id", "obs_date", "disease").agg(F.sum("new_cases").alias("observed"))
    long = long.unionByName(other.withColumn("expected_cases", F.lit(None).cast("double")))
    excess = F.coalesce(F.col("observed"), F.lit(0)) - F.coalesce(F.col("expected_cases"), F.lit(0.0))
    return long.select("facility_id", "obs_date", "disease", "observed", "expected_cases", excess.alias("excess"),
                       F.when(F.col("expected_cases") > 0, excess / F.sqrt("expected_cases")).alias("z_score"))


@query("monthly_running_count", """
, d AS (SELECT report_date, count(*) AS n_day FROM v_case GROUP BY report_date)
, r AS (SELECT report_date, n_day, CAST(sum(n_day) OVER (ORDER BY report_date ROWS BETWEEN UNBOUNDED PRECEDING
          AND CURRENT ROW) AS BIGINT) AS running_total FROM d)
SELECT report_date, strftime(report_date, '%Y-%m') AS report_month, n_day, running_total FROM r
WHERE day(report_date) = 1
""")
def monthly_running_count(b):
    """Records so far on the first day of each month (aggregate to days first;
    the running window runs over one row per calendar day)."""
    d = b.case().groupBy("report_date").agg(F.count(F.lit(1)).alias("n_day"))
    w = Window.orderBy("report_date").rowsBetween(Window.unboundedPreceding, 0)
    r = d.withColumn("running_total", F.sum("n_day").over(w))
    return r.filter(F.dayofmonth("report_date") == 1).select(
        "report_date", F.date_format("report_date", "yyyy-MM").alias("report_month"), "n_day", "running_total")


STATUS_SQL = S.values(X.OPERATIONAL_STATUS, ["operational_status", "configured_share"])


@query("status_share", f"""
SELECT s.operational_status, n, n / (SELECT count(*) FROM v_facility) AS share, t.configured_share
FROM (SELECT operational_status, count(*) AS n FROM v_facility GROUP BY 1) s
LEFT JOIN {STATUS_SQL} ON s.operational_status = t.operational_status
""")
def status_share(b):
    """Facility status shares against the configured split."""
    dim = constant_dim(literal_table(b.spark, "status_share", X.OPERATIONAL_STATUS,
                                     "operational_status string, configured_share double"))
    f = b.facility()
    total = f.select(F.count(F.lit(1))).scalar()
    g = f.groupBy("operational_status").agg(F.count(F.lit(1)).alias("n"))
    return g.join(dim, "operational_status", "left").select(
        "operational_status", "n", (F.col("n") / total).alias("share"), "configured_share")


AGE_ROWS = [(d, a, w) for d in X.DISEASES for a, w in zip(X.AGE_GROUPS, X.AGE_WEIGHTS[d])]
AGE_SQL = S.values(AGE_ROWS, ["disease", "age_group", "configured_share"])


@query("age_share", f"""
, a AS (SELECT disease, age_group, count(*) AS n FROM v_case GROUP BY ALL)
SELECT a.disease, a.age_group, n, n / sum(n) OVER (PARTITION BY a.disease) AS share, t.configured_share
FROM a LEFT JOIN {AGE_SQL} ON a.disease = t.disease AND a.age_group = t.age_group
""")
def age_share(b):
    """Age-group shares by disease against the configured weights."""
    dim = constant_dim(literal_table(b.spark, "age_share", AGE_ROWS,
                                     "disease string, age_group string, configured_share double"))
    a = b.reports().groupBy("disease", "age_group").agg(F.count(F.lit(1)).alias("n"))
    a = share_within(a, ["disease"], "n", "share")
    return a.join(dim, ["disease", "age_group"], "left").select("disease", "age_group", "n", "share",
                                                                "configured_share")


GENDER_ROWS = [("M", X.MALE_SHARE), ("F", 1 - X.MALE_SHARE)]
GENDER_SQL = S.values(GENDER_ROWS, ["gender", "configured_share"])


@query("gender_share", f"""
SELECT s.gender, n, n / (SELECT count(*) FROM v_case) AS share, t.configured_share
FROM (SELECT gender, count(*) AS n FROM v_case GROUP BY 1) s LEFT JOIN {GENDER_SQL} ON s.gender = t.gender
""")
def gender_share(b):
    """Gender shares against the configured 0.47 / 0.53."""
    dim = constant_dim(literal_table(b.spark, "gender_share", GENDER_ROWS, "gender string, configured_share double"))
    c = b.reports()
    total = c.select(F.count(F.lit(1))).scalar()
    g = c.groupBy("gender").agg(F.count(F.lit(1)).alias("n"))
    return g.join(dim, "gender", "left").select("gender", "n", (F.col("n") / total).alias("share"),
                                                "configured_share")


_P_FIRST = round(X.URBAN_PROB_FIRST_REGION * 100)
_P_OTHER = round(X.URBAN_PROB_OTHER_REGION * 100)


@query("urban_share", f"""
, rg AS (SELECT DISTINCT country_code, region_name FROM v_geography)
, {REGION_INDEX_SQL}
, pc AS (SELECT g.country_code, sum(CASE WHEN ri.region_idx = 1 THEN {_P_FIRST} ELSE {_P_OTHER} END)
           / (count(*) * 100e0) AS p_urban
         FROM v_geography g JOIN ri ON g.country_code = ri.country_code AND g.region_name = ri.region_name GROUP BY g.country_code)
, u AS (SELECT country_code, urban_rural, count(*) AS n FROM v_geography GROUP BY ALL)
SELECT u.country_code, urban_rural, n, n / sum(n) OVER (PARTITION BY u.country_code) AS share,
  CASE WHEN urban_rural = 'Urban' THEN p_urban WHEN urban_rural = 'Rural' THEN 1 - p_urban END AS configured_share
FROM u JOIN pc ON u.country_code = pc.country_code
""")
def urban_share(b):
    """urban/rural share of geographies by country beside the configured share:
    the generator's urban probability, 0.3 in a country's first region (in configured
    order) and 0.15 elsewhere, averaged over the country's geographies."""
    g = b.geography()
    order = FA.with_region_order(g.select("country_code", "region_name").distinct())
    pct = F.when(F.col("region_idx") == 1, F.lit(_P_FIRST)).otherwise(F.lit(_P_OTHER))
    conf = (g.join(order.select("country_code", "region_name", "region_idx"), ["country_code", "region_name"], "inner").groupBy("country_code")
            .agg((F.sum(pct) / (F.count(F.lit(1)) * F.lit(100.0))).alias("p_urban")))
    u = g.groupBy("country_code", "urban_rural").agg(F.count(F.lit(1)).alias("n"))
    u = share_within(u, ["country_code"], "n", "share").join(conf, "country_code", "inner")
    return u.select("country_code", "urban_rural", "n", "share",
                    F.when(F.col("urban_rural") == "Urban", F.col("p_urban"))
                    .when(F.col("urban_rural") == "Rural", F.lit(1) - F.col("p_urban")).alias("configured_share"))


@query("rain_climatology", REGIME + """
SELECT country_code, rainy_season, count(rainfall_mm) AS n_days,
  CAST(sum(CAST(rainfall_mm > 0 AS BIGINT)) AS BIGINT) AS wet_days,
  sum(CAST(rainfall_mm > 0 AS BIGINT)) / count(rainfall_mm) AS wet_day_freq,
  CAST(sum(CASE WHEN rainfall_mm > 0 THEN CAST(rainfall_mm AS DECIMAL(18,1)) END) AS DOUBLE)
    / nullif(sum(CAST(rainfall_mm > 0 AS BIGINT)), 0) AS mean_wet_rain,
  CASE WHEN rainy_season THEN 0.6e0 ELSE 0.15e0 END AS configured_wet_freq,
  CASE WHEN rainy_season THEN any_value(base_rainfall) ELSE any_value(base_rainfall) / 4 END AS configured_mean
FROM regime GROUP BY country_code, rainy_season
""")
def rain_climatology(b):
    """A10: wet-day frequency and mean wet-day rain by country and season."""
    r = C.rain_regime(b.climate(), b.geography_b())
    wet = (F.col("rainfall_mm") > 0).cast("long")
    agg = r.groupBy("country_code", "rainy_season").agg(
        F.count("rainfall_mm").alias("n_days"), F.sum(wet).alias("wet_days"),
        F.sum(F.when(F.col("rainfall_mm") > 0, F.col("rainfall_mm").cast("decimal(18,1)"))).cast("double")
        .alias("_wet_sum"), F.first("base_rainfall").alias("_base"))
    return agg.select(
        "country_code", "rainy_season", "n_days", "wet_days",
        (F.col("wet_days") / F.col("n_days")).alias("wet_day_freq"),
        F.try_divide(F.col("_wet_sum"), F.col("wet_days")).alias("mean_wet_rain"),
        F.when(F.col("rainy_season"), F.lit(X.WET_DAY_PROB["rainy"])).otherwise(F.lit(X.WET_DAY_PROB["dry"]))
        .alias("configured_wet_freq"),
        F.when(F.col("rainy_season"), F.col("_base")).otherwise(F.col("_base") / 4).alias("configured_mean"))


@query("sample_n", f"""
SELECT * FROM v_case ORDER BY {SAMPLE_ORDER_SQL} LIMIT 50
""")
def sample_n_q(b):
    """K1: deterministic 50-row sample without replacement (top-k by hash)."""
    return sample_cases(b.case(), 50)


@query("sample_first_half", f"""
, s AS (SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}) AS seq FROM v_case)
SELECT * EXCLUDE (seq) FROM s WHERE seq <= (SELECT count(*) FROM v_case) // 2
ORDER BY {SAMPLE_ORDER_SQL} LIMIT 5
""")
def sample_first_half(b):
    """K2: 5-row sample from the first half of the rows in build order."""
    cases = b.case()
    return sample_cases(first_rows(cases, cases.count() // 2, BUILD_ORDER), 5)


@query("union_append", f"""
SELECT * FROM v_case UNION ALL (SELECT * FROM v_case ORDER BY {SAMPLE_ORDER_SQL} LIMIT 5)
""")
def union_append(b):
    """Append sampled copies (row union by name)."""
    return appended_cases(b)


@query("dedupe_exact", f"""
SELECT DISTINCT * FROM (SELECT * FROM v_case UNION ALL (SELECT * FROM v_case ORDER BY {SAMPLE_ORDER_SQL} LIMIT 5))
""")
def dedupe_exact(b):
    """Remove exact duplicates (hash aggregate, combined map-side)."""
    return appended_cases(b).dropDuplicates()


@query("dedupe_by_key", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY report_date NULLS FIRST, facility_id NULLS FIRST,
    disease NULLS FIRST, case_date NULLS FIRST, geography_id NULLS FIRST, new_cases NULLS FIRST,
    deaths NULLS FIRST, recoveries NULLS FIRST, age_group NULLS FIRST, gender NULLS FIRST) AS rn
  FROM v_case) WHERE rn = 1
""")
def dedupe_by_key(b):
    """First row per case id under a total order (aggregate form)."""
    return first_per_key(b.case(), ["case_id"], ["report_date", "facility_id", "disease"])


@query("clamp_values", """
SELECT geography_id, obs_date, rainfall_mm,
  CASE WHEN rainfall_mm IS NULL THEN NULL ELSE least(greatest(rainfall_mm, 0e0), 200e0) END AS rain_clamped,
  humidity_pct,
  CASE WHEN humidity_pct IS NULL THEN NULL ELSE least(greatest(humidity_pct, 20e0), 100e0) END AS humidity_clamped
FROM v_climate
""")
def clamp_values(b):
    """clamps that keep null as null."""
    c = b.climate()
    return c.select("geography_id", "obs_date", "rainfall_mm",
                    M.clamp("rainfall_mm", 0.0, float(X.RAIN_CAP["rainy"])).alias("rain_clamped"),
                    "humidity_pct",
                    M.clamp("humidity_pct", float(X.HUMIDITY_RANGE[0]), float(X.HUMIDITY_RANGE[1]))
                    .alias("humidity_clamped"))


@query("surrogate_ids", f"""
, gq AS (SELECT geography_id, country_code, region_name,
           row_number() OVER (ORDER BY country_code, region_name, geography_id) AS geo_seq FROM v_geography)
, cg AS (SELECT c.*, gq.country_code, gq.region_name, gq.geo_seq FROM v_case c LEFT JOIN gq ON c.geography_id = gq.geography_id)
SELECT case_id, report_date, facility_id, disease, seq, printf('CASE-%07d', seq) AS new_case_id,
  country_code || '-' || upper(substr(region_name, 1, 3)) || '-' || printf('%03d', geo_seq) AS region_code
FROM (SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}) AS seq FROM cg)
""")
def surrogate_ids(b):
    """Dense case numbering in build order, zero-padded ids, and a
    region-prefixed geography code (ordinal of the geography in country/region order)."""
    g = b.geography()
    gseq = sequence_id(g.select("country_code", "region_name", "geography_id"),
                       ["country_code", "region_name", "geography_id"], "geo_seq", num_partitions=1)
    cases = sequence_id(b.case(), BUILD_ORDER, "seq")
    # one row per geography: broadcast under the geography bound (checked on nation)
    gseq = bounded_broadcast(gseq, bound_by=b.t("nation"), max_rows=GEOGRAPHY_BROADCAST_ROWS,
                             cache_key=b.t.path("nation"))
    j = cases.join(gseq, "geography_id", "left")  # every case is numbered
    return j.select("case_id", "report_date", "facility_id", "disease", "seq",
                    F.format_string("CASE-%07d", "seq").alias("new_case_id"),
                    F.concat("country_code", F.lit("-"), F.upper(F.substring("region_name", 1, 3)), F.lit("-"),
                             F.format_string("%03d", "geo_seq")).alias("region_code"))


@query("load_summary", """
SELECT 'geography' AS table_name, count(*) AS n_rows FROM v_geography
UNION ALL SELECT 'facility', count(*) FROM v_facility
UNION ALL SELECT 'climate', count(*) FROM v_climate
UNION ALL SELECT 'case', count(*) FROM v_case
""")
def load_summary(b):
    """A3: row counts per table."""
    parts = [(n, df) for n, df in [("geography", b.geography()), ("facility", b.facility()),
                                   ("climate", b.climate()), ("case", b.case())]]
    out = None
    for n, df in parts:
        c = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return out


@query("date_spine", """
, span AS (SELECT min(obs_date) AS d0, max(obs_date) AS d1 FROM v_climate)
, s AS (SELECT CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date FROM span)
SELECT date, CAST(month(date) AS INTEGER) AS month, CAST(dayofyear(date) AS INTEGER) AS day_of_year FROM s
""")
def date_spine_q(b):
    """Every day from the first to the last climate day, inclusive."""
    span = b.climate().agg(F.min("obs_date").alias("d0"), F.max("obs_date").alias("d1"))
    s = span.select(date_spine(F.col("d0"), F.col("d1"), "date"))
    return s.select("date", F.month("date").alias("month"), F.dayofyear("date").alias("day_of_year"))


@query("climate_history_slice", """
SELECT geography_id, obs_date, rainfall_mm FROM v_climate
WHERE obs_date >= (SELECT max(obs_date) FROM v_climate) - 21 AND obs_date < (SELECT max(obs_date) FROM v_climate)
""")
def climate_history_slice(b):
    """Every geography's rows in the 21 days before the last climate day
    (d-21 <= date < d)."""
    c = b.climate()
    d = c.select(F.max("obs_date")).scalar()
    return c.filter((F.col("obs_date") >= F.date_sub(d, X.MALARIA_HISTORY_DAYS)) & (F.col("obs_date") < d)) \
        .select("geography_id", "obs_date", "rainfall_mm")


@query("facility_day_spine", S.AF + """
, span AS (SELECT min(obs_date) AS d0, max(obs_date) AS d1 FROM v_climate)
SELECT facility_id, geography_id, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS obs_date
FROM af, span
""")
def facility_day_spine(b):
    """Operational facility x every day of the climate span (a per-facility
    generator; the span is a scalar)."""
    c = b.climate()
    span = c.agg(F.min("obs_date").alias("d0"), F.max("obs_date").alias("d1"))
    d0 = span.select("d0").scalar()
    d1 = span.select("d1").scalar()
    fac = I.spread_facilities(b)
    return fac.select("facility_id", "geography_id", date_spine(d0, d1, "obs_date"))
