"""Queries: planned warehouse tables."""

from __future__ import annotations

from epilake.operators import warehouse as WH
from epilake.plans.q_cases import EXL
from epilake.plans.registry import query

_H = ("md5(" + " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'n')" for c in WH.SCD_TRACKED) + ")")
_ASOF = f"DATE '{WH.SCD_AS_OF.isoformat()}'"


def _extract(day: str) -> str:
    """The extract of each row (i, `day`) of `days` as SQL."""
    return f"""SELECT f.facility_id, f.capacity, f.staff_count, CASE WHEN l.last <= l.d - {WH.QUIET_DAYS} THEN 'Quiet' ELSE f.operational_status END
    AS operational_status, f.facility_type, l.i, l.d
  FROM v_facility f JOIN (SELECT c.facility_id, days.i, days.d, max(c.report_date) AS last FROM v_case c JOIN days
    ON c.report_date <= days.d AND c.report_date > days.d - {WH.EXTRACT_DAYS} WHERE {day} GROUP BY ALL) l ON l.facility_id = f.facility_id"""


DAYS_SQL = f""", days AS (SELECT * FROM (VALUES {", ".join(f"({i}, DATE '{d.isoformat()}')" for i, d in enumerate(WH.SNAPSHOT_DAYS))}) t(i, d))"""
HISTORY_SQL = DAYS_SQL + f"""
, snaps AS (SELECT *, {_H} AS h FROM ({_extract("true")}))
, grid AS (SELECT f.facility_id, days.i, days.d, s.capacity, s.staff_count, s.operational_status, s.facility_type, s.h,
             lag(s.h) OVER (PARTITION BY f.facility_id ORDER BY days.i) AS before
           FROM v_facility f CROSS JOIN days LEFT JOIN snaps s ON s.facility_id = f.facility_id AND s.i = days.i)
, versions AS (SELECT facility_id, capacity, staff_count, operational_status, facility_type, h AS row_hash, d AS valid_from,
    (SELECT min(n.d) FROM grid n WHERE n.facility_id = s.facility_id AND n.i > s.i AND n.h IS DISTINCT FROM s.h) AS valid_to
  FROM grid s WHERE h IS NOT NULL AND h IS DISTINCT FROM before)
"""


@query("scd2_facilities", DAYS_SQL + f"""
, cur AS (SELECT facility_id, capacity, staff_count, operational_status, facility_type,
            make_date(established_year, 1, 1) AS valid_from, {_H} AS h FROM v_facility)
, inc AS (SELECT *, {_H} AS h FROM ({_extract(f"days.d = {_ASOF}")}))
SELECT c.facility_id, c.capacity, c.staff_count, c.operational_status, c.facility_type, c.h AS row_hash, c.valid_from,
  CASE WHEN n.facility_id IS NULL OR n.h <> c.h THEN {_ASOF} END AS valid_to,
  NOT (n.facility_id IS NULL OR n.h <> c.h) AS is_current,
  CASE WHEN n.facility_id IS NULL THEN 'deleted' WHEN n.h <> c.h THEN 'closed' ELSE 'unchanged' END AS change_type
FROM cur c LEFT JOIN inc n ON c.facility_id = n.facility_id
UNION ALL
SELECT n.facility_id, n.capacity, n.staff_count, n.operational_status, n.facility_type, n.h, {_ASOF}, NULL, true,
  CASE WHEN c.facility_id IS NULL THEN 'inserted' ELSE 'changed' END
FROM inc n LEFT JOIN cur c ON c.facility_id = n.facility_id
WHERE c.facility_id IS NULL OR c.h <> n.h
""")
def scd2_facilities(b):
    """L3: type-2 history of facilities after merging a later extract."""
    return WH.scd2_facilities(b)


@query("facility_history", HISTORY_SQL + "SELECT *, valid_to IS NULL AS is_current FROM versions")
def facility_history(b):
    """L3: versions of facilities merged from three extracts, one after another."""
    return WH.facility_history(b)


@query("fact_facility_versions", HISTORY_SQL + """
SELECT c.case_id, c.report_date, c.facility_id, c.disease, c.new_cases, v.valid_from AS version_from, v.facility_type,
  v.operational_status, v.capacity
FROM v_case c LEFT JOIN versions v ON v.facility_id = c.facility_id AND c.report_date >= v.valid_from
  AND (v.valid_to IS NULL OR c.report_date < v.valid_to)
""")
def fact_facility_versions(b):
    """L4, L3: reports with the facility version of their day (as-of join)."""
    return WH.fact_facility_versions(b)


@query("fact_surveillance", EXL + """
SELECT c.case_id, c.report_date, c.facility_id, f.facility_type, c.geography_id, g.country_code, g.region_name,
  c.disease, c.new_cases, c.deaths, cl.rainfall_mm, (cl.temperature_min_c + cl.temperature_max_c) / 2 AS temperature_avg_c,
  e.expected_cases
FROM v_case c LEFT JOIN v_facility f ON c.facility_id = f.facility_id
LEFT JOIN v_geography g ON c.geography_id = g.geography_id
LEFT JOIN v_climate cl ON cl.geography_id = c.geography_id AND cl.obs_date = c.report_date
LEFT JOIN exl e ON e.facility_id = c.facility_id AND e.obs_date = c.report_date AND e.disease = c.disease
""")
def fact_surveillance(b):
    """L4: surveillance fact, one row per case report."""
    return WH.fact_surveillance(b)


@query("dim_facilities", """
SELECT facility_id, facility_name, facility_type, facility_level, geography_id, district_name, capacity,
  operational_status, row_number() OVER (ORDER BY facility_id) AS facility_key
FROM v_facility
""")
def dim_facilities(b):
    """Facility dimension with surrogate key."""
    return WH.dim_facilities(b)


@query("dim_geography", """
SELECT geography_id, country_code, country_name, region_name, district_name, population, urban_rural,
  row_number() OVER (ORDER BY geography_id) AS geography_key
FROM v_geography
""")
def dim_geography(b):
    """Geography dimension with surrogate key."""
    return WH.dim_geography(b)


@query("dim_date", """
, sp AS (SELECT least((SELECT min(report_date) FROM v_case), (SELECT min(obs_date) FROM v_climate)) AS d0,
                greatest((SELECT max(report_date) FROM v_case), (SELECT max(obs_date) FROM v_climate)) AS d1)
, s AS (SELECT CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date FROM sp)
SELECT CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_key, date, CAST(year(date) AS INTEGER) AS year,
  CAST(quarter(date) AS INTEGER) AS quarter, CAST(month(date) AS INTEGER) AS month,
  CAST(day(date) AS INTEGER) AS day_of_month, CAST(isodow(date) AS INTEGER) AS iso_day_of_week,
  CAST(dayofyear(date) AS INTEGER) AS day_of_year, isodow(date) >= 6 AS is_weekend,
  strftime(date, '%Y-%m') AS year_month
FROM s
""")
def dim_date(b):
    """Date dimension over the report and climate span."""
    return WH.dim_date(b)


@query("region_trend", """
, cg AS (SELECT c.*, g.country_code, g.region_name, strftime(c.report_date, '%Y-%m') AS report_month
         FROM v_case c LEFT JOIN v_geography g ON c.geography_id = g.geography_id)
SELECT disease, country_code, region_name, report_month, CAST(sum(new_cases) AS BIGINT) AS cases,
  count(*) AS n_reports, CAST(GROUPING(disease, country_code, region_name, report_month) AS BIGINT) AS grouping_level
FROM cg GROUP BY GROUPING SETS ((disease, country_code, region_name, report_month),
  (disease, country_code, region_name), (disease, country_code), (disease))
""")
def region_trend(b):
    """Cases by disease, rolled up over country > region > month."""
    return WH.region_trend(b)


def _w(lo: str, hi: str) -> str:
    return f"OVER (PARTITION BY geography_id ORDER BY obs_date RANGE BETWEEN {lo} AND {hi})"


@query("lead_features", f"""
, daily AS (SELECT geography_id, report_date AS obs_date, CAST(sum(new_cases) AS BIGINT) AS cases
            FROM v_case GROUP BY ALL)
, gd AS (SELECT coalesce(cl.geography_id, d.geography_id) AS geography_id, coalesce(cl.obs_date, d.obs_date) AS obs_date,
           cl.rainfall_mm, d.cases
         FROM v_climate cl FULL OUTER JOIN daily d ON cl.geography_id = d.geography_id AND cl.obs_date = d.obs_date)
SELECT geography_id, obs_date, cases,
  CAST(sum(CAST(rainfall_mm AS DECIMAL(18,1))) {_w("INTERVAL 21 DAY PRECEDING", "INTERVAL 1 DAY PRECEDING")} AS DOUBLE)
    AS rain_21d,
  CAST(sum(cases) {_w("INTERVAL 7 DAY PRECEDING", "INTERVAL 1 DAY PRECEDING")} AS BIGINT) AS cases_7d,
  CAST(sum(cases) {_w("INTERVAL 14 DAY PRECEDING", "INTERVAL 1 DAY PRECEDING")} AS BIGINT) AS cases_14d,
  CAST(sum(cases) {_w("INTERVAL 28 DAY PRECEDING", "INTERVAL 1 DAY PRECEDING")} AS BIGINT) AS cases_28d,
  CAST(sum(cases) {_w("INTERVAL 14 DAY FOLLOWING", "INTERVAL 28 DAY FOLLOWING")} AS BIGINT) AS label_cases_14_28d
FROM gd
""")
def lead_features(b):
    """Lagged rain and case features with a 14..28-day-ahead label."""
    return WH.lead_features(b)


@query("bed_pressure", """
, lastd AS (SELECT max(report_date) AS d FROM v_case)
, sick AS (SELECT f.district_name, CAST(sum(c.new_cases - c.deaths - c.recoveries) AS BIGINT) AS still_sick
           FROM v_case c JOIN v_facility f ON c.facility_id = f.facility_id
           WHERE c.report_date > (SELECT d FROM lastd) - 14 AND f.district_name IS NOT NULL GROUP BY f.district_name)
, beds AS (SELECT district_name, CAST(sum(capacity) AS BIGINT) AS beds FROM v_facility
           WHERE operational_status = 'Operational' AND district_name IS NOT NULL GROUP BY district_name)
, j AS (SELECT coalesce(s.district_name, b.district_name) AS district_name, s.still_sick, b.beds,
          s.still_sick / nullif(b.beds, 0) AS pressure
        FROM sick s FULL OUTER JOIN beds b ON s.district_name = b.district_name)
SELECT *, CAST(row_number() OVER (ORDER BY pressure DESC NULLS LAST, district_name) AS INTEGER) AS pressure_rank FROM j
""")
def bed_pressure(b):
    """Still-sick patients over operational beds by district, ranked."""
    return WH.bed_pressure(b)
