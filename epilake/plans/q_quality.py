"""Queries: data-quality rules, report, quarantine, key checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from epilake import fixed as X
from epilake.operators import quality as Q
from epilake.plans import sql_parts as S
from epilake.plans.q_geo import REGIME, TYPES_SQL
from epilake.plans.registry import query
from epilake.sources import lake as L

CKEY = "geography_id || '|' || CAST(obs_date AS VARCHAR)"
DELAY = "datediff('day', case_date, report_date)"
_LO, _HI = Q.TEMP_PLAUSIBLE
_SPAN_LO = X.TEMP_SPAN_RANGE[0] - Q.ROUND_TOL
_SPAN_HI = X.TEMP_SPAN_RANGE[1] + Q.ROUND_TOL
LEVEL_SQL = S.values(
    [r for r in (lambda: [(lvl, c[0], c[1], s[0], s[1], a[0], a[1])
                          for i, (m, c, s, a) in enumerate(X.LEVEL_RANGES)
                          for lvl in range(m, 7 if i == 0 else X.LEVEL_RANGES[i - 1][0])])()],
    ["facility_level", "capacity_lo", "capacity_hi", "staff_lo", "staff_hi", "ambulance_lo", "ambulance_hi"])
COUNTRY_BOX_SQL = S.values([(cc, la[0], la[1], lo[0], lo[1]) for cc, _n, _s, _u, _p, la, lo in X.COUNTRIES],
                           ["country_code", "lat_lo", "lat_hi", "lon_lo", "lon_hi"])


def V(table, rule, key, col, value="NULL", text="NULL", frm="", where="true"):
    return (f"SELECT '{table}' AS table_name, '{rule}' AS rule, {key} AS record_key, '{col}' AS column_name, "
            f"CAST({value} AS DOUBLE) AS value, CAST({text} AS VARCHAR) AS value_text FROM {frm} WHERE {where}")


def _in(col, vals):
    return f"coalesce({col} IN ({', '.join(S.lit(v) for v in vals)}), false)"


STATUSES = [s for s, _ in X.OPERATIONAL_STATUS]

R_CASE_COUNTS = [
    V("case", "deaths_gt_cases", "case_id", "deaths", "deaths", frm="v_case",
      where="coalesce(deaths > new_cases, false)"),
    V("case", "outcomes_gt_cases", "case_id", "recoveries", "deaths + recoveries", frm="v_case",
      where="coalesce(deaths + recoveries > new_cases, false)"),
]
R_DELAY = [V("case", "delay_out_of_range", "case_id", "case_date", DELAY, frm="v_case",
             where=f"coalesce(NOT ({DELAY} BETWEEN 0 AND {X.MAX_REPORT_DELAY_DAYS}), false)")]
R_DOMAIN = [
    V("case", "bad_domain", "case_id", "disease", text="disease", frm="v_case", where=f"NOT {_in('disease', X.DISEASES)}"),
    V("case", "bad_domain", "case_id", "age_group", text="age_group", frm="v_case",
      where=f"NOT {_in('age_group', X.AGE_GROUPS)}"),
    V("case", "bad_domain", "case_id", "gender", text="gender", frm="v_case", where=f"NOT {_in('gender', X.GENDERS)}"),
    V("facility", "bad_domain", "facility_id", "operational_status", text="operational_status", frm="v_facility",
      where=f"NOT {_in('operational_status', STATUSES)}"),
    V("geography", "bad_domain", "geography_id", "urban_rural", text="urban_rural", frm="v_geography",
      where=f"NOT {_in('urban_rural', X.URBAN_RURAL)}"),
]
R_DUP = [
    V(t, "duplicate_key", k, k, "n", frm=f"(SELECT {k}, count(*) AS n FROM {v} GROUP BY {k} HAVING count(*) > 1)")
    for t, k, v in [("case", "case_id", "v_case"), ("geography", "geography_id", "v_geography"),
                    ("facility", "facility_id", "v_facility")]
]
R_CLIMATE_RANGE = [
    V("climate", "negative_rainfall", CKEY, "rainfall_mm", "rainfall_mm", frm="v_climate", where="rainfall_mm < 0"),
    V("climate", "temperature_outlier", CKEY, "temperature_max_c", "temperature_max_c", frm="v_climate",
      where=f"NOT (temperature_max_c BETWEEN {S.lit(_LO)} AND {S.lit(_HI)})"),
    V("climate", "temperature_outlier", CKEY, "temperature_min_c", "temperature_min_c", frm="v_climate",
      where=f"NOT (temperature_min_c BETWEEN {S.lit(_LO)} AND {S.lit(_HI)})"),
]
R_OFFLINE = [V("climate", "station_offline", CKEY, "*", frm="v_climate",
               where="temperature_min_c IS NULL AND temperature_max_c IS NULL AND rainfall_mm IS NULL "
                     "AND humidity_pct IS NULL")]
R_SPAN = [V("climate", "temperature_span", CKEY, "temperature_max_c", "temperature_max_c - temperature_min_c",
            frm="v_climate", where=f"(temperature_max_c - temperature_min_c < {S.lit(_SPAN_LO)}) OR "
                                   f"(temperature_max_c - temperature_min_c > {S.lit(_SPAN_HI)})")]
R_RAIN_CAP = [V("climate", "rain_above_cap", CKEY, "rainfall_mm", "rainfall_mm", frm="regime",
                where="rainfall_mm > rain_cap")]
_WET = "humidity_pct BETWEEN least(humidity_base + 10, 100e0) AND least(humidity_base + 30, 100e0)"
_DRY = "humidity_pct BETWEEN greatest(humidity_base - 15, 20e0) AND greatest(humidity_base - 5, 20e0)"
_HOK = (f"((CASE WHEN rainfall_mm IS NULL OR rainfall_mm = 0 THEN ({_WET}) OR ({_DRY}) "
        f"WHEN rainfall_mm > 0 THEN ({_WET}) ELSE ({_DRY}) END) AND humidity_pct BETWEEN 20 AND 100)")
R_HUMIDITY = [V("climate", "humidity_inconsistent", CKEY, "humidity_pct", "humidity_pct", frm="regime",
                where=f"humidity_pct IS NOT NULL AND NOT coalesce({_HOK}, false)")]
R_BEDS = [V("facility", "beds_no_staff", "facility_id", "staff_count", "capacity", frm="v_facility",
            where="capacity > 0 AND staff_count = 0")]
_CAPJ = f"(SELECT f.*, t.level AS type_level FROM v_facility f JOIN {TYPES_SQL} ON f.facility_type = t.facility_type)"
R_CAPABILITY = [
    V("facility", "missing_services", "facility_id", "facility_type", "type_level", "facility_type", frm=_CAPJ,
      where=f"type_level >= {X.FULL_SERVICE_MIN_LEVEL} AND NOT coalesce(has_lab AND has_isolation_ward AND has_xray, false)"),
    V("facility", "level_mismatch", "facility_id", "facility_level", "facility_level", "facility_type", frm=_CAPJ,
      where="type_level <> facility_level"),
]
_RANGEJ = f"(SELECT f.*, t.* EXCLUDE (facility_level) FROM v_facility f JOIN {LEVEL_SQL} ON f.facility_level = t.facility_level)"
R_CAP_RANGE = [
    V("facility", f"{c}_out_of_range", "facility_id", c, c, frm=_RANGEJ, where=f"{c} < {lo} OR {c} >= {hi}")
    for c, lo, hi in [("capacity", "capacity_lo", "capacity_hi"), ("staff_count", "staff_lo", "staff_hi"),
                      ("ambulance_count", "ambulance_lo", "ambulance_hi")]
]
_DISTJ = ("(SELECT f.facility_id, abs(f.latitude - g.latitude) AS dlat, abs(f.longitude - g.longitude) AS dlon "
          "FROM v_facility f JOIN v_geography g ON f.geography_id = g.geography_id)")
_TOL = S.lit(X.FACILITY_OFFSET_DEG + 1e-6)
R_DISTANCE = [
    V("facility", "far_from_geography", "facility_id", "latitude", "dlat", frm=_DISTJ, where=f"dlat > {_TOL}"),
    V("facility", "far_from_geography", "facility_id", "longitude", "dlon", frm=_DISTJ, where=f"dlon > {_TOL}"),
]
_YLO, _YHI = X.ESTABLISHED_YEAR_RANGE
R_YEAR = [V("facility", "established_year_out_of_range", "facility_id", "established_year", "established_year",
            frm="v_facility", where=f"established_year < {_YLO} OR established_year >= {_YHI}")]
_BOXJ = f"(SELECT g.*, t.* EXCLUDE (country_code) FROM v_geography g JOIN {COUNTRY_BOX_SQL} ON g.country_code = t.country_code)"
R_BOUNDS = [
    V("geography", "outside_country", "geography_id", "latitude", "latitude", frm=_BOXJ,
      where="NOT (latitude BETWEEN lat_lo AND lat_hi)"),
    V("geography", "outside_country", "geography_id", "longitude", "longitude", frm=_BOXJ,
      where="NOT (longitude BETWEEN lon_lo AND lon_hi)"),
]


def _range_case(col, ranges):
    return ("(CASE " + " ".join(f"WHEN urban_rural = '{k}' THEN ({col} < {lo} OR {col} >= {hi})"
                                for k, (lo, hi) in ranges.items()) + " END)")


R_POP = [
    V("geography", "population_out_of_range", "geography_id", "population", "population", frm="v_geography",
      where=f"coalesce({_range_case('population', X.POPULATION_RANGE)}, false)"),
    V("geography", "density_out_of_range", "geography_id", "population_density", "population_density",
      frm="v_geography", where=f"coalesce({_range_case('population_density', X.DENSITY_RANGE)}, false)"),
]
R_ORPHANS = [
    V("facility", "orphan_geography", "facility_id", "geography_id", text="geography_id",
      frm="(SELECT * FROM v_facility f WHERE NOT EXISTS (SELECT 1 FROM v_geography g WHERE g.geography_id = f.geography_id))"),
    V("case", "orphan_facility", "case_id", "facility_id", text="facility_id",
      frm="(SELECT * FROM v_case c WHERE NOT EXISTS (SELECT 1 FROM v_facility f WHERE f.facility_id = c.facility_id))"),
    V("climate", "orphan_geography", CKEY, "geography_id", text="geography_id",
      frm="(SELECT * FROM v_climate c WHERE NOT EXISTS (SELECT 1 FROM v_geography g WHERE g.geography_id = c.geography_id))"),
]
R_ALL = ([
    V("case", "null_new_cases", "case_id", "new_cases", frm="v_case", where="new_cases IS NULL"),
    V("case", "null_deaths", "case_id", "deaths", frm="v_case", where="deaths IS NULL"),
    V("case", "negative_count", "case_id", "new_cases", "new_cases", frm="v_case",
      where="new_cases < 0 OR deaths < 0"),
] + R_CASE_COUNTS + R_DELAY + R_DOMAIN + R_DUP + [
    V("climate", "null_rainfall", CKEY, "rainfall_mm", frm="v_climate", where="rainfall_mm IS NULL"),
] + R_CLIMATE_RANGE + R_OFFLINE + R_SPAN + R_RAIN_CAP + R_HUMIDITY + [
    V("facility", "null_capacity", "facility_id", "capacity", frm="v_facility", where="capacity IS NULL"),
] + R_BEDS + R_CAPABILITY + R_CAP_RANGE + R_DISTANCE + R_YEAR + [
    V("geography", "null_population", "geography_id", "population", frm="v_geography", where="population IS NULL"),
] + R_BOUNDS + R_POP + R_ORPHANS)


def U(parts):
    return "\nUNION ALL\n".join(parts)


CASE_FLAGS = (f"(new_cases IS NULL OR coalesce(new_cases < 0, false) OR coalesce(deaths < 0, false) OR coalesce(deaths > new_cases, false) "
              f"OR coalesce(deaths + recoveries > new_cases, false) "
              f"OR coalesce(NOT ({DELAY} BETWEEN 0 AND {X.MAX_REPORT_DELAY_DAYS}), false) "
              f"OR NOT ({_in('disease', X.DISEASES)} AND {_in('age_group', X.AGE_GROUPS)} "
              f"AND {_in('gender', X.GENDERS)}))")


@query("dq_null_rates", U([
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, "
    f"CAST(sum(CAST({c} IS NULL AS BIGINT)) AS BIGINT) AS n_null, "
    f"sum(CAST({c} IS NULL AS BIGINT)) / count(*) AS null_rate FROM {v}"
    for t, v, cols in [("geography", "v_geography", L.GEOGRAPHY_READ.names), ("facility", "v_facility", L.FACILITY_READ.names),
                       ("climate", "v_climate", L.CLIMATE_READ.names), ("case", "v_case", L.CASE_READ.names)]
    for c in cols]))
def dq_null_rates(b):
    """Q1: null count and rate of every column of the four tables."""
    return Q.null_rates(b)


@query("dq_duplicate_keys", U(R_DUP))
def dq_duplicate_keys(b):
    """Q2: keys present more than once."""
    return Q.duplicate_keys(b)


@query("dq_negative_cases", """
SELECT case_id, facility_id, report_date, disease, new_cases, deaths FROM v_case WHERE new_cases < 0 OR deaths < 0
""")
def dq_negative_cases(b):
    """Q4: negative counts."""
    return Q.negative_cases(b.case())


@query("dq_climate_range", U(R_CLIMATE_RANGE))
def dq_climate_range(b):
    """Q5, Q6: negative rainfall, temperature outliers."""
    return Q.climate_range(b)


@query("dq_station_offline", U(R_OFFLINE))
def dq_station_offline(b):
    """Q7: all four climate measures null."""
    return Q.station_offline(b)


@query("climate_panel_gaps", """
, span AS (SELECT min(obs_date) AS d0, max(obs_date) AS d1 FROM v_climate)
, panel AS (
  SELECT g.geography_id, CAST(unnest(generate_series(span.d0, span.d1, INTERVAL 1 DAY)) AS DATE) AS obs_date
  FROM v_geography g, span
)
SELECT p.geography_id, p.obs_date FROM panel p
WHERE NOT EXISTS (SELECT 1 FROM v_climate c WHERE c.geography_id = p.geography_id AND c.obs_date = p.obs_date)
""")
def climate_panel_gaps(b):
    """Missing geography-days of the daily climate panel."""
    return Q.panel_gaps(b)


@query("climate_gap_intervals", """
, span AS (SELECT min(obs_date) AS d0, max(obs_date) AS d1 FROM v_climate)
, marks AS (SELECT DISTINCT c.geography_id, c.obs_date FROM v_climate c JOIN v_geography g ON g.geography_id = c.geography_id
            UNION ALL SELECT geography_id, d0 - 1 FROM v_geography, span WHERE d0 IS NOT NULL
            UNION ALL SELECT geography_id, d1 + 1 FROM v_geography, span WHERE d0 IS NOT NULL)
, steps AS (SELECT *, lead(obs_date) OVER (PARTITION BY geography_id ORDER BY obs_date) AS nxt FROM marks)
SELECT geography_id, obs_date + 1 AS gap_start, nxt - 1 AS gap_end, CAST(nxt - obs_date - 1 AS INTEGER) AS n_days
FROM steps WHERE nxt - obs_date > 1
""")
def climate_gap_intervals(b):
    """Q8: runs of missing days of the climate panel, one row each (gaps and islands)."""
    return Q.gap_intervals(b)


@query("dq_beds_no_staff", U(R_BEDS))
def dq_beds_no_staff(b):
    """Q9: beds but no staff."""
    return Q.beds_no_staff(b)


@query("dq_case_counts", U(R_CASE_COUNTS))
def dq_case_counts(b):
    """Q10: deaths and outcomes above new cases."""
    return Q.case_counts(b)


@query("dq_delay_range", U(R_DELAY))
def dq_delay_range(b):
    """Q11: reporting delay outside 0..14 days."""
    return Q.delay_range(b)


@query("dq_domain_values", U(R_DOMAIN))
def dq_domain_values(b):
    """Q12: values outside the allowed sets."""
    return Q.domain_values(b)


@query("facility_capability_check", U(R_CAPABILITY))
def facility_capability_check(b):
    """Services by level, level by type."""
    return Q.capability(b)


@query("dq_capacity_range", U(R_CAP_RANGE))
def dq_capacity_range(b):
    """Q14: capacity, staff and ambulances by level."""
    return Q.capacity_range(b)


@query("dq_facility_distance", U(R_DISTANCE))
def dq_facility_distance(b):
    """Q15: facility far from its geography point."""
    return Q.facility_distance(b)


@query("dq_geo_bounds", U(R_BOUNDS))
def dq_geo_bounds(b):
    """Q16: geography outside its country's box."""
    return Q.geo_bounds(b)


@query("dq_population_range", U(R_POP))
def dq_population_range(b):
    """Q17: population and density range by class."""
    return Q.population_range(b)


@query("dq_temp_span", U(R_SPAN))
def dq_temp_span(b):
    """Q18: daily temperature span."""
    return Q.temp_span(b)


@query("dq_rain_cap", REGIME + U(R_RAIN_CAP))
def dq_rain_cap(b):
    """Q19: rainfall cap by regime."""
    return Q.rain_cap(b)


@query("dq_humidity", REGIME + U(R_HUMIDITY))
def dq_humidity(b):
    """Q20: humidity consistent with rain and season."""
    return Q.humidity(b)


@query("dq_established_year", U(R_YEAR))
def dq_established_year(b):
    """Q21: established year range."""
    return Q.established_year(b)


@query("dq_orphans", U(R_ORPHANS))
def dq_orphans(b):
    """Foreign keys without parent (anti joins)."""
    return Q.orphans(b)


@query("dq_report", REGIME + ", allv AS (" + U(R_ALL) + """)
SELECT table_name, rule, count(*) AS n_violations, count(DISTINCT record_key) AS n_records
FROM allv GROUP BY table_name, rule
""")
def dq_report(b):
    """Q22: violations per table and rule over all rules."""
    return Q.report(b)


# good rows, numbered within a case id
RANKED = f"""
    SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY report_date NULLS FIRST, facility_id NULLS FIRST,
      disease NULLS FIRST, case_date NULLS FIRST, geography_id NULLS FIRST, new_cases NULLS FIRST,
      deaths NULLS FIRST, recoveries NULLS FIRST, age_group NULLS FIRST, gender NULLS FIRST) AS rn
    FROM v_case WHERE NOT {CASE_FLAGS}"""


@query("clean_cases", """
, ranked AS (""" + RANKED + """)
SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1
""")
def clean_cases(b):
    """Q23: clean case table (first good row per case id)."""
    return Q.clean_cases(b)


_REASONS = [
    ("null_new_cases", "new_cases IS NULL"),
    ("negative_count", "coalesce(new_cases < 0, false) OR coalesce(deaths < 0, false)"),
    ("deaths_gt_cases", "coalesce(deaths > new_cases, false)"),
    ("outcomes_gt_cases", "coalesce(deaths + recoveries > new_cases, false)"),
    ("delay_out_of_range", f"coalesce(NOT ({DELAY} BETWEEN 0 AND {X.MAX_REPORT_DELAY_DAYS}), false)"),
    ("bad_domain", f"NOT ({_in('disease', X.DISEASES)} AND {_in('age_group', X.AGE_GROUPS)} "
                   f"AND {_in('gender', X.GENDERS)})"),
]


@query("quarantined_cases", f"""
SELECT *, concat_ws(',', {", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in _REASONS)}) AS reasons
FROM v_case WHERE {CASE_FLAGS}
UNION ALL SELECT * EXCLUDE (rn), 'duplicate_key' FROM ({RANKED}) WHERE rn > 1
""")
def quarantined_cases(b):
    """Q23 complement: case rows failing a row rule, and surplus copies, with reasons."""
    return Q.quarantined_cases(b)


@query("facilities_with_climate", """
SELECT * FROM v_facility f WHERE EXISTS (SELECT 1 FROM v_climate c WHERE c.geography_id = f.geography_id)
""")
def facilities_with_climate(b):
    """Semi join facility -> climate."""
    return Q.facilities_with_climate(b)


@query("dq_duplicate_rows", """
, app AS (
  SELECT * FROM v_case
  UNION ALL
  SELECT * FROM (SELECT * FROM v_case ORDER BY md5(concat_ws(':', case_id, CAST(report_date AS VARCHAR),
      CAST(case_date AS VARCHAR), facility_id, geography_id, disease, CAST(new_cases AS VARCHAR),
      CAST(deaths AS VARCHAR), CAST(recoveries AS VARCHAR), age_group, gender, '42')), case_id, report_date,
      facility_id, disease, age_group, gender LIMIT 5)
)
SELECT case_id, report_date, facility_id, disease, n_copies FROM (
  SELECT case_id, report_date, case_date, facility_id, geography_id, disease, new_cases, deaths, recoveries,
    age_group, gender, count(*) AS n_copies
  FROM app GROUP BY ALL HAVING count(*) > 1)
""")
def dq_duplicate_rows(b):
    """Q3: exact duplicate rows (input: cases plus 5 appended copies, as the reference does)."""
    from epilake.plans.q_cases import appended_cases
    app = appended_cases(b)
    g = app.groupBy(*app.columns).agg(F.count(F.lit(1)).alias("n_copies")).filter(F.col("n_copies") > 1)
    return g.select("case_id", "report_date", "facility_id", "disease", "n_copies")
