"""Queries: cholera outbreaks, expected cholera, long expected cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from epilake import fixed as X
from epilake.functions import measures as M
from epilake.operators import incidence as I
from epilake.operators import outbreaks as O
from epilake.plans import sql_parts as S
from epilake.plans.registry import query

TRIG = """
, trig AS (
  SELECT c.geography_id, c.start_date, c.n_reports, c.first_facility_id, cl.rainfall_mm,
    1.5e0 + 1.5e0 * ((least(cl.rainfall_mm, 200e0) - 80e0) / 120e0) AS intensity
  FROM (SELECT geography_id, report_date AS start_date, count(*) AS n_reports, 
          arg_min(facility_id, {'n': length(facility_id), 'id': facility_id}) AS first_facility_id
        FROM v_case WHERE disease = 'Cholera' AND new_cases > 0 GROUP BY geography_id, report_date) c
  JOIN v_climate cl ON cl.geography_id = c.geography_id AND cl.obs_date = c.start_date
  WHERE cl.rainfall_mm > 80
)
, trig_ev AS (
  SELECT DISTINCT c.geography_id, c.report_date AS start_date, c.facility_id
  FROM v_case c JOIN v_climate cl ON cl.geography_id = c.geography_id AND cl.obs_date = c.report_date
  WHERE c.disease = 'Cholera' AND c.new_cases > 0 AND cl.rainfall_mm > 80
)
"""

AD = TRIG + """
, ad0 AS (
  SELECT d.geography_id, d.obs_date, d.rainfall_mm, min(t.start_date) AS outbreak_start
  FROM v_climate d LEFT JOIN trig t ON t.geography_id = d.geography_id
    AND t.start_date BETWEEN d.obs_date - 59 AND d.obs_date
  GROUP BY d.geography_id, d.obs_date, d.rainfall_mm
)
, ad AS (
  SELECT ad0.geography_id, ad0.obs_date, ad0.rainfall_mm, ad0.outbreak_start,
    CAST(datediff('day', ad0.outbreak_start, ad0.obs_date) AS INTEGER) AS age_days, t.intensity
  FROM ad0 LEFT JOIN trig t ON t.geography_id = ad0.geography_id AND t.start_date = ad0.outbreak_start
)
"""

J8 = S.FD + TRIG + """
, j80 AS (
  SELECT fd.facility_id, fd.geography_id, fd.obs_date, min(t.start_date) AS outbreak_start
  FROM fd LEFT JOIN trig_ev t ON t.geography_id = fd.geography_id
    AND t.start_date BETWEEN fd.obs_date - 59 AND fd.obs_date
    AND (t.start_date < fd.obs_date OR (length(t.facility_id), t.facility_id) < (length(fd.facility_id), fd.facility_id))
  GROUP BY fd.facility_id, fd.geography_id, fd.obs_date
)
, j8 AS (
  SELECT j80.facility_id, j80.geography_id, j80.obs_date, j80.outbreak_start,
    CAST(datediff('day', j80.outbreak_start, j80.obs_date) AS INTEGER) AS age_days,
    t.intensity AS outbreak_intensity
  FROM j80 LEFT JOIN trig t ON t.geography_id = j80.geography_id AND t.start_date = j80.outbreak_start
)
, fdc AS (
  SELECT fd.*, j8.outbreak_start, j8.age_days, j8.outbreak_intensity
  FROM fd JOIN j8 ON fd.facility_id = j8.facility_id AND fd.obs_date = j8.obs_date
)
"""

CHOLERA = ("population / 100000 * (CASE WHEN is_urban THEN 5.0e0 ELSE 3.0e0 END)"
           " * exp(-0.5e0 * pow((age_days - 18) / 10e0, 2)) * outbreak_intensity")


def _fdc(b):
    return I.facility_days_outbreaks(b)


def _expected_cholera_col():
    return M.expected_cholera("population", "is_urban", "outbreak_curve", "outbreak_intensity")


@query("outbreak_triggers", TRIG + """
SELECT geography_id, start_date, n_reports, first_facility_id, rainfall_mm, intensity FROM trig
""")
def outbreak_triggers(b):
    """Cholera report days with rain > 80 mm, one row per geography-day."""
    return O.trigger_days(b).select("geography_id", "start_date", "n_reports", "first_facility_id",
                                    "rainfall_mm", "intensity")


@query("active_outbreak_daily", AD + """
SELECT geography_id, obs_date, rainfall_mm, outbreak_start, age_days, intensity FROM ad
""")
def active_outbreak_daily(b):
    """Earliest outbreak active on each geography-day (day grain)."""
    return O.active_daily(b).select("geography_id", "obs_date", "rainfall_mm", "outbreak_start",
                                    "age_days", "intensity")


@query("active_outbreak_join", J8 + """
SELECT facility_id, geography_id, obs_date, outbreak_start, age_days, outbreak_intensity FROM j8
""")
def active_outbreak_join(b):
    """Facility-day -> active outbreak, exact same-day facility order."""
    return _fdc(b).select("facility_id", "geography_id", "obs_date", "outbreak_start",
                          "age_days", "outbreak_intensity")


@query("expected_cholera", J8 + f"""
SELECT facility_id, geography_id, obs_date, age_days, outbreak_intensity,
  {S.pos(CHOLERA)} AS expected_cholera
FROM fdc
""")
def expected_cholera(b):
    """M2: expected cholera cases inside an active outbreak, else 0."""
    return _fdc(b).select("facility_id", "geography_id", "obs_date", "age_days",
                          "outbreak_intensity", _expected_cholera_col().alias("expected_cholera"))


@query("outbreak_curve", AD + """
SELECT geography_id, obs_date, age_days, exp(-0.5e0 * pow((age_days - 18) / 10e0, 2)) AS curve
FROM ad WHERE outbreak_start IS NOT NULL
""")
def outbreak_curve(b):
    """Bell curve of outbreak intensity by age on active geography-days."""
    ad = O.with_curve(O.active_daily(b).filter(F.col("outbreak_start").isNotNull()))
    return ad.select("geography_id", "obs_date", "age_days", F.col("outbreak_curve").alias("curve"))


@query("outbreak_curve_days", AD + """
SELECT geography_id, obs_date, age_days, round(exp(-0.5e0 * pow((age_days - 18) / 10e0, 2)), 9) AS curve
FROM ad WHERE outbreak_start IS NOT NULL
""")
def outbreak_curve_days(b):
    """The curve of active geography-days by Spark's own exp and pow, to nine places."""
    ad = O.active_daily(b).filter(F.col("outbreak_start").isNotNull())
    return ad.select("geography_id", "obs_date", "age_days", F.round(M.outbreak_curve("age_days"), 9).alias("curve"))


@query("active_outbreaks_asof", TRIG + """
SELECT geography_id, start_date, first_facility_id, intensity,
  CAST(datediff('day', start_date, (SELECT max(obs_date) FROM v_climate)) AS INTEGER) AS age_days
FROM trig
WHERE datediff('day', start_date, (SELECT max(obs_date) FROM v_climate)) BETWEEN 0 AND 59
""")
def active_outbreaks_asof(b):
    """M6: outbreaks active on the last observed climate day."""
    return O.active_asof(b)


@query("cholera_rain_alert", AD + """
SELECT geography_id, obs_date, rainfall_mm FROM ad
WHERE outbreak_start IS NULL AND rainfall_mm > """ + str(X.CHOLERA_ALERT_RAIN) + """
""")
def cholera_rain_alert(b):
    """M7: geography-days with no active outbreak and rain > 50 mm."""
    ad = O.active_daily(b)
    return ad.filter(F.col("outbreak_start").isNull() & (F.col("rainfall_mm") > X.CHOLERA_ALERT_RAIN)) \
        .select("geography_id", "obs_date", "rainfall_mm")


@query("expected_cases_long", J8 + f"""
, ex AS (
  SELECT facility_id, geography_id, obs_date,
    {S.pos(S.MALARIA)} AS m, {S.pos(CHOLERA)} AS c, {S.pos(S.TB)} AS t
  FROM fdc
)
SELECT * FROM (
  SELECT facility_id, geography_id, obs_date, 'Malaria' AS disease, m AS expected_cases FROM ex
  UNION ALL SELECT facility_id, geography_id, obs_date, 'Cholera', c FROM ex
  UNION ALL SELECT facility_id, geography_id, obs_date, 'Tuberculosis', t FROM ex
) WHERE expected_cases > 0
""")
def expected_cases_long(b):
    """Three diseases per facility-day to long rows, positive only."""
    return expected_long(b)


DISEASE_COLS = ["Malaria", "Cholera", "Tuberculosis"]


def expected_wide(b):
    """Expected cases per facility-day, one column per disease (named as the disease)."""
    return _fdc(b).select("facility_id", "geography_id", "obs_date",
                          *[c.alias(d) for d, c in I.expected_columns().items()])


def positive_long(wide, *more):
    """One row for each positive count of `expected_wide` rows, with the columns `more`."""
    long = wide.unpivot(["facility_id", "geography_id", "obs_date", *more], DISEASE_COLS, "disease", "expected_cases")
    return long.filter(F.col("expected_cases") > 0)


def expected_long(b):
    return positive_long(expected_wide(b))
