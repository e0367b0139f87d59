"""Queries: facility-day joins and expected incidence."""

from __future__ import annotations

from epilake.operators import incidence as I
from epilake.plans import sql_parts as S
from epilake.plans.registry import query


@query("expected_malaria", S.FD + f"""
SELECT facility_id, geography_id, obs_date, population, is_urban, rain_21d, history_days,
  temperature_avg_c, {S.pos(S.MALARIA)} AS expected_malaria
FROM fd
""")
def expected_malaria(b):
    """M1 (flagship): expected malaria cases per operational facility-day."""
    return I.expected_malaria(b)


@query("expected_tb", S.FD + f"""
SELECT facility_id, geography_id, obs_date, population, is_urban, {S.pos(S.TB)} AS expected_tb
FROM fd
""")
def expected_tb(b):
    """M3: expected tuberculosis cases per operational facility-day."""
    return I.expected_tb(b)


@query("facility_geography", S.AF + """
SELECT facility_id, geography_id, operational_status, population, urban_rural, is_urban FROM fg
""")
def facility_geography(b):
    """Facility left join geography subset, urban flag."""
    return I.facility_geography(b).select("facility_id", "geography_id", "operational_status",
                                          "population", "urban_rural", "is_urban")


@query("active_facilities", S.AF + """
SELECT facility_id, geography_id, facility_type, population, is_urban FROM af
""")
def active_facilities(b):
    """Operational facilities."""
    return I.active_facilities(b).select("facility_id", "geography_id", "facility_type",
                                         "population", "is_urban")


@query("facility_day_climate", S.FD + """
SELECT facility_id, geography_id, obs_date, rainfall_mm, temperature_avg_c FROM fd
""")
def facility_day_climate(b):
    """Operational facility-days joined to their geography's climate row."""
    return I.facility_days(b).select("facility_id", "geography_id", "obs_date", "rainfall_mm",
                                     "temperature_avg_c")


@query("rain_21d", S.CF + """
SELECT geography_id, obs_date, rainfall_mm, rain_21d, history_days FROM cf
""")
def rain_21d(b):
    """Trailing 21-day rain per geography-day, current day excluded."""
    from epilake.operators.climate import climate_features
    return climate_features(b.climate()).select("geography_id", "obs_date", "rainfall_mm",
                                                "rain_21d", "history_days")


@query("temp_band", """
SELECT geography_id, obs_date, (temperature_min_c + temperature_max_c) / 2 AS temperature_avg_c,
  """ + S.TEMP_BAND.format(t="((temperature_min_c + temperature_max_c) / 2)") + """ AS temp_factor
FROM v_climate
""")
def temp_band(b):
    """Closed-interval temperature banding."""
    from epilake.functions import measures as M
    t = M.temperature_avg("temperature_min_c", "temperature_max_c")
    return b.climate().select("geography_id", "obs_date", t.alias("temperature_avg_c"),
                              M.temp_band(t).alias("temp_factor"))


@query("climate_daily_avg", """
SELECT geography_id, obs_date, temperature_min_c, temperature_max_c,
  (temperature_min_c + temperature_max_c) / 2 AS temperature_avg_c
FROM v_climate
""")
def climate_daily_avg(b):
    """P5: derived daily average temperature (null if either end is null)."""
    from epilake.operators.climate import with_daily_avg
    return with_daily_avg(b.climate()).select("geography_id", "obs_date", "temperature_min_c",
                                              "temperature_max_c", "temperature_avg_c")


@query("climate_first_per_day", """
SELECT geography_id, obs_date, temperature_min_c, temperature_max_c, rainfall_mm, humidity_pct
FROM (SELECT *, row_number() OVER (PARTITION BY geography_id, obs_date
        ORDER BY temperature_min_c, temperature_max_c, rainfall_mm, humidity_pct) AS rn FROM v_climate)
WHERE rn = 1
""")
def climate_first_per_day(b):
    """First climate row per (geography, day) under a total order."""
    from epilake.operators.climate import climate_first_per_day as f
    return f(b.climate())
