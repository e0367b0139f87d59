"""Shared oracle CTE fragments (DuckDB SQL), appended after the binding views."""

# climate features: daily average, trailing 21-day rain (current day excluded)
CF = """
, cf AS (
  SELECT geography_id, obs_date, temperature_min_c, temperature_max_c, rainfall_mm, humidity_pct,
    (temperature_min_c + temperature_max_c) / 2 AS temperature_avg_c,
    CAST(sum(CAST(rainfall_mm AS DECIMAL(18,1))) OVER w21 AS DOUBLE) AS rain_21d,
    count(*) OVER w21 AS history_days
  FROM v_climate
  WINDOW w21 AS (PARTITION BY geography_id ORDER BY obs_date
                 RANGE BETWEEN INTERVAL 21 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)
  QUALIFY row_number() OVER (PARTITION BY geography_id, obs_date ORDER BY temperature_min_c NULLS FIRST,
    temperature_max_c NULLS FIRST, rainfall_mm NULLS FIRST, humidity_pct NULLS FIRST) = 1
)
"""

# facility x geography (left), operational only
AF = """
, fg AS (
  SELECT f.*, g.population, g.urban_rural, coalesce(g.urban_rural = 'Urban', false) AS is_urban
  FROM v_facility f LEFT JOIN (SELECT geography_id, population, urban_rural FROM v_geography) g
    ON f.geography_id = g.geography_id
)
, af AS (SELECT * FROM fg WHERE operational_status = 'Operational')
"""

# operational facility-days with climate
FD = CF + AF + """
, fd AS (
  SELECT af.facility_id, af.geography_id, af.population, af.is_urban,
    cf.obs_date, cf.temperature_min_c, cf.temperature_max_c, cf.rainfall_mm, cf.humidity_pct,
    cf.temperature_avg_c, cf.rain_21d, cf.history_days
  FROM af JOIN cf ON af.geography_id = cf.geography_id
)
"""

TEMP_BAND = ("(CASE WHEN {t} BETWEEN 25 AND 30 THEN 1.5e0 WHEN {t} BETWEEN 20 AND 35 THEN 1.0e0 "
             "ELSE 0.5e0 END)")

MALARIA = ("population / 100000 * (CASE WHEN is_urban THEN 0.5e0 ELSE 2.0e0 END)"
           " * (CASE WHEN month(obs_date) IN (3, 4, 5, 10, 11) THEN 2.5e0 ELSE 0.5e0 END)"
           " * (CASE WHEN history_days > 0 THEN 1.0e0 + coalesce(rain_21d, 0e0) / 500 ELSE 1.0e0 END)"
           " * " + TEMP_BAND.format(t="temperature_avg_c"))

TB = ("population / 100000 * (CASE WHEN is_urban THEN 0.8e0 ELSE 0.5e0 END)"
      " * (CASE WHEN month(obs_date) IN (6, 7, 8) THEN 1.2e0 ELSE 1.0e0 END)")


def pos(e: str) -> str:
    """Non-positive or null expected value -> 0."""
    return f"(CASE WHEN ({e}) > 0 THEN ({e}) ELSE 0e0 END)"


def lit(v) -> str:
    """A DuckDB literal: strings quoted, floats as DOUBLE, lists as lists."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        r = repr(v)
        return r if "e" in r else r + "e0"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(lit(x) for x in v) + "]"
    return str(v)


def values(rows, cols) -> str:
    """`(VALUES ...) t(cols)` from Python rows (fixed values shared with the Spark side)."""
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"
