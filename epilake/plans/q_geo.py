"""Queries: geography, facility allocation and mix, climate normals and regimes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from epilake import fixed as X
from epilake.functions import measures as M
from epilake.operators import climate as C
from epilake.operators import facilities as FA
from epilake.operators.generic import repeat_rows
from epilake.operators.joins import constant_dim
from epilake.plans import sql_parts as S
from epilake.plans.registry import query

TYPES_SQL = S.values([(t, lvl, float(dens), float(w)) for t, lvl, _c, _s, dens, w in X.FACILITY_TYPES],
                     ["facility_type", "level", "min_pop_density", "type_weight"])
_LEVELS = {t: lvl for t, lvl, *_ in X.FACILITY_TYPES}
FALLBACK_SQL = S.values([(t, _LEVELS[t]) for t in X.FALLBACK_TYPES], ["facility_type", "facility_level"])
_REGION_ROWS = ", ".join(f"('{c}', '{name}', {i + 1}, {len(names)})" for c, names in X.REGIONS.items() for i, name in enumerate(names))
# after a CTE rg (country_code, region_name): ri adds region_idx and n_configured
REGION_INDEX_SQL = f"""rgd AS (SELECT * FROM (VALUES {_REGION_ROWS}) v(country_code, region_name, region_pos, n_configured))
, ri AS (
  SELECT rg.country_code, rg.region_name, c.n_configured,
    CAST(coalesce(d.region_pos, coalesce(c.n_configured, 0)
      + row_number() OVER (PARTITION BY rg.country_code, d.region_pos IS NULL ORDER BY rg.region_name)) AS INTEGER) AS region_idx
  FROM rg LEFT JOIN rgd d ON d.country_code = rg.country_code AND d.region_name = rg.region_name
  LEFT JOIN (SELECT country_code, max(n_configured) AS n_configured FROM rgd GROUP BY country_code) c ON c.country_code = rg.country_code
)"""
SHARES_SQL = S.values([(cc, share) for cc, _n, share, *_ in X.COUNTRIES], ["country_code", "district_share"])
CLIMATE_SQL = S.values([(cc, months, float(base)) for cc, months, base in X.CLIMATE],
                       ["country_code", "rainy_months", "base_rainfall"])
COUNTRY_SQL = S.values(
    [(cc, name, share, urban, len(X.REGIONS[cc])) for cc, name, share, urban, _p, _la, _lo in X.COUNTRIES],
    ["country_code", "ref_country_name", "district_share", "urban_share", "n_ref_regions"])
COASTAL_SQL = "(" + " OR ".join(f"contains(lower(region_name), {S.lit(w)})" for w in X.COASTAL_WORDS) + ")"

ALLOC = """
, ga AS (
  SELECT geography_id, urban_rural, population_density,
    CASE WHEN coalesce(urban_rural = 'Urban', false) THEN coalesce(population_density, 0e0) * 2
         ELSE coalesce(population_density, 0e0) END AS weight
  FROM v_geography
)
, gs AS (SELECT *, weight / (SELECT sum(weight) FROM ga) AS weight_share FROM ga)
, alloc AS (
  SELECT *, CASE WHEN CAST(round_even(weight_share * 500, 0) AS INTEGER) = 0 THEN 1
                 ELSE CAST(round_even(weight_share * 500, 0) AS INTEGER) END AS n_facilities
  FROM gs
)
"""

MIX = f"""
, gt AS (SELECT geography_id, urban_rural, coalesce(population_density, 0e0) AS density FROM v_geography)
, elig AS (
  SELECT gt.geography_id, t.facility_type, t.level AS facility_level,
    CASE WHEN coalesce(gt.urban_rural = 'Urban', false) AND t.level <= 3 THEN t.type_weight * 3
         ELSE t.type_weight END AS weight
  FROM gt JOIN {TYPES_SQL} ON gt.density > t.min_pop_density
)
, fb AS (
  SELECT gt.geography_id, t.facility_type, t.facility_level, 1.0e0 AS weight
  FROM gt, {FALLBACK_SQL}
  WHERE gt.geography_id NOT IN (SELECT geography_id FROM elig)
)
, mix0 AS (SELECT * FROM elig UNION ALL SELECT * FROM fb)
, mix AS (SELECT *, weight / sum(weight) OVER (PARTITION BY geography_id) AS type_share FROM mix0)
"""


@query("facility_allocation", ALLOC + """
SELECT geography_id, urban_rural, population_density, weight, weight_share, n_facilities FROM alloc
""")
def facility_allocation(b):
    """Facilities per geography by weighted density."""
    return FA.allocation(b.geography())


@query("facility_type_mix", MIX + """
SELECT geography_id, facility_type, facility_level, weight, type_share FROM mix
""")
def facility_type_mix(b):
    """Eligible facility types and their shares per geography."""
    return FA.type_mix(b.geography()).select("geography_id", "facility_type", "facility_level",
                                             "weight", "type_share")


@query("expected_facilities_by_type", ALLOC + MIX + """
SELECT mix.geography_id, facility_type, facility_level, mix.weight, type_share, n_facilities,
  n_facilities * type_share AS expected_facilities
FROM mix JOIN alloc ON mix.geography_id = alloc.geography_id
""")
def expected_facilities_by_type(b):
    """Allocation x type share."""
    return FA.expected_by_type(b.geography()).select(
        "geography_id", "facility_type", "facility_level", "weight", "type_share", "n_facilities",
        "expected_facilities")


@query("facility_slots", ALLOC + """
SELECT geography_id, n_facilities, CAST(unnest(range(1, n_facilities + 1)) AS INTEGER) AS slot
FROM alloc
""")
def facility_slots(b):
    """One row per allocated facility slot (repeat a row n times)."""
    a = FA.allocation(b.geography()).select("geography_id", "n_facilities")
    return repeat_rows(a, "n_facilities", "slot")


@query("district_quota", f"""
, rg AS (SELECT DISTINCT country_code, region_name FROM v_geography)
, {REGION_INDEX_SQL}
, nr AS (SELECT country_code, CAST(max(coalesce(n_configured, n)) AS BIGINT) AS n_regions
         FROM (SELECT country_code, n_configured, count(*) OVER (PARTITION BY country_code) AS n FROM ri) GROUP BY country_code)
, r AS (
  SELECT rg.country_code, rg.region_name, nr.n_regions,
    CAST(trunc(30 * coalesce(t.district_share, 0e0)) AS INTEGER) AS country_districts,
    rg.region_idx
  FROM ri rg JOIN nr ON rg.country_code = nr.country_code LEFT JOIN {SHARES_SQL} ON rg.country_code = t.country_code
)
SELECT country_code, region_name, n_regions, country_districts, region_idx,
  CASE WHEN region_idx = 1 THEN CAST(trunc(country_districts * 0.4e0) AS INTEGER)
       ELSE greatest(1, CAST(floor(country_districts / n_regions) AS INTEGER)) END AS region_districts
FROM r
""")
def district_quota(b):
    """District quota per region from country shares."""
    return FA.district_quota(b.geography())


@query("implied_area", """
SELECT geography_id, population, population_density, population / nullif(population_density, 0) AS area_sq_km
FROM v_geography
""")
def implied_area(b):
    """area = population / density (null when density is 0)."""
    g = b.geography()
    return g.select("geography_id", "population", "population_density",
                    F.try_divide("population", "population_density").alias("area_sq_km"))


@query("coastal_flag", f"""
SELECT geography_id, region_name, {COASTAL_SQL} AS is_coastal FROM v_geography
""")
def coastal_flag(b):
    """P10, F8: lower-cased region contains a coastal word."""
    return b.geography().select("geography_id", "region_name", M.coastal("region_name").alias("is_coastal"))


@query("geography_summary", """
SELECT count(*) AS n_rows, count(DISTINCT country_code) AS n_countries,
  count(DISTINCT region_name) AS n_regions, count(DISTINCT district_name) AS n_districts,
  sum(population) AS population_total,
  format('{:,}', CAST(round(sum(population)) AS BIGINT)) AS population_total_text
FROM v_geography
""")
def geography_summary(b):
    """Row count, distinct counts, population total and its text."""
    g = b.geography()
    return g.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.countDistinct("country_code").alias("n_countries"),
                 F.countDistinct("region_name").alias("n_regions"),
                 F.countDistinct("district_name").alias("n_districts"),
                 F.sum("population").alias("population_total"),
                 F.format_number(F.sum("population"), 0).alias("population_total_text"))


@query("ordinal_in_parent", """
SELECT geography_id, country_code, region_name, district_name, district_no,
  region_name || ' District ' || CAST(district_no AS VARCHAR) AS district_label
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY country_code, region_name
        ORDER BY district_name, geography_id) AS INTEGER) AS district_no FROM v_geography)
""")
def ordinal_in_parent(b):
    """Ordinal of a district within its region, and its label."""
    w = Window.partitionBy("country_code", "region_name").orderBy("district_name", "geography_id")
    g = b.geography().withColumn("district_no", F.row_number().over(w))
    return g.select("geography_id", "country_code", "region_name", "district_name", "district_no",
                    F.concat("region_name", F.lit(" District "), F.col("district_no").cast("string"))
                    .alias("district_label"))


@query("sub_district_ordinal", """
, sub AS (SELECT DISTINCT g.geography_id, g.region_name, d.district_no, c.c_mktsegment AS sub_district_name
  FROM customer c JOIN v_geography g ON g.n_nationkey = c.c_nationkey
  JOIN (SELECT geography_id, row_number() OVER (PARTITION BY country_code, region_name ORDER BY district_name, geography_id) AS district_no
        FROM v_geography) d ON d.geography_id = g.geography_id WHERE c.c_mktsegment IS NOT NULL)
SELECT geography_id, sub_district_name, CAST(sub_no AS INTEGER) AS sub_district_no,
  region_name || ' District ' || CAST(district_no AS VARCHAR) || ' Sub-district ' || CAST(sub_no AS VARCHAR) AS sub_district_label
FROM (SELECT *, row_number() OVER (PARTITION BY geography_id ORDER BY sub_district_name) AS sub_no FROM sub)
""")
def sub_district_ordinal(b):
    """Ordinal of a sub-district (the customers' segments of a nation) within its district, and its label.
    Customers are reduced to one row a sub-district before the join and the window."""
    sub = (b.t("customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("sub_district_name"))
           .where("sub_district_name is not null").distinct())
    districts = Window.partitionBy("country_code", "region_name").orderBy("district_name", "geography_id")
    g = b.geography().withColumn("district_no", F.row_number().over(districts))
    rows = sub.join(g.select("n_nationkey", "geography_id", "region_name", "district_no"), "n_nationkey")
    rows = rows.withColumn("sub_district_no", F.row_number().over(Window.partitionBy("geography_id").orderBy("sub_district_name")))
    label = F.concat("region_name", F.lit(" District "), F.col("district_no").cast("string"), F.lit(" Sub-district "), F.col("sub_district_no").cast("string"))
    return rows.select("geography_id", "sub_district_name", "sub_district_no", label.alias("sub_district_label"))


@query("dq_adjacent_duplicate", """
SELECT geography_id, prev_geography_id, coalesce(prev_geography_id = geography_id, false) AS is_adjacent_dup
FROM (SELECT geography_id, lag(geography_id) OVER (PARTITION BY country_code
        ORDER BY geography_id, n_nationkey) AS prev_geography_id FROM v_geography)
""")
def dq_adjacent_duplicate(b):
    """Id equal to the previous row's id in id order (ids are prefixed by country,
    so partitioning by country loses no adjacent pair)."""
    w = Window.partitionBy("country_code").orderBy("geography_id", "n_nationkey")
    g = b.geography().withColumn("prev_geography_id", F.lag("geography_id").over(w))
    return g.select("geography_id", "prev_geography_id",
                    F.coalesce(F.col("prev_geography_id") == F.col("geography_id"), F.lit(False))
                    .alias("is_adjacent_dup"))


@query("ref_dims", f"""
SELECT g.geography_id, g.country_code, t.ref_country_name, t.district_share, t.urban_share, t.n_ref_regions,
  coalesce(c.base_rainfall, 50e0) AS base_rainfall, CAST(coalesce(len(c.rainy_months), 0) AS INTEGER) AS n_rainy_months
FROM v_geography g LEFT JOIN {COUNTRY_SQL} ON g.country_code = t.country_code
LEFT JOIN (SELECT * FROM {CLIMATE_SQL}) c ON g.country_code = c.country_code
""")
def ref_dims(b):
    """Geography joined to the country and country-climate dimensions."""
    spark = b.spark
    cd = constant_dim(FA.country_dim(spark).select("country_code", "ref_country_name", "district_share",
                                                   "urban_share", "n_ref_regions"))
    cl = constant_dim(C.country_climate_dim(spark))
    g = b.geography().select("geography_id", "country_code")
    j = g.join(cd, "country_code", "left").join(cl, "country_code", "left")
    return j.select("geography_id", "country_code", "ref_country_name", "district_share", "urban_share",
                    "n_ref_regions",
                    F.coalesce("base_rainfall", F.lit(float(X.DEFAULT_BASE_RAINFALL))).alias("base_rainfall"),
                    F.coalesce(F.size("rainy_months"), F.lit(0)).alias("n_rainy_months"))


REGIME = f"""
, rr AS (
  SELECT cl.geography_id, cl.obs_date, g.country_code, cl.rainfall_mm, cl.humidity_pct,
    coalesce(list_contains(c.rainy_months, month(cl.obs_date)), false) AS rainy_season,
    coalesce(c.base_rainfall, 50e0) AS base_rainfall
  FROM v_climate cl LEFT JOIN (SELECT geography_id, country_code FROM v_geography) g ON cl.geography_id = g.geography_id
  LEFT JOIN (SELECT * FROM {CLIMATE_SQL}) c ON g.country_code = c.country_code
)
, regime AS (
  SELECT *, CASE WHEN rainy_season THEN 200e0 ELSE 50e0 END AS rain_cap,
    CASE WHEN rainy_season THEN 70e0 ELSE 50e0 END AS humidity_base
  FROM rr
)
"""


@query("rain_regime", REGIME + """
SELECT geography_id, obs_date, country_code, rainfall_mm, humidity_pct, rainy_season, base_rainfall,
  rain_cap, humidity_base FROM regime
""")
def rain_regime(b):
    """Country rainy season, rain cap and humidity base per climate row."""
    return C.rain_regime(b.climate(), b.geography_b())


NORMAL = "(30e0 - abs(latitude) / 3e0 + sin(dayofyear(obs_date) / 365e0 * 2e0 * pi()) * (CASE WHEN {c} THEN 5e0 ELSE 10e0 END))"
NORMALS = f"""
, nrm AS (
  SELECT cl.geography_id, cl.obs_date, g.latitude, {COASTAL_SQL} AS is_coastal,
    CAST(dayofyear(cl.obs_date) AS INTEGER) AS day_of_year, cl.temperature_min_c, cl.temperature_max_c
  FROM v_climate cl JOIN v_geography g ON cl.geography_id = g.geography_id
)
, nrm2 AS (SELECT *, {NORMAL.format(c="is_coastal")} AS temp_normal_c FROM nrm)
"""


@query("climate_normal", NORMALS + """
SELECT geography_id, obs_date, latitude, is_coastal, day_of_year, temp_normal_c,
  floor(temp_normal_c * 10e0 + 0.5e0) / 10e0 AS temp_normal_1dp, temperature_min_c, temperature_max_c
FROM nrm2
""")
def climate_normal(b):
    """Seasonal normal temperature per climate row."""
    return C.normals(b.climate(), b.geography_b())


@query("temperature_anomaly", NORMALS + f"""
SELECT geography_id, obs_date, (temperature_min_c + temperature_max_c) / 2 AS temperature_avg_c, temp_normal_c,
  (temperature_min_c + temperature_max_c) / 2 - temp_normal_c AS anomaly_c,
  ((temperature_min_c + temperature_max_c) / 2 - temp_normal_c) / {S.lit(C.ANOMALY_SD)} AS anomaly_z,
  coalesce(abs(((temperature_min_c + temperature_max_c) / 2 - temp_normal_c) / {S.lit(C.ANOMALY_SD)}) > 3, false)
    AS is_anomalous
FROM nrm2
""")
def temperature_anomaly(b):
    """M9: observed daily average minus the normal, z-score and flag."""
    return C.anomaly(b.climate(), b.geography_b())
