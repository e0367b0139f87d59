"""The binding views as DuckDB SQL common table expressions.

Every oracle query is `VIEWS` followed by its own body; a body may start
with `, name AS (...)` to add CTEs. Only the base tables are registered
in the oracle, so the views are inlined here. Same semantics as
`epilake.sources.bind`.
"""

VIEWS = """
WITH v_geography AS (
  SELECT
    (CASE r_regionkey WHEN 0 THEN 'KE' WHEN 1 THEN 'NG' WHEN 2 THEN 'ZA' ELSE upper(substr(r_name, 1, 2)) END)
      || '-' || upper(substr(n_name, 1, 3)) || '-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS geography_id,
    n_nationkey,
    CASE r_regionkey WHEN 0 THEN 'KE' WHEN 1 THEN 'NG' WHEN 2 THEN 'ZA' ELSE upper(substr(r_name, 1, 2)) END AS country_code,
    r_name AS country_name,
    CASE n_nationkey % 5 WHEN 0 THEN 'Coast' WHEN 1 THEN 'Lagos' WHEN 2 THEN 'Eastern Cape' ELSE n_name END AS region_name,
    n_name AS district_name,
    CASE WHEN n_nationkey = 7 THEN NULL ELSE CAST(coalesce(n_cust, 0) * 1000 AS DOUBLE) END AS population,
    CASE WHEN n_nationkey % 4 = 0 THEN 'Urban' ELSE 'Rural' END AS urban_rural,
    (n_nationkey - 12) * 2.5e0 AS latitude,
    n_nationkey * 1.5e0 AS longitude,
    n_nationkey * n_nationkey * 2e0 AS population_density
  FROM nation
  JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT c_nationkey, count(*) AS n_cust FROM customer GROUP BY c_nationkey) c ON c_nationkey = n_nationkey
),
v_facility AS (
  SELECT
    printf('FAC-%05d', s_suppkey) AS facility_id,
    concat_ws(' ', district_name,
      (CASE s_suppkey % 6 WHEN 5 THEN 'National Hospital' WHEN 4 THEN 'Regional Hospital' WHEN 3 THEN 'District Hospital'
        WHEN 2 THEN 'Health Center' WHEN 1 THEN 'Clinic' ELSE 'Dispensary' END) || '-' || CAST(s_suppkey AS VARCHAR)) AS facility_name,
    coalesce(geography_id, 'UNK-' || nation_of) AS geography_id, country_code, region_name, district_name,
    CAST(CASE WHEN s_suppkey % 31 = 0 THEN (s_suppkey % 6 + 1) % 6 + 1 ELSE s_suppkey % 6 + 1 END AS INTEGER) AS facility_level,
    CASE s_suppkey % 6 WHEN 5 THEN 'National Hospital' WHEN 4 THEN 'Regional Hospital' WHEN 3 THEN 'District Hospital'
      WHEN 2 THEN 'Health Center' WHEN 1 THEN 'Clinic' ELSE 'Dispensary' END AS facility_type,
    CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE CAST(floor(abs(s_acctbal) / 5) AS INTEGER) END AS capacity,
    CASE WHEN s_suppkey % 11 = 0 THEN 0 ELSE CAST(floor(abs(s_acctbal) / 12) AS INTEGER) END AS staff_count,
    ((s_suppkey % 6 >= 3 AND s_suppkey % 17 <> 0) OR s_suppkey % 3 = 0) AS has_lab,
    (s_suppkey % 6 >= 3 OR s_suppkey % 4 = 0) AS has_isolation_ward,
    (s_suppkey % 6 >= 3 OR s_suppkey % 5 = 0) AS has_xray,
    CAST(s_suppkey % 7 AS INTEGER) AS ambulance_count,
    latitude + (s_suppkey % 15 - 7) / 100e0 AS latitude,
    longitude + (s_suppkey % 9 - 4) / 100e0 AS longitude,
    CASE WHEN s_suppkey % 41 = 7 THEN 'Unknown' WHEN s_suppkey % 20 < 17 THEN 'Operational' WHEN s_suppkey % 20 < 19 THEN 'Under Construction' ELSE 'Closed' END AS operational_status,
    CAST(1985 + s_suppkey % 42 AS INTEGER) AS established_year,
    s_suppkey
  FROM (SELECT *, CASE WHEN s_suppkey % 53 = 0 THEN s_nationkey + 1000 ELSE s_nationkey END AS nation_of FROM supplier)
  LEFT JOIN v_geography ON nation_of = n_nationkey
),
v_climate AS (
  SELECT
    CAST(o_orderdate AS DATE) AS obs_date,
    coalesce(geography_id, 'UNK-' || coalesce(CAST(c_nationkey AS VARCHAR), '')) AS geography_id,
    CASE WHEN max(o_orderkey) % 97 <> 5 THEN round(min(o_totalprice) / 50000, 1) END AS temperature_min_c,
    CASE WHEN max(o_orderkey) % 97 = 5 THEN NULL WHEN max(o_orderkey) % 499 = 0 THEN 999.9e0 ELSE round(max(o_totalprice) / 12000, 1) END AS temperature_max_c,
    CASE WHEN max(o_orderkey) % 97 = 5 OR max(o_orderkey) % 200 = 0 THEN NULL WHEN max(o_orderkey) % 503 = 0 THEN -5e0
      WHEN max(o_orderkey) % 3 = 0 THEN 0e0 ELSE round(max(o_totalprice) / 2500, 1) END AS rainfall_mm,
    CASE WHEN max(o_orderkey) % 97 <> 5 THEN CAST(15 + max(o_orderkey) % 90 AS DOUBLE) END AS humidity_pct
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN v_geography ON c_nationkey = n_nationkey
  GROUP BY 1, 2
),
v_case AS (
  SELECT
    printf('CASE-%07d', l_orderkey * 10 + l_linenumber) AS case_id,
    CAST(l_shipdate AS DATE) AS report_date,
    CAST(l_shipdate AS DATE) - CAST(l_partkey % 18 AS INTEGER) AS case_date,
    printf('FAC-%05d', facility_of) AS facility_id, geography_id,
    CASE l_returnflag WHEN 'A' THEN 'Malaria' WHEN 'R' THEN 'Cholera' ELSE 'Tuberculosis' END AS disease,
    CASE WHEN l_partkey % 101 = 0 THEN NULL WHEN l_partkey % 397 = 5 THEN -5 ELSE CAST(l_quantity AS INTEGER) END AS new_cases,
    CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE CAST(floor(l_quantity * l_discount * 0.5e0) AS INTEGER) END AS deaths,
    CAST(floor(l_quantity * 0.75e0) AS INTEGER) AS recoveries,
    CASE WHEN l_partkey % 211 = 3 THEN 'unknown' ELSE
      CASE l_linenumber % 5 WHEN 0 THEN '0-5' WHEN 1 THEN '6-17' WHEN 2 THEN '18-49' WHEN 3 THEN '50-64' ELSE '65+' END END AS age_group,
    CASE l_linestatus WHEN 'O' THEN 'M' ELSE 'F' END AS gender
  FROM (SELECT *, CASE WHEN l_partkey % 307 = 11 THEN l_suppkey + 5000000 ELSE l_suppkey END AS facility_of FROM lineitem)
  LEFT JOIN v_facility ON facility_of = s_suppkey
)
"""


def with_views(body: str) -> str:
    """Oracle SQL: the binding views, then `body` (a SELECT or `, cte AS (...) SELECT`)."""
    return VIEWS + body
