"""Facility allocation, type mix and quotas.

Geography has one row per nation row (bounded, broadcast); the facility
type table is six literal rows. Totals use a scalar subquery instead of an
unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epilake import fixed as X
from epilake.functions import measures as M
from epilake.operators.generic import share_of_total, share_within
from epilake.operators.joins import constant_dim, literal_table


def facility_type_dim(spark) -> DataFrame:
    rows = [(t, lvl, float(cap[0]), float(cap[1]), float(st[0]), float(st[1]), float(dens), float(w))
            for t, lvl, cap, st, dens, w in X.FACILITY_TYPES]
    return literal_table(
        spark, "facility_type", rows, "facility_type string, level int, capacity_lo double, capacity_hi double, "
              "staff_lo double, staff_hi double, min_pop_density double, type_weight double")


def level_range_dim(spark) -> DataFrame:
    """Q14 ranges by level band: [min_level, next band's min_level)."""
    rows = []
    upper = 7
    for min_lvl, cap, st, amb in X.LEVEL_RANGES:
        for lvl in range(min_lvl, upper):
            rows.append((lvl, cap[0], cap[1], st[0], st[1], amb[0], amb[1]))
        upper = min_lvl
    return literal_table(
        spark, "level_range", rows, "facility_level int, capacity_lo int, capacity_hi int, staff_lo int, staff_hi int, "
              "ambulance_lo int, ambulance_hi int")


def country_dim(spark) -> DataFrame:
    rows = [(cc, name, share, urban, pop, lat[0], lat[1], lon[0], lon[1], len(X.REGIONS[cc]))
            for cc, name, share, urban, pop, lat, lon in X.COUNTRIES]
    return literal_table(
        spark, "country", rows, "country_code string, ref_country_name string, district_share double, "
              "urban_share double, ref_population long, lat_lo double, lat_hi double, "
              "lon_lo double, lon_hi double, n_ref_regions int")


def allocation(geography: DataFrame, total: int = X.DEFAULT_TOTAL_FACILITIES) -> DataFrame:
    """weight = density (null -> 0), x2 if urban; n = rint(weight / sum * total);
    0 becomes 1. The sum of n may differ from `total`."""
    dens = F.coalesce(F.col("population_density"), F.lit(0.0))
    g = geography.select("geography_id", "urban_rural", "population_density",
                         F.when(M.is_urban("urban_rural"), dens * X.URBAN_ALLOCATION_FACTOR)
                         .otherwise(dens).alias("weight"))
    g = share_of_total(g, "weight", "weight_share")
    n = F.rint(F.col("weight_share") * F.lit(total)).cast("int")
    return g.withColumn("n_facilities", F.when(n == 0, F.lit(1)).otherwise(n))


def type_mix(geography: DataFrame) -> DataFrame:
    """Types with min density < density (strict), weight x3 for levels <= 3 in
    urban geographies, share within geography. No eligible type: Health Center,
    Clinic, Dispensary at 1/3 each."""
    spark = geography.sparkSession
    types = constant_dim(facility_type_dim(spark))
    g = geography.select("geography_id", "urban_rural",
                         F.coalesce(F.col("population_density"), F.lit(0.0)).alias("density"))
    elig = g.join(types, g.density > types.min_pop_density, "inner")
    w = F.when(M.is_urban("urban_rural") & (F.col("level") <= X.URBAN_TYPE_MAX_LEVEL),
               F.col("type_weight") * X.URBAN_TYPE_WEIGHT_FACTOR).otherwise(F.col("type_weight"))
    elig = elig.select("geography_id", "facility_type", F.col("level").alias("facility_level"),
                       w.alias("weight"))
    levels = {t: lvl for t, lvl, *_ in X.FACILITY_TYPES}
    fb = F.array(*[F.struct(F.lit(t).alias("facility_type"), F.lit(levels[t]).alias("facility_level"))
                   for t in X.FALLBACK_TYPES])
    none = g.join(elig.select("geography_id").distinct(), "geography_id", "left_anti")
    # geographies without an eligible type get the three fallback types (generator, no join)
    fallback = (none.select("geography_id", F.explode(fb).alias("_t"))
                .select("geography_id", "_t.facility_type", "_t.facility_level",
                        F.lit(1.0).alias("weight")))
    both = elig.unionByName(fallback)
    return share_within(both, ["geography_id"], "weight", "type_share")


def expected_by_type(geography: DataFrame, total: int = X.DEFAULT_TOTAL_FACILITIES) -> DataFrame:
    """Allocated facilities x type share."""
    a = allocation(geography, total).select("geography_id", "n_facilities")
    m = type_mix(geography)
    return (m.join(a, "geography_id", "inner")
            .withColumn("expected_facilities", F.col("n_facilities") * F.col("type_share")))


def region_dim(spark) -> DataFrame:
    """(country_code, region_name, position from 1, number of regions) as configured."""
    rows = [(c, name, i + 1, len(names)) for c, names in X.REGIONS.items() for i, name in enumerate(names)]
    return constant_dim(literal_table(spark, "regions", rows,
                                      "country_code string, region_name string, region_pos int, n_of_country int"))


def with_region_order(regions: DataFrame) -> DataFrame:
    """Adds region_idx (the configured position; others follow in name order) and n_configured
    (null for a country that is not configured) to distinct (country_code, region_name) rows."""
    dim = region_dim(regions.sparkSession)
    sizes = constant_dim(dim.groupBy("country_code").agg(F.max("n_of_country").alias("n_configured")))
    r = regions.join(dim.select("country_code", "region_name", "region_pos"), ["country_code", "region_name"], "left")
    r = r.join(sizes, "country_code", "left")
    # one row per region of a country: a bounded window
    other = F.row_number().over(Window.partitionBy("country_code", F.col("region_pos").isNull()).orderBy("region_name"))
    idx = F.coalesce("region_pos", F.coalesce("n_configured", F.lit(0)) + other)
    return r.withColumn("region_idx", idx.cast("int")).drop("region_pos")


def district_quota(geography: DataFrame, n: int = X.DEFAULT_TOTAL_DISTRICTS) -> DataFrame:
    """Per country c = int(n * share); per region max(1, c div regions); the
    first region gets int(c * 0.4). Regions have their configured order and number;
    regions and countries that are not configured follow in name order, countries
    without a configured share get share 0."""
    spark = geography.sparkSession
    regions = geography.select("country_code", "region_name").distinct()
    shares = constant_dim(country_dim(spark).select("country_code", "district_share"))
    r = regions.join(shares, "country_code", "left")
    n_reg = regions.groupBy("country_code").agg(F.count(F.lit(1)).alias("n_regions"))
    r = r.join(n_reg, "country_code", "inner")
    c = (F.lit(n) * F.coalesce(F.col("district_share"), F.lit(0.0))).cast("int")
    r = r.withColumn("country_districts", c)
    r = with_region_order(r)
    return r.select(
        "country_code", "region_name", F.coalesce("n_configured", "n_regions").cast("long").alias("n_regions"),
        "country_districts", "region_idx",
    ).withColumn("region_districts",
                 F.when(F.col("region_idx") == 1,
                        (F.col("country_districts") * F.lit(X.FIRST_REGION_DISTRICT_SHARE)).cast("int"))
                 .otherwise(F.greatest(F.lit(1), F.floor(F.col("country_districts") / F.col("n_regions"))
                                       .cast("int"))))
