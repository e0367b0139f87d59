"""Climate operators at geography-day grain.

The climate table has one row per (geography, day), so its size is
bounded by geographies x days whatever the size of the fact tables. Windows
here are partitioned by geography and ordered by day: each window task
holds at most one geography's days. Results are joined to the large
facility-day and case tables on (geography_id, date).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilake import fixed as X
from epilake.functions import measures as M
from epilake.operators.generic import day_range_window, first_per_key
from epilake.operators.joins import constant_dim, literal_table


def climate_first_per_day(climate: DataFrame, key: str = "geography_id",
                          date_col: str = "obs_date") -> DataFrame:
    """One climate row per (geography, day), the smallest by its measures."""
    return first_per_key(climate, [key, date_col])


def with_daily_avg(climate: DataFrame) -> DataFrame:
    """P5: temperature_avg_c = (min + max) / 2."""
    return climate.withColumn("temperature_avg_c",
                              M.temperature_avg("temperature_min_c", "temperature_max_c"))


def with_rain_history(climate: DataFrame, days: int = X.MALARIA_HISTORY_DAYS,
                      key: str = "geography_id", date_col: str = "obs_date") -> DataFrame:
    """Rain over days d-21..d-1 of the same geography (current day excluded).

    `history_days` counts the rows in the frame (rows exist even when the
    rain is null); the sum is taken as a fixed-point decimal so that it does
    not depend on the order in which rows are added.
    """
    w = day_range_window([key], date_col, -days, -1)
    # both aggregates in one select: one Window operator, one sort
    return climate.select(
        "*",
        F.sum(F.col("rainfall_mm").cast("decimal(18,1)")).over(w).cast("double").alias("rain_21d"),
        F.count(F.lit(1)).over(w).alias("history_days"))


def climate_features(climate: DataFrame) -> DataFrame:
    """First row per geography-day, daily average and trailing rain.

    The rain sum takes every row of the days before, repeated ones included; only the
    day's own row is reduced to one. All rows of a day see the same sum.
    """
    return climate_first_per_day(with_rain_history(with_daily_avg(climate)))


def country_climate_dim(spark) -> DataFrame:
    """J6 dimension: country -> (rainy months, base rainfall)."""
    rows = [(cc, months, float(base)) for cc, months, base in X.CLIMATE]
    return literal_table(spark, "country_climate", rows,
                         "country_code string, rainy_months array<int>, base_rainfall double")


def with_regime(climate: DataFrame, geography: DataFrame) -> DataFrame:
    """M10 columns added to every climate row: rainy-season flag by country (unknown
    country: never rainy, base 50), rain cap 200/50 and humidity base 70/50.
    Both joins are to bounded tables (geography, the literal country dimension)."""
    dim = constant_dim(country_climate_dim(climate.sparkSession))
    g = geography.select("geography_id", "country_code")
    j = (climate.join(g, "geography_id", "left")
         .join(dim, "country_code", "left"))
    rainy = F.coalesce(F.array_contains(F.col("rainy_months"), F.month("obs_date")), F.lit(False))
    return j.select(
        *climate.columns, "country_code",
        rainy.alias("rainy_season"),
        F.coalesce(F.col("base_rainfall"), F.lit(float(X.DEFAULT_BASE_RAINFALL))).alias("base_rainfall"),
        F.when(rainy, F.lit(float(X.RAIN_CAP["rainy"]))).otherwise(F.lit(float(X.RAIN_CAP["dry"]))).alias("rain_cap"),
        F.when(rainy, F.lit(float(X.HUMIDITY_BASE["rainy"])))
         .otherwise(F.lit(float(X.HUMIDITY_BASE["dry"]))).alias("humidity_base"),
    )


def rain_regime(climate: DataFrame, geography: DataFrame) -> DataFrame:
    """M10 per climate row."""
    return with_regime(climate, geography).select(
        "geography_id", "obs_date", "country_code", "rainfall_mm", "humidity_pct", "rainy_season",
        "base_rainfall", "rain_cap", "humidity_base")


# sd of the observed daily average around the normal: noise sd 2 plus the two
# half-span draws U(5,12)/2 on min and max, i.e. var += 2 * ((12-5)^2/12) / 16
ANOMALY_SD = math.sqrt(X.TEMP_NOISE_SD ** 2
                       + 2 * ((X.TEMP_SPAN_RANGE[1] - X.TEMP_SPAN_RANGE[0]) ** 2 / 12) / 16)


def round_half_up(c, digits: int):
    """floor(x * 10^d + 0.5) / 10^d: the same double in Spark and SQL engines."""
    f = float(10 ** digits)
    return F.floor(c * f + F.lit(0.5)) / f


def normals(climate: DataFrame, geography: DataFrame) -> DataFrame:
    """M8: seasonal normal temperature per geography-day."""
    g = geography.select("geography_id", "latitude", "region_name")
    j = climate.join(g, "geography_id", "inner")
    normal = M.climate_normal("latitude", "region_name", F.dayofyear("obs_date"))
    return j.select("geography_id", "obs_date", "latitude", M.coastal("region_name").alias("is_coastal"),
                    F.dayofyear("obs_date").alias("day_of_year"), normal.alias("temp_normal_c"),
                    round_half_up(normal, 1).alias("temp_normal_1dp"),
                    "temperature_min_c", "temperature_max_c")


def anomaly(climate: DataFrame, geography: DataFrame) -> DataFrame:
    """M9: observed daily average minus the normal; z against the generator's sd."""
    n = normals(climate, geography)
    obs = M.temperature_avg("temperature_min_c", "temperature_max_c")
    a = obs - F.col("temp_normal_c")
    z = a / F.lit(ANOMALY_SD)
    return n.select("geography_id", "obs_date", obs.alias("temperature_avg_c"), "temp_normal_c",
                    a.alias("anomaly_c"), z.alias("anomaly_z"),
                    F.coalesce(F.abs(z) > 3, F.lit(False)).alias("is_anomalous"))
