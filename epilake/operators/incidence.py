"""Facility-day expected incidence (M1-M3) and the joins feeding it.

facility-day = operational facility x its geography's climate days. The
climate side is computed once per geography-day (trailing rain included)
before the join, never once per facility.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilake.functions import measures as M
from epilake.operators.climate import climate_features
from epilake.operators.generic import spread
from epilake.sources.bind import Bindings

#: Facilities that one task multiplies by their days (about 2,400 rows each here).
FACILITIES_PER_TASK = 512


def facility_geography(b: Bindings) -> DataFrame:
    """J1 + P1 + P7: facility left join geography(id, population, urban_rural).

    A duplicated geography id multiplies facility rows, as a left merge does.
    """
    g = b.geography_b().select("geography_id", "population", "urban_rural")
    f = b.facility()
    return (f.join(g, "geography_id", "left")
            .withColumn("is_urban", M.is_urban("urban_rural")))


def active_facilities(b: Bindings) -> DataFrame:
    """Operational facilities only (filter pushed below the join)."""
    return facility_geography(b).filter(F.col("operational_status") == "Operational")


def spread_facilities(b: Bindings) -> DataFrame:
    """P2 with the columns of the facility-days, dealt to tasks by the number of facilities."""
    fac = active_facilities(b).select("facility_id", "geography_id", "population", "is_urban")
    return spread(fac, "facility_id", b.facility().count(), FACILITIES_PER_TASK)


def day_features(b: Bindings) -> DataFrame:
    """Climate features and the month per geography-day."""
    return climate_features(b.climate()).withColumn("month", F.month("obs_date"))


def facility_days(b: Bindings) -> DataFrame:
    """J2 + P14: operational facility-days that have a climate row (inner join on
    geography; the climate rows supply the days)."""
    return spread_facilities(b).join(b.geo_day_side(day_features(b)), "geography_id", "inner")


def geography_days(b: Bindings) -> DataFrame:
    """Climate features, month, outbreak columns and their curve per geography-day."""
    from epilake.operators.outbreaks import outbreak_day_columns, with_previous_curve
    return with_previous_curve(day_features(b).join(outbreak_day_columns(b), ["geography_id", "obs_date"], "left"))


def expected_columns() -> dict:
    """M1-M3 by disease, over rows with population, is_urban, month, climate features and outbreak curve."""
    return {
        "Malaria": M.expected_malaria("population", "is_urban", "month", "history_days", "rain_21d", "temperature_avg_c"),
        "Cholera": M.expected_cholera("population", "is_urban", "outbreak_curve", "outbreak_intensity"),
        "Tuberculosis": M.expected_tb("population", "is_urban", "month"),
    }


def facility_days_outbreaks(b: Bindings) -> DataFrame:
    """Facility-days with climate features, the J8 outbreak and its curve: the geography-day
    tables are joined to each other first (small), so the large facility side takes a
    single join."""
    from epilake.operators.outbreaks import resolve_with_curve
    fac = spread_facilities(b)
    return resolve_with_curve(fac.join(b.geo_day_side(geography_days(b)), "geography_id", "inner"))


def expected_malaria(b: Bindings) -> DataFrame:
    fd = facility_days(b)
    return fd.select(
        "facility_id", "geography_id", "obs_date", "population", "is_urban", "rain_21d",
        "history_days", "temperature_avg_c",
        M.expected_malaria("population", "is_urban", "month", "history_days",
                           "rain_21d", "temperature_avg_c").alias("expected_malaria"),
    )


def expected_tb(b: Bindings) -> DataFrame:
    fd = facility_days(b)
    return fd.select(
        "facility_id", "geography_id", "obs_date", "population", "is_urban",
        M.expected_tb("population", "is_urban", "month").alias("expected_tb"),
    )
