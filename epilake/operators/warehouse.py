"""Warehouse tables planned in the reference's prose (L3-L8): type-2 facility
history, the surveillance fact, dimensions, regional rollups, forecasting
features and bed pressure. All joins are equi-joins; windows run over
geography-day tables (bounded by geographies x days) or over dimensions.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epilake import fixed as X
from epilake.functions import measures as M
from epilake.operators import incidence as I
from epilake.operators import outbreaks as O
from epilake.operators.generic import date_spine, day_range_window, sequence_id
from epilake.operators.ordered import asof_join
from epilake.sources.bind import Bindings

# Days of the facility extracts that the history is merged from; the last one is the incoming extract of L3.
SNAPSHOT_DAYS = [_dt.date(1996, 12, 31), _dt.date(1998, 12, 31), _dt.date(2000, 12, 31)]
SCD_AS_OF = SNAPSHOT_DAYS[-1]
# An extract lists the facilities that reported in the days before it; those without a report in the last days are quiet.
EXTRACT_DAYS, QUIET_DAYS = 10, 3
SCD_TRACKED = ["capacity", "staff_count", "operational_status", "facility_type"]


def row_hash(cols) -> F.Column:
    """Hash of the tracked values, each with its length in front, so that no two lists of values meet; null is marked."""
    def part(c):
        s = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("n"))
    return F.md5(F.concat(*[part(c) for c in cols]))


def facility_extract(b: Bindings, as_of) -> DataFrame:
    """The facilities that reported within EXTRACT_DAYS up to `as_of`, as they stood then: without a report in the last
    QUIET_DAYS an operational status reads Quiet. Reports are reduced to one row a facility before the join."""
    last = (b.reports().where(F.col("report_date").between(F.date_sub(F.lit(as_of), EXTRACT_DAYS - 1), F.lit(as_of)))
            .groupBy("facility_id").agg(F.max("report_date").alias("_last")))
    quiet = F.col("_last") <= F.date_sub(F.lit(as_of), QUIET_DAYS)
    return (b.facility().select("facility_id", *SCD_TRACKED).join(last, "facility_id")
            .withColumn("operational_status", F.when(quiet, F.lit("Quiet")).otherwise(F.col("operational_status")))
            .select("facility_id", *SCD_TRACKED))


def scd2(current: DataFrame, incoming: DataFrame, as_of=SCD_AS_OF) -> DataFrame:
    """L3: type-2 merge of a snapshot into the current rows. One full outer join on
    the key; each joined row emits its closed and/or new version via a generator."""
    cur = current.select("facility_id", *[F.col(c).alias(f"c_{c}") for c in SCD_TRACKED], "valid_from",
                         row_hash(SCD_TRACKED).alias("c_hash"))
    inc = incoming.select("facility_id", *[F.col(c).alias(f"n_{c}") for c in SCD_TRACKED],
                          row_hash(SCD_TRACKED).alias("n_hash"))
    j = cur.join(inc, "facility_id", "full")
    has_c, has_n = F.col("c_hash").isNotNull(), F.col("n_hash").isNotNull()
    changed = has_c & has_n & (F.col("c_hash") != F.col("n_hash"))
    d = F.lit(as_of)
    old_v = F.when(has_c, F.struct(
        *[F.col(f"c_{c}").alias(c) for c in SCD_TRACKED], F.col("c_hash").alias("row_hash"),
        F.col("valid_from").alias("valid_from"),
        F.when(changed | ~has_n, d).alias("valid_to"),
        (~(changed | ~has_n)).alias("is_current"),
        F.when(changed, F.lit("closed")).when(~has_n, F.lit("deleted")).otherwise(F.lit("unchanged"))
        .alias("change_type")))
    new_v = F.when(has_n & (changed | ~has_c), F.struct(
        *[F.col(f"n_{c}").alias(c) for c in SCD_TRACKED], F.col("n_hash").alias("row_hash"),
        d.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current"),
        F.when(changed, F.lit("changed")).otherwise(F.lit("inserted")).alias("change_type")))
    out = j.select("facility_id", F.explode(F.array_compact(F.array(old_v, new_v))).alias("v"))
    return out.select("facility_id", "v.*")


def scd2_merge(history: DataFrame, incoming: DataFrame, as_of=SCD_AS_OF) -> DataFrame:
    """A later merge: closed versions of `history` (rows of `scd2`) stay as they are, the open ones
    meet the new snapshot."""
    cols = ["facility_id", *SCD_TRACKED, "row_hash", "valid_from", "valid_to", "is_current"]
    merged = scd2(history.filter("is_current").select("facility_id", *SCD_TRACKED, "valid_from"), incoming, as_of)
    return history.filter(~F.col("is_current")).select(*cols).withColumn("change_type", F.lit("history")).unionByName(
        merged.select(*cols, "change_type"))


def scd2_facilities(b: Bindings) -> DataFrame:
    cur = b.facility().withColumn("valid_from", F.make_date("established_year", F.lit(1), F.lit(1)))
    return scd2(cur, facility_extract(b, SCD_AS_OF))


HISTORY = ["facility_id", *SCD_TRACKED, "row_hash", "valid_from", "valid_to", "is_current"]


def history_of(extracts) -> DataFrame:
    """Type-2 history merged from (day, extract) pairs in order of day: versions are valid from the day of the extract
    that shows them up to (not with) that of the next one that shows another or none."""
    history = None
    for day, rows in extracts:
        if history is None:
            history = rows.select("facility_id", *SCD_TRACKED, row_hash(SCD_TRACKED).alias("row_hash"), F.lit(day).alias("valid_from"),
                                  F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current"))
        else:
            history = scd2_merge(history, rows, day).select(*HISTORY)
    return history


def facility_history(b: Bindings) -> DataFrame:
    """L3: the facilities' versions over all extracts, written once per application."""
    return b.derived("facility_history", lambda: history_of([(d, facility_extract(b, d)) for d in SNAPSHOT_DAYS]))


def fact_facility_versions(b: Bindings) -> DataFrame:
    """L4 against L3: every report with the version of its facility on the day of the report, not with today's."""
    facts = b.reports().select("case_id", "report_date", "facility_id", "disease", "new_cases")
    versions = facility_history(b).withColumn("version_from", F.col("valid_from"))
    return asof_join(facts, versions, "facility_id", "report_date", payload=["version_from", "facility_type", "operational_status", "capacity"])


def fact_surveillance(b: Bindings) -> DataFrame:
    """L4: one row per case report with facility, geography, same-day climate and the
    expected count for that facility, day and disease (null when not positive).

    The expected count is a function of the report's facility, its geography and the
    geography-day, so it is evaluated on the report: the geography-day table is joined
    for the climate anyway, and no facility-day panel is built or shuffled."""
    f = b.facility().select("facility_id", "facility_type", "operational_status")
    g = b.geography_b().select("geography_id", "country_code", "region_name", "population",
                               M.is_urban("urban_rural").alias("is_urban"))
    day = b.geo_day_side(I.geography_days(b).withColumn("_observed", F.lit(True)).drop("temperature_min_c", "temperature_max_c", "humidity_pct"))
    j = (b.case().withColumn("obs_date", F.col("report_date")).join(f, "facility_id", "left").join(g, "geography_id", "left")
         .join(day, ["geography_id", "obs_date"], "left"))
    j = O.resolve_with_curve(j)
    expected = None
    for disease, column in I.expected_columns().items():
        is_it = F.col("disease") == disease
        expected = F.when(is_it, column) if expected is None else expected.when(is_it, column)
    reports = F.col("_observed") & (F.col("operational_status") == "Operational") & (F.col("_expected") > 0)
    return j.withColumn("_expected", expected).select("case_id", "report_date", "facility_id", "facility_type", "geography_id", "country_code",
                    "region_name", "disease", "new_cases", "deaths", "rainfall_mm", "temperature_avg_c",
                    F.when(reports, F.col("_expected")).alias("expected_cases"))


def dim_facilities(b: Bindings) -> DataFrame:
    """Facility dimension with a dense surrogate key in id order."""
    f = b.facility().select("facility_id", "facility_name", "facility_type", "facility_level", "geography_id",
                            "district_name", "capacity", "operational_status")
    return sequence_id(f, ["facility_id"], "facility_key")


def dim_geography(b: Bindings) -> DataFrame:
    g = b.geography().select("geography_id", "country_code", "country_name", "region_name", "district_name",
                             "population", "urban_rural")
    return sequence_id(g, ["geography_id"], "geography_key", num_partitions=1)


def dim_date(b: Bindings) -> DataFrame:
    """One row per day from the first to the last report or climate day."""
    c = b.case().agg(F.min("report_date").alias("a0"), F.max("report_date").alias("a1"))
    k = b.climate().agg(F.min("obs_date").alias("b0"), F.max("obs_date").alias("b1"))
    d0 = F.least(c.select("a0").scalar(), k.select("b0").scalar())
    d1 = F.greatest(c.select("a1").scalar(), k.select("b1").scalar())
    s = b.spark.range(1).select(date_spine(d0, d1, "date"))
    dow = F.weekday("date") + 1
    return s.select(F.date_format("date", "yyyyMMdd").cast("int").alias("date_key"), "date",
                    F.year("date").alias("year"), F.quarter("date").alias("quarter"),
                    F.month("date").alias("month"), F.dayofmonth("date").alias("day_of_month"),
                    dow.alias("iso_day_of_week"), F.dayofyear("date").alias("day_of_year"),
                    (dow >= 6).alias("is_weekend"), F.date_format("date", "yyyy-MM").alias("year_month"))


def region_trend(b: Bindings) -> DataFrame:
    """Cases by disease with a rollup over country > region > month."""
    c = b.case().join(b.geography_b().select("geography_id", "country_code", "region_name"), "geography_id",
                      "left").withColumn("report_month", F.date_format("report_date", "yyyy-MM"))
    keys = ["disease", "country_code", "region_name", "report_month"]
    sets = [keys[:i] for i in range(len(keys), 0, -1)]
    g = c.groupingSets(sets, *keys).agg(F.sum("new_cases").alias("cases"),
                                        F.count(F.lit(1)).alias("n_reports"),
                                        F.grouping_id().alias("grouping_level"))
    return g


def lead_features(b: Bindings) -> DataFrame:
    """Per geography-day, rain over the last 21 days, cases over the last 7/14/28
    days and the label: cases 14..28 days ahead. Cases are aggregated to
    geography-day before the windows; days come from climate and cases."""
    daily = b.case().groupBy("geography_id", F.col("report_date").alias("obs_date")) \
        .agg(F.sum("new_cases").alias("cases"))
    clim = b.climate().select("geography_id", "obs_date", "rainfall_mm")
    gd = clim.join(daily, ["geography_id", "obs_date"], "full")

    def s(col, lo, hi):
        return F.sum(col).over(day_range_window(["geography_id"], "obs_date", lo, hi))
    rain = F.sum(F.col("rainfall_mm").cast("decimal(18,1)")).over(
        day_range_window(["geography_id"], "obs_date", -X.MALARIA_HISTORY_DAYS, -1)).cast("double")
    return gd.select("geography_id", "obs_date", "cases", rain.alias("rain_21d"),
                     s("cases", -7, -1).alias("cases_7d"), s("cases", -14, -1).alias("cases_14d"),
                     s("cases", -28, -1).alias("cases_28d"), s("cases", 14, 28).alias("label_cases_14_28d"))


def bed_pressure(b: Bindings, days: int = X.MAX_REPORT_DELAY_DAYS) -> DataFrame:
    """Patients still sick (M18) in the last `days` report days per district over
    operational beds, ranked (district table is bounded by geography)."""
    # the last report day as a value (one narrow scan), so the recent-days bound is a
    # literal that reaches the lineitem scan as a pushed filter
    last = b.case().agg(F.max("report_date")).first()[0]
    if last is None:
        recent = b.case().filter(F.lit(False))
    else:
        recent = b.case_reported_since(last - _dt.timedelta(days=days - 1))
    # a facility without a geography has no district
    fac = (b.facility().filter(F.col("district_name").isNotNull())
           .select("facility_id", "district_name", "capacity", "operational_status"))
    sick = (recent.join(fac.select("facility_id", "district_name"), "facility_id", "inner")
            .groupBy("district_name")
            .agg(F.sum(F.col("new_cases") - F.col("deaths") - F.col("recoveries")).alias("still_sick")))
    beds = (fac.filter(F.col("operational_status") == "Operational").groupBy("district_name")
            .agg(F.sum("capacity").alias("beds")))
    j = sick.join(beds, "district_name", "full")
    p = F.try_divide(F.col("still_sick"), F.col("beds"))
    w = Window.orderBy(F.desc_nulls_last("pressure"), "district_name")
    return j.select("district_name", "still_sick", "beds", p.alias("pressure")) \
        .withColumn("pressure_rank", F.row_number().over(w))
