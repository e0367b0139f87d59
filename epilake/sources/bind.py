"""Binding views: the driver's tables presented as surveillance tables.

geography <- nation x region (+ customer counts), facility <- supplier,
climate <- orders grouped by (order day, geography), case <- lineitem.
Geography, facility and climate are written once per application to the
shared folder (see `derived`): every query reuses them instead of
recomputing the customer aggregate, the supplier join and the orders x
customer aggregate. Cases (lineitem-sized) stay a lazy view.
The mapping has no health meaning; it gives deterministic inputs with
nulls, duplicates and out-of-range values planted by key arithmetic.
The same definitions are written as SQL in `epilake.plans.oracle_views`.

Scale: geography has one row per nation row (checked bound, broadcast);
facility grows with supplier, climate with distinct (day, geography),
cases with lineitem -- those are joined by shuffle unless AQE sees a
small side at runtime.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilake.operators.joins import bounded_broadcast
from epilake.sources.derived import materialized, materialized_path
from epilake.sources.tables import Tables

# Geography rows are one per nation row; above this the view is not broadcast.
GEOGRAPHY_BROADCAST_ROWS = 100_000
# Climate rows are one per geography-day (25 x ~2,500 here); above this, shuffle join.
CLIMATE_BROADCAST_ROWS = 2_000_000


def zero_pad(n: Column, width: int) -> Column:
    """Decimal text of a non-negative integer, left-padded with zeros to `width`
    and never truncated (as printf's %0Nd; cheaper than format_string per row)."""
    s = n.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def _country_code(regionkey: Column, region_name: Column) -> Column:
    return (F.when(regionkey == 0, F.lit("KE"))
            .when(regionkey == 1, F.lit("NG"))
            .when(regionkey == 2, F.lit("ZA"))
            .otherwise(F.upper(F.substring(region_name, 1, 2))))


class Bindings:
    """Lazily built binding views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = Tables(spark, sf_dir)
        self._memo: dict[str, DataFrame] = {}

    def _get(self, name, build):
        if name not in self._memo:
            self._memo[name] = build()
        return self._memo[name]

    def derived(self, name: str, build) -> DataFrame:
        """A table derived from these inputs, written once per application to the
        shared folder and read back (for small tables many queries share)."""
        return self._get(name, lambda: materialized(self.spark, self.t.sf_dir, name, build))

    # ------------------------------------------------------------------ geography
    def geography(self) -> DataFrame:
        """Geography, written once per application (one row per nation row)."""
        return self._get("geography", lambda: materialized(self.spark, self.t.sf_dir, "geography",
                                                           self._geography))

    def _geography(self) -> DataFrame:
        n = self.t("nation").select("n_nationkey", "n_name", "n_regionkey")
        r = self.t("region").select("r_regionkey", "r_name")
        # partial aggregation map-side: one row per nation leaves each task
        cust = self.t("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_cust"))
        cc = _country_code(F.col("r_regionkey"), F.col("r_name"))
        k = F.col("n_nationkey")
        r = bounded_broadcast(r, max_rows=GEOGRAPHY_BROADCAST_ROWS, cache_key=self.t.path("region"))
        j = (n.join(r, n.n_regionkey == r.r_regionkey, "inner")
             .join(cust, k == F.col("c_nationkey"), "left"))
        return j.select(
            F.concat(cc, F.lit("-"), F.upper(F.substring("n_name", 1, 3)), F.lit("-"),
                     F.lpad(k.cast("string"), 3, "0")).alias("geography_id"),
            k.alias("n_nationkey"),
            cc.alias("country_code"),
            F.col("r_name").alias("country_name"),
            (F.when(k % 5 == 0, F.lit("Coast")).when(k % 5 == 1, F.lit("Lagos"))
             .when(k % 5 == 2, F.lit("Eastern Cape")).otherwise(F.col("n_name"))).alias("region_name"),
            F.col("n_name").alias("district_name"),
            F.when(k == 7, F.lit(None).cast("double"))
             .otherwise((F.coalesce(F.col("n_cust"), F.lit(0)) * 1000).cast("double")).alias("population"),
            F.when(k % 4 == 0, F.lit("Urban")).otherwise(F.lit("Rural")).alias("urban_rural"),
            ((k - 12) * F.lit(2.5)).alias("latitude"),
            (k * F.lit(1.5)).alias("longitude"),
            (k * k * F.lit(2.0)).alias("population_density"),
        )

    def geography_b(self) -> DataFrame:
        """Geography, broadcast when the nation table proves it small."""
        return bounded_broadcast(self.geography(), bound_by=self.t("nation"),
                                 max_rows=GEOGRAPHY_BROADCAST_ROWS,
                                 cache_key=self.t.path("nation"))

    # ------------------------------------------------------------------- facility
    def facility(self) -> DataFrame:
        """Facility, written once per application (one row per supplier row)."""
        return self._get("facility", lambda: materialized(self.spark, self.t.sf_dir, "facility",
                                                          self._facility))

    def _facility(self) -> DataFrame:
        s = self.t("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
        g = self.geography_b().select("n_nationkey", "geography_id", "country_code",
                                      "region_name", "district_name", "latitude", "longitude")
        k = F.col("s_suppkey")
        m6 = k % 6
        ftype = (F.when(m6 == 5, F.lit("National Hospital")).when(m6 == 4, F.lit("Regional Hospital"))
                 .when(m6 == 3, F.lit("District Hospital")).when(m6 == 2, F.lit("Health Center"))
                 .when(m6 == 1, F.lit("Clinic")).otherwise(F.lit("Dispensary")))
        # a facility without its geography stays, under an id that no geography has
        nation = F.when(k % 53 == 0, F.col("s_nationkey") + 1000).otherwise(F.col("s_nationkey"))  # planted orphans
        s = s.withColumn("_nation", nation)
        j = s.join(g, s["_nation"] == g.n_nationkey, "left").withColumn(
            "geography_id", F.coalesce("geography_id", F.concat(F.lit("UNK-"), F.col("_nation").cast("string"))))
        return j.select(
            F.concat(F.lit("FAC-"), zero_pad(k, 5)).alias("facility_id"),
            F.concat_ws(" ", "district_name", F.concat(ftype, F.lit("-"), k.cast("string"))).alias("facility_name"),
            "geography_id", "country_code", "region_name", "district_name",
            F.when(k % 31 == 0, (m6 + 1) % 6 + 1).otherwise(m6 + 1).cast("int").alias("facility_level"),
            ftype.alias("facility_type"),
            F.when(k % 13 == 0, F.lit(None).cast("int"))
             .otherwise(F.floor(F.abs("s_acctbal") / 5).cast("int")).alias("capacity"),
            F.when(k % 11 == 0, F.lit(0))
             .otherwise(F.floor(F.abs("s_acctbal") / 12).cast("int")).alias("staff_count"),
            (((m6 >= 3) & (k % 17 != 0)) | (k % 3 == 0)).alias("has_lab"),
            ((m6 >= 3) | (k % 4 == 0)).alias("has_isolation_ward"),
            ((m6 >= 3) | (k % 5 == 0)).alias("has_xray"),
            (k % 7).cast("int").alias("ambulance_count"),
            (F.col("latitude") + (k % 15 - 7) / F.lit(100.0)).alias("latitude"),
            (F.col("longitude") + (k % 9 - 4) / F.lit(100.0)).alias("longitude"),
            F.when(k % 41 == 7, F.lit("Unknown")).when(k % 20 < 17, F.lit("Operational")).when(k % 20 < 19, F.lit("Under Construction"))
             .otherwise(F.lit("Closed")).alias("operational_status"),
            (1985 + k % 42).cast("int").alias("established_year"),
            k.alias("s_suppkey"),
        )

    # -------------------------------------------------------------------- climate
    def climate(self) -> DataFrame:
        """Climate table, written once per application to the shared folder."""
        return self._get("climate", lambda: self.spark.read.parquet(self.climate_path()))

    def climate_path(self) -> str:
        return materialized_path(self.spark, self.t.sf_dir, "climate", self._climate)

    def geo_day_side(self, df: DataFrame) -> DataFrame:
        """A table with at most one row per climate row (geography-day grain), broadcast
        when the written climate table proves the bound; otherwise left to the planner."""
        return bounded_broadcast(df, bound_by=self.climate(), max_rows=CLIMATE_BROADCAST_ROWS,
                                 cache_key=f"climate:{self.t.sf_dir}")

    def climate_b(self) -> DataFrame:
        """Climate (or any geography-day table derived from it) as a join side:
        broadcast when the written table is proven small (geographies x days)."""
        return bounded_broadcast(self.climate(), max_rows=CLIMATE_BROADCAST_ROWS,
                                 cache_key=f"climate:{self.t.sf_dir}")

    def _climate(self) -> DataFrame:
        o = self.t("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
        c = self.t("customer").select("c_custkey", "c_nationkey")
        g = self.geography_b().select("n_nationkey", "geography_id")
        # orders x customer is the one large join here (shuffle on custkey,
        # AQE splits a hot customer); the geography side is broadcast.
        # observations without a customer or geography stay, under an id that no geography has
        j = (o.join(c, o.o_custkey == c.c_custkey, "left")
             .join(g, F.col("c_nationkey") == g.n_nationkey, "left")
             .withColumn("geography_id", F.coalesce("geography_id", F.concat(F.lit("UNK-"), F.coalesce(
                 F.col("c_nationkey").cast("string"), F.lit(""))))))
        agg = (j.groupBy(F.col("o_orderdate").cast("date").alias("obs_date"), "geography_id")
               .agg(F.min("o_totalprice").alias("_pmin"), F.max("o_totalprice").alias("_pmax"),
                    F.max("o_orderkey").alias("_kmax")))
        km = F.col("_kmax")
        offline = km % 97 == 5  # a station without any measure
        return agg.select(
            "obs_date", "geography_id",
            F.when(~offline, F.round(F.col("_pmin") / 50000, 1)).alias("temperature_min_c"),
            F.when(offline, F.lit(None).cast("double")).when(km % 499 == 0, F.lit(999.9)).otherwise(F.round(F.col("_pmax") / 12000, 1))
             .alias("temperature_max_c"),
            F.when(offline | (km % 200 == 0), F.lit(None).cast("double")).when(km % 503 == 0, F.lit(-5.0))
             .when(km % 3 == 0, F.lit(0.0)).otherwise(F.round(F.col("_pmax") / 2500, 1))
             .alias("rainfall_mm"),
            F.when(~offline, (15 + km % 90).cast("double")).alias("humidity_pct"),
        )

    # ----------------------------------------------------------------------- case
    def case(self) -> DataFrame:
        return self._get("case", self._case)

    LINEITEM_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                     "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")

    def _case(self) -> DataFrame:
        return self.case_from(self.t("lineitem").select(*self.LINEITEM_COLS))

    def case_reported_since(self, first_day) -> DataFrame:
        """Cases with report_date >= `first_day` (a date value). The bound is put on
        `l_shipdate` itself, so Parquet skips row groups outside the range."""
        li = (self.t("lineitem").select(*self.LINEITEM_COLS)
              .filter(F.col("l_shipdate") >= F.lit(first_day).cast("timestamp_ntz")))
        return self.case_from(li)

    def case_from(self, li: DataFrame) -> DataFrame:
        """Case rows from lineitem rows (batch or stream; facility is static). A report whose
        facility is unknown stays, without geography."""
        f = self.facility().select("s_suppkey", "geography_id")
        li = self._with_facility_key(li)
        return self._case_columns(li.join(f, li["_facility"] == f.s_suppkey, "left"))

    @staticmethod
    def _with_facility_key(li: DataFrame) -> DataFrame:
        """The key of the reporting facility; some reports name one that does not exist."""
        key = F.when(F.col("l_partkey") % 307 == 11, F.col("l_suppkey") + 5_000_000).otherwise(F.col("l_suppkey"))
        return li.withColumn("_facility", key)

    def reports(self) -> DataFrame:
        """Case rows without geography_id, for queries that need none: no facility join."""
        li = self.t("lineitem").select(*self.LINEITEM_COLS)
        return self._case_columns(self._with_facility_key(li).withColumn("geography_id", F.lit(None).cast("string"))).drop("geography_id")

    @staticmethod
    def _case_columns(j: DataFrame) -> DataFrame:
        pk = F.col("l_partkey")
        q = F.col("l_quantity")
        ln = F.col("l_linenumber")
        rd = F.col("l_shipdate").cast("date")
        return j.select(
            F.concat(F.lit("CASE-"), zero_pad(F.col("l_orderkey") * 10 + ln, 7)).alias("case_id"),
            rd.alias("report_date"),
            F.date_sub(rd, (pk % 18).cast("int")).alias("case_date"),
            F.concat(F.lit("FAC-"), zero_pad(F.col("_facility"), 5)).alias("facility_id"), "geography_id",
            F.when(F.col("l_returnflag") == "A", F.lit("Malaria"))
             .when(F.col("l_returnflag") == "R", F.lit("Cholera"))
             .otherwise(F.lit("Tuberculosis")).alias("disease"),
            F.when(pk % 101 == 0, F.lit(None).cast("int")).when(pk % 397 == 5, F.lit(-5))
             .otherwise(q.cast("int")).alias("new_cases"),
            F.when(pk % 37 == 0, F.lit(None).cast("int"))
             .otherwise(F.floor(q * F.col("l_discount") * F.lit(0.5)).cast("int")).alias("deaths"),
            F.floor(q * F.lit(0.75)).cast("int").alias("recoveries"),
            (F.when(pk % 211 == 3, F.lit("unknown")).when(ln % 5 == 0, F.lit("0-5")).when(ln % 5 == 1, F.lit("6-17"))
             .when(ln % 5 == 2, F.lit("18-49")).when(ln % 5 == 3, F.lit("50-64"))
             .otherwise(F.lit("65+"))).alias("age_group"),
            F.when(F.col("l_linestatus") == "O", F.lit("M")).otherwise(F.lit("F")).alias("gender"),
        )
