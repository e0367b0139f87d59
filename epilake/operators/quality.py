"""Data-quality rules (Q1-Q23, J10, J11), re-aimed from the defects the
reference injects: each rule yields violation rows

    (table_name, rule, record_key, column_name, value, value_text)

Row rules are specs (rule, column, condition, value). A table's rules run
in ONE pass over the table: each row emits the violations it has through
`explode(array_compact(array(when(cond, struct(...)), ...)))`, so the
report reads every table once however many rules there are. Rules that
need a small dimension (types, level ranges, country boxes, climate
regime) get one broadcast join before the pass. Key rules aggregate
(partial aggregation map-side, so a key holding a third of all rows is
counted before the shuffle); orphan checks are anti joins.
`clean_cases` keeps the first row per case id and drops rows failing any
row rule, with no join. The report counts the violations of the cases
by case id (`count_rules`) and makes no row for each of them.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilake import fixed as X
from epilake.operators import facilities as FA
from epilake.operators.climate import with_regime
from epilake.operators.generic import first_per_key, missing_days
from epilake.operators.joins import bounded_broadcast, constant_dim
from epilake.operators.ordered import gaps
from epilake.sources.bind import Bindings

# plausible band for a daily temperature, degrees C
TEMP_PLAUSIBLE = (-30.0, 60.0)
# tolerance for values the generator rounded (1 decimal)
ROUND_TOL = 0.1


def _viol(df: DataFrame, table: str, rule: str, key: Column, column: str,
          value: Column | None = None, text: Column | None = None) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                     key.alias("record_key"), F.lit(column).alias("column_name"),
                     (value.cast("double") if value is not None else F.lit(None).cast("double")).alias("value"),
                     (text if text is not None else F.lit(None).cast("string")).alias("value_text"))


def climate_key() -> Column:
    return F.concat_ws("|", F.col("geography_id"), F.col("obs_date").cast("string"))


def case_delay() -> Column:
    return F.datediff("report_date", "case_date")


# ----------------------------------------------------------------- row rules
def case_row_flags(cases: DataFrame) -> dict[str, Column]:
    """Row-level case rules -> boolean Column (true = violation, never null, so
    every row is either clean or quarantined)."""
    nc, de, rc = F.col("new_cases"), F.col("deaths"), F.col("recoveries")
    d = case_delay()
    return {
        "null_new_cases": nc.isNull(),
        "negative_count": F.coalesce(nc < 0, F.lit(False)) | F.coalesce(de < 0, F.lit(False)),
        "deaths_gt_cases": F.coalesce(de > nc, F.lit(False)),
        "outcomes_gt_cases": F.coalesce(de + rc > nc, F.lit(False)),
        "delay_out_of_range": F.coalesce(~d.between(0, X.MAX_REPORT_DELAY_DAYS), F.lit(False)),
        "bad_domain": ~(F.coalesce(F.col("disease").isin(X.DISEASES), F.lit(False))
                        & F.coalesce(F.col("age_group").isin(X.AGE_GROUPS), F.lit(False))
                        & F.coalesce(F.col("gender").isin(X.GENDERS), F.lit(False))),
    }


class Rule(NamedTuple):
    """A row rule: `cond` true means a violation (null counts as no violation)."""
    rule: str
    column: str
    cond: Column
    value: Column | None = None
    text: Column | None = None


def emit(df: DataFrame, table: str, key: Column, rules: list[Rule]) -> DataFrame:
    """One pass over `df`: one output row per (input row, rule it breaks)."""
    hits = F.array_compact(F.array(*[
        F.when(r.cond, F.struct(
            F.lit(r.rule).alias("rule"), F.lit(r.column).alias("column_name"),
            (r.value if r.value is not None else F.lit(None)).cast("double").alias("value"),
            (r.text if r.text is not None else F.lit(None)).cast("string").alias("value_text")))
        for r in rules]))
    return (df.select(F.lit(table).alias("table_name"), key.alias("record_key"), F.explode(hits).alias("v"))
            .select("table_name", "v.rule", "record_key", "v.column_name", "v.value", "v.value_text"))


def _outside(c: Column, allowed) -> Column:
    return ~F.coalesce(c.isin(allowed), F.lit(False))


# ---------------------------------------------------------------------- cases
def case_rules() -> dict[str, list[Rule]]:
    nc, de, rc = F.col("new_cases"), F.col("deaths"), F.col("recoveries")
    d = case_delay()
    return {
        "nulls": [Rule("null_new_cases", "new_cases", nc.isNull()),
                  Rule("null_deaths", "deaths", de.isNull())],
        "negative": [Rule("negative_count", "new_cases", (nc < 0) | (de < 0), nc)],
        "counts": [Rule("deaths_gt_cases", "deaths", de > nc, de),
                   Rule("outcomes_gt_cases", "recoveries", de + rc > nc, de + rc)],
        "delay": [Rule("delay_out_of_range", "case_date", ~d.between(0, X.MAX_REPORT_DELAY_DAYS), d)],
        "domain": [Rule("bad_domain", c, _outside(F.col(c), allowed), None, F.col(c))
                   for c, allowed in [("disease", X.DISEASES), ("age_group", X.AGE_GROUPS),
                                      ("gender", X.GENDERS)]],
    }


# facility rows under which the facility key list is broadcast into the case pass
FACILITY_BROADCAST_ROWS = 5_000_000


def _case_pass(b: Bindings, groups=None, with_orphans: bool = False) -> tuple[DataFrame, list[Rule]]:
    """Case rows and the rules that are read from them in one pass. With `with_orphans`, cases whose
    facility is missing (J10) are flagged too: a left join to the facility keys (broadcast when the
    written facility table proves small) replaces a separate scan and anti join."""
    r = case_rules()
    rules = [x for g in (groups or r) for x in r[g]]
    frame = b.case()
    if with_orphans:
        # distinct keys: a duplicated facility id must not multiply case rows
        keys = bounded_broadcast(b.facility().select("facility_id").distinct()
                                 .withColumn("_has_facility", F.lit(True)),
                                 bound_by=b.facility(), max_rows=FACILITY_BROADCAST_ROWS,
                                 cache_key=f"facility:{b.t.sf_dir}")
        frame = frame.join(keys, "facility_id", "left")
        rules = rules + [Rule("orphan_facility", "facility_id", F.col("_has_facility").isNull(), None,
                              F.col("facility_id"))]
    return frame, rules


def case_violations(b: Bindings, groups=None, with_orphans: bool = False) -> DataFrame:
    """Case row rules in one pass, orphans (J10) with `with_orphans`."""
    frame, rules = _case_pass(b, groups, with_orphans)
    return emit(frame, "case", F.col("case_id"), rules)


def negative_cases(cases: DataFrame) -> DataFrame:
    """Q4: negative new_cases or deaths."""
    neg = cases.filter((F.col("new_cases") < 0) | (F.col("deaths") < 0))
    return neg.select("case_id", "facility_id", "report_date", "disease", "new_cases", "deaths")


def case_counts(b: Bindings) -> DataFrame:
    """Q10: deaths > new_cases, deaths + recoveries > new_cases."""
    return case_violations(b, ["counts"])


def delay_range(b: Bindings) -> DataFrame:
    """Q11: reporting delay outside 0..14 days."""
    return case_violations(b, ["delay"])


# -------------------------------------------------------------------- climate
def climate_frame(b: Bindings) -> DataFrame:
    """Climate rows with their regime (one left join to geography and the dimension)."""
    return with_regime(b.climate(), b.geography_b())


def climate_rules() -> dict[str, list[Rule]]:
    lo, hi = TEMP_PLAUSIBLE
    tmin, tmax = F.col("temperature_min_c"), F.col("temperature_max_c")
    rain, h, base = F.col("rainfall_mm"), F.col("humidity_pct"), F.col("humidity_base")
    s_lo, s_hi = X.TEMP_SPAN_RANGE
    span = tmax - tmin
    lo_w, hi_w = X.HUMIDITY_WET_ADD
    lo_d, hi_d = X.HUMIDITY_DRY_SUB
    hmin, hmax = X.HUMIDITY_RANGE
    wet_ok = h.between(F.least(base + lo_w, F.lit(float(hmax))), F.least(base + hi_w, F.lit(float(hmax))))
    dry_ok = h.between(F.greatest(base - hi_d, F.lit(float(hmin))), F.greatest(base - lo_d, F.lit(float(hmin))))
    # rain exactly 0.0 (a trace may have been rounded away) or unknown: either band
    ok = (F.when(rain.isNull() | (rain == 0), wet_ok | dry_ok)
          .when(rain > 0, wet_ok).otherwise(dry_ok)) & h.between(hmin, hmax)
    return {
        "nulls": [Rule("null_rainfall", "rainfall_mm", rain.isNull())],
        "range": [Rule("negative_rainfall", "rainfall_mm", rain < 0, rain),
                  Rule("temperature_outlier", "temperature_max_c", ~tmax.between(lo, hi), tmax),
                  Rule("temperature_outlier", "temperature_min_c", ~tmin.between(lo, hi), tmin)],
        "offline": [Rule("station_offline", "*", tmin.isNull() & tmax.isNull() & rain.isNull() & h.isNull())],
        "span": [Rule("temperature_span", "temperature_max_c",
                      (span < s_lo - ROUND_TOL) | (span > s_hi + ROUND_TOL), span)],
        "rain_cap": [Rule("rain_above_cap", "rainfall_mm", rain > F.col("rain_cap"), rain)],
        "humidity": [Rule("humidity_inconsistent", "humidity_pct",
                          h.isNotNull() & ~F.coalesce(ok, F.lit(False)), h)],
    }


NEEDS_REGIME = {"rain_cap", "humidity"}


def climate_violations(b: Bindings, groups=None) -> DataFrame:
    r = climate_rules()
    groups = list(groups or r)
    frame = climate_frame(b) if NEEDS_REGIME & set(groups) else b.climate()
    return emit(frame, "climate", climate_key(), [x for g in groups for x in r[g]])


def climate_range(b: Bindings) -> DataFrame:
    """Q5, Q6: negative rainfall; temperature outside the plausible band."""
    return climate_violations(b, ["range"])


def station_offline(b: Bindings) -> DataFrame:
    """Q7: all four measures null."""
    return climate_violations(b, ["offline"])


def temp_span(b: Bindings) -> DataFrame:
    """Q18: max - min outside [5, 12] (+-0.1 for rounding)."""
    return climate_violations(b, ["span"])


def rain_cap(b: Bindings) -> DataFrame:
    """Q19: rainfall above the regime's cap (200 rainy season, 50 otherwise)."""
    return climate_violations(b, ["rain_cap"])


def humidity(b: Bindings) -> DataFrame:
    """Q20: humidity consistent with the day's rain and season. Wet day: [base+10, base+30]
    capped at 100; dry day: [base-15, base-5] floored at 20; always [20, 100]."""
    return climate_violations(b, ["humidity"])


def panel_gaps(b: Bindings) -> DataFrame:
    """Geography-days of the daily panel (first..last observed day) with no
    climate row. The panel is a per-geography generator, not a cross join."""
    clim = b.climate()
    start = clim.select(F.min("obs_date")).scalar()
    end = clim.select(F.max("obs_date")).scalar()
    geo = b.geography().select("geography_id")
    return missing_days(geo, "geography_id", clim, "obs_date", start, end)


# ------------------------------------------------------------------ facility
def facility_frame(b: Bindings) -> DataFrame:
    """Facility rows with their type's level, their level's ranges and their
    geography's point (three left joins to bounded tables, all broadcast)."""
    types = constant_dim(FA.facility_type_dim(b.spark).select("facility_type", F.col("level").alias("type_level")))
    ranges = constant_dim(FA.level_range_dim(b.spark))
    g = b.geography_b().select("geography_id", F.col("latitude").alias("g_lat"), F.col("longitude").alias("g_lon"))
    return (b.facility().join(types, "facility_type", "left").join(ranges, "facility_level", "left")
            .join(g, "geography_id", "left"))


def facility_rules() -> dict[str, list[Rule]]:
    lvl, tl = F.col("facility_level"), F.col("type_level")
    full = F.coalesce(F.col("has_lab") & F.col("has_isolation_ward") & F.col("has_xray"), F.lit(False))
    tol = X.FACILITY_OFFSET_DEG + 1e-6
    dlat = F.abs(F.col("latitude") - F.col("g_lat"))
    dlon = F.abs(F.col("longitude") - F.col("g_lon"))
    y = F.col("established_year")
    ylo, yhi = X.ESTABLISHED_YEAR_RANGE

    def out(c, lo, hi):
        v = F.col(c)
        return Rule(f"{c}_out_of_range", c, (v < F.col(lo)) | (v >= F.col(hi)), v)
    return {
        "domain": [Rule("bad_domain", "operational_status",
                        _outside(F.col("operational_status"), [s for s, _ in X.OPERATIONAL_STATUS]),
                        None, F.col("operational_status"))],
        "nulls": [Rule("null_capacity", "capacity", F.col("capacity").isNull())],
        "beds": [Rule("beds_no_staff", "staff_count", (F.col("capacity") > 0) & (F.col("staff_count") == 0),
                      F.col("capacity"))],
        "capability": [Rule("missing_services", "facility_type", (tl >= X.FULL_SERVICE_MIN_LEVEL) & ~full, tl,
                            F.col("facility_type")),
                       Rule("level_mismatch", "facility_level", tl != lvl, lvl, F.col("facility_type"))],
        "ranges": [out("capacity", "capacity_lo", "capacity_hi"), out("staff_count", "staff_lo", "staff_hi"),
                   out("ambulance_count", "ambulance_lo", "ambulance_hi")],
        "distance": [Rule("far_from_geography", "latitude", dlat > tol, dlat),
                     Rule("far_from_geography", "longitude", dlon > tol, dlon)],
        "year": [Rule("established_year_out_of_range", "established_year", (y < ylo) | (y >= yhi), y)],
    }


def facility_violations(b: Bindings, groups=None) -> DataFrame:
    r = facility_rules()
    rules = [x for g in (groups or r) for x in r[g]]
    return emit(facility_frame(b), "facility", F.col("facility_id"), rules)


def beds_no_staff(b: Bindings) -> DataFrame:
    """Q9: capacity > 0 and staff_count = 0."""
    return facility_violations(b, ["beds"])


def capability(b: Bindings) -> DataFrame:
    """Facility type -> level (dimension lookup); level >= 4 must have lab,
    isolation ward and X-ray; recorded level must equal the type's level."""
    return facility_violations(b, ["capability"])


def capacity_range(b: Bindings) -> DataFrame:
    """Q14: capacity, staff, ambulances within [lo, hi) of the facility's level."""
    return facility_violations(b, ["ranges"])


def facility_distance(b: Bindings) -> DataFrame:
    """Q15: facility more than 0.05 degrees from its geography point."""
    return facility_violations(b, ["distance"])


def established_year(b: Bindings) -> DataFrame:
    """Q21: established year outside [1990, 2024)."""
    return facility_violations(b, ["year"])


# ----------------------------------------------------------------- geography
def geography_frame(b: Bindings) -> DataFrame:
    dim = constant_dim(FA.country_dim(b.spark).select("country_code", "lat_lo", "lat_hi", "lon_lo", "lon_hi"))
    return b.geography().join(dim, "country_code", "left")


def _by_class(c: Column, ranges) -> Column:
    u = F.col("urban_rural")
    cond = None
    for cls, (lo, hi) in ranges.items():
        e = (c < lo) | (c >= hi)
        cond = F.when(u == cls, e) if cond is None else cond.when(u == cls, e)
    return cond


def geography_rules() -> dict[str, list[Rule]]:
    lat, lon = F.col("latitude"), F.col("longitude")
    pop, dens = F.col("population"), F.col("population_density")
    return {
        "domain": [Rule("bad_domain", "urban_rural", _outside(F.col("urban_rural"), X.URBAN_RURAL), None,
                        F.col("urban_rural"))],
        "nulls": [Rule("null_population", "population", pop.isNull())],
        # unknown countries have no box (null bounds): not checked
        "bounds": [Rule("outside_country", "latitude", ~lat.between(F.col("lat_lo"), F.col("lat_hi")), lat),
                   Rule("outside_country", "longitude", ~lon.between(F.col("lon_lo"), F.col("lon_hi")), lon)],
        "population": [Rule("population_out_of_range", "population", _by_class(pop, X.POPULATION_RANGE), pop),
                       Rule("density_out_of_range", "population_density", _by_class(dens, X.DENSITY_RANGE), dens)],
    }


def geography_violations(b: Bindings, groups=None) -> DataFrame:
    r = geography_rules()
    groups = list(groups or r)
    frame = geography_frame(b) if "bounds" in groups else b.geography()
    return emit(frame, "geography", F.col("geography_id"), [x for g in groups for x in r[g]])


def geo_bounds(b: Bindings) -> DataFrame:
    """Q16: geography point outside its country's box (configured countries only)."""
    return geography_violations(b, ["bounds"])


def population_range(b: Bindings) -> DataFrame:
    """Q17: population [lo, hi) and density [lo, hi) by urban/rural class."""
    return geography_violations(b, ["population"])


def domain_values(b: Bindings) -> DataFrame:
    """Q12: values outside the allowed sets."""
    return (case_violations(b, ["domain"]).unionByName(facility_violations(b, ["domain"]))
            .unionByName(geography_violations(b, ["domain"])))


def gap_intervals(b: Bindings) -> DataFrame:
    """Q8: the runs of days without a climate row of each geography, one row a run; no panel is built."""
    climate = b.climate().select("geography_id", "obs_date")
    first, last = climate.agg(F.min("obs_date"), F.max("obs_date")).first()
    keys = b.geography().select("geography_id")
    return gaps(keys if first else keys.limit(0), "geography_id", climate, "obs_date", F.lit(first).cast("date"), F.lit(last).cast("date"))


# ---------------------------------------------------------------- key rules
def _duplicates(df: DataFrame, table: str, key: str) -> DataFrame:
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return _viol(g, table, "duplicate_key", F.col(key), key, F.col("n"))


def duplicate_keys(b: Bindings) -> DataFrame:
    """Q2: keys present more than once (case_id, geography_id, facility_id)."""
    return _duplicates(b.case(), "case", "case_id").unionByName(_dimension_duplicates(b))


def _dimension_duplicates(b: Bindings) -> DataFrame:
    return _duplicates(b.geography(), "geography", "geography_id").unionByName(_duplicates(b.facility(), "facility", "facility_id"))


def null_rates(b: Bindings) -> DataFrame:
    """Q1: null count and rate of every column of the four tables, one aggregate per table, unpivoted."""
    spec = {"geography": b.geography(), "facility": b.facility(), "climate": b.climate(), "case": b.case()}
    parts = []
    for table, df in spec.items():
        cols = df.columns
        agg = df.agg(F.count(F.lit(1)).alias("n_rows"),
                     *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
        long = agg.unpivot(["n_rows"], cols, "column_name", "n_null")
        parts.append(long.select(F.lit(table).alias("table_name"), "column_name", "n_rows", "n_null",
                                 (F.col("n_null") / F.col("n_rows")).alias("null_rate")))
    return reduce(DataFrame.unionByName, parts)


def orphans(b: Bindings, include_cases: bool = True) -> DataFrame:
    """Foreign keys without a parent row (left anti joins)."""
    geo = b.geography_b().select("geography_id")
    fac = b.facility()
    f_orph = fac.join(geo, "geography_id", "left_anti")
    cl_orph = b.climate().join(geo, "geography_id", "left_anti")
    out = (_viol(f_orph, "facility", "orphan_geography", F.col("facility_id"), "geography_id", None,
                 F.col("geography_id"))
           .unionByName(_viol(cl_orph, "climate", "orphan_geography", climate_key(), "geography_id", None,
                              F.col("geography_id"))))
    if include_cases:
        c_orph = b.case().join(fac.select("facility_id"), "facility_id", "left_anti")
        out = out.unionByName(_viol(c_orph, "case", "orphan_facility", F.col("case_id"), "facility_id", None,
                                    F.col("facility_id")))
    return out


def dimension_violations(b: Bindings) -> DataFrame:
    """Violation rows of every rule on climate, facility and geography; each table is read once for its row rules."""
    parts = [climate_violations(b), facility_violations(b), geography_violations(b), _dimension_duplicates(b),
             orphans(b, include_cases=False)]
    return reduce(DataFrame.unionByName, parts)


def count_rules(df: DataFrame, table: str, key: str, rules: list[Rule]) -> DataFrame:
    """table_name, rule, n_violations, n_records of the rules that `df` breaks and of keys present more than once
    (`duplicate_key`), without a row for each violation: one aggregate counts them by key, a second one over the keys."""
    by_rule: dict[str, Column] = {}
    for r in rules:
        hit = F.count(F.when(r.cond, 1))
        by_rule[r.rule] = by_rule[r.rule] + hit if r.rule in by_rule else hit
    # more than one row is one violation of the key
    by_rule["duplicate_key"] = F.when(F.count(F.lit(1)) > 1, 1).otherwise(0)
    names = list(by_rule)
    keys = df.groupBy(key).agg(*[c.alias(f"_n{i}") for i, c in enumerate(by_rule.values())])
    totals = keys.agg(*[x for i in range(len(names)) for x in (
        F.sum(f"_n{i}").alias(f"_v{i}"), F.count(F.when((F.col(f"_n{i}") > 0) & F.col(key).isNotNull(), 1)).alias(f"_r{i}"))])
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_v{i}").alias("n_violations"), F.col(f"_r{i}").alias("n_records"))
                              for i, n in enumerate(names)]))
    return totals.select(F.lit(table).alias("table_name"), rows).filter("n_violations > 0")


def report(b: Bindings) -> DataFrame:
    """Q22: violation rows per (table, rule). Those of the cases are counted, not made."""
    frame, rules = _case_pass(b, with_orphans=True)
    others = dimension_violations(b).groupBy("table_name", "rule").agg(
        F.count(F.lit(1)).alias("n_violations"), F.countDistinct("record_key").alias("n_records"))
    return count_rules(frame, "case", "case_id", rules).unionByName(others)


def clean_cases(b: Bindings) -> DataFrame:
    """Q23: rows failing any row rule removed, then the first good row per case id.
    A bad copy never hides a good one."""
    bad = reduce(lambda a, c: a | c, case_row_flags(b.case()).values())
    return first_per_key(b.case().filter(~bad), ["case_id"], CASE_ORDER)


CASE_ORDER = ["report_date", "facility_id", "disease"]


def quarantined_cases(b: Bindings, clean: DataFrame | None = None) -> DataFrame:
    """Q23 complement: rows failing a row rule, with the rules they fail, and the good
    rows that are not the first of their case id, as `duplicate_key`.

    They are all cases without the `clean` ones (those of `clean_cases`, or as they were written): counts of equal
    rows, combined map-side, so the cases are read once and a case id with very many copies is neither sorted nor
    joined in one task.
    """
    cases = b.case()
    held = cases.exceptAll((clean_cases(b) if clean is None else clean).select(*cases.columns))
    failed = F.concat_ws(",", *[F.when(c, F.lit(k)) for k, c in case_row_flags(held).items()])
    return held.withColumn("reasons", F.when(failed == "", F.lit("duplicate_key")).otherwise(failed))


def facilities_with_climate(b: Bindings) -> DataFrame:
    """Facilities whose geography reported climate (left semi join)."""
    return b.facility().join(b.climate().select("geography_id"), "geography_id", "left_semi")
