"""Domain measures as Column expressions (JVM-side, inside whole-stage codegen).

Nulls follow the reference's pandas behaviour: a null in a comparison
falls through to the `otherwise` branch, a null expected value counts as
no expected cases.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from epilake import fixed as X


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_urban(urban_rural) -> Column:
    """`urban_rural == 'Urban'`; null is rural, as in a pandas comparison."""
    return F.coalesce(_c(urban_rural) == F.lit("Urban"), F.lit(False))


def temperature_avg(tmin, tmax) -> Column:
    return (_c(tmin) + _c(tmax)) / 2


def temp_band(t) -> Column:
    """Closed bands: [25, 30] -> 1.5, [20, 35] -> 1.0, else (and null) 0.5."""
    (lo1, hi1), f1 = X.TEMP_BANDS[0]
    (lo2, hi2), f2 = X.TEMP_BANDS[1]
    t = _c(t)
    return (F.when(t.between(lo1, hi1), F.lit(f1))
            .when(t.between(lo2, hi2), F.lit(f2))
            .otherwise(F.lit(X.TEMP_BAND_DEFAULT)))


def positive_or_zero(e: Column) -> Column:
    """Expected count: non-positive or null gives 0 (no draw in the reference); `e` is evaluated once."""
    return F.greatest(F.lit(0.0), e)


def per_population(pop) -> Column:
    return _c(pop) / F.lit(X.PER_POPULATION)


def malaria_season(month) -> Column:
    return (F.when(_c(month).isin(X.MALARIA_SEASON_MONTHS), F.lit(X.MALARIA_SEASON["in"]))
            .otherwise(F.lit(X.MALARIA_SEASON["out"])))


def malaria_rain_factor(history_days, rain_sum) -> Column:
    """1 + rain/500 when the 21-day history has rows, else 1 (sum skips nulls)."""
    return (F.when(_c(history_days) > 0,
                   F.lit(1.0) + F.coalesce(_c(rain_sum), F.lit(0.0)) / F.lit(X.MALARIA_RAIN_DIVISOR))
            .otherwise(F.lit(1.0)))


def expected_malaria(pop, urban, month, history_days, rain_sum, temp_avg) -> Column:
    base = F.when(_c(urban), F.lit(X.MALARIA_BASE["urban"])).otherwise(F.lit(X.MALARIA_BASE["rural"]))
    e = (per_population(pop) * base * malaria_season(month)
         * malaria_rain_factor(history_days, rain_sum) * temp_band(temp_avg))
    return positive_or_zero(e)


def tb_season(month) -> Column:
    return (F.when(_c(month).isin(X.TB_SEASON_MONTHS), F.lit(X.TB_SEASON["in"]))
            .otherwise(F.lit(X.TB_SEASON["out"])))


def expected_tb(pop, urban, month) -> Column:
    base = F.when(_c(urban), F.lit(X.TB_BASE["urban"])).otherwise(F.lit(X.TB_BASE["rural"]))
    return positive_or_zero(per_population(pop) * base * tb_season(month))


def outbreak_curve(age_days) -> Column:
    """exp(-0.5 * ((age - 18) / 10)^2): 1 at day 18."""
    z = (_c(age_days) - F.lit(X.OUTBREAK_PEAK_DAY)) / F.lit(float(X.OUTBREAK_WIDTH_DAYS))
    return F.exp(F.lit(-0.5) * F.pow(z, 2))


def outbreak_curve_value(age_days: int) -> float:
    """The curve for one integer age, in the C library's arithmetic."""
    z = (age_days - X.OUTBREAK_PEAK_DAY) / float(X.OUTBREAK_WIDTH_DAYS)
    return math.exp(-0.5 * z ** 2)


def expected_cholera(pop, urban, curve, intensity) -> Column:
    """Inside an active outbreak; 0 outside (curve or intensity null). `curve` is
    the outbreak curve at the day's age (a column; see `outbreak_curve_table`)."""
    base = (F.when(_c(urban), F.lit(X.CHOLERA_OUTBREAK_BASE["urban"]))
            .otherwise(F.lit(X.CHOLERA_OUTBREAK_BASE["rural"])))
    e = per_population(pop) * base * _c(curve) * _c(intensity)
    return positive_or_zero(e)


def outbreak_intensity(trigger_rain) -> Column:
    """Trigger-day intensity on the reference's 1.5..3.0 scale, rising with rain above 80 mm
    up to the 200 mm cap (the reference draws it uniformly; here it is an input column)."""
    lo, hi = X.OUTBREAK_INTENSITY_RANGE
    cap = X.RAIN_CAP["rainy"]
    frac = (F.least(_c(trigger_rain), F.lit(float(cap))) - F.lit(float(X.OUTBREAK_TRIGGER_RAIN))) \
        / F.lit(float(cap - X.OUTBREAK_TRIGGER_RAIN))
    return F.lit(lo) + F.lit(hi - lo) * frac


def coastal(region_name) -> Column:
    """Any coastal word in the lower-cased region (so only lower-case words can match)."""
    low = F.lower(_c(region_name))
    cond = F.lit(False)
    for w in X.COASTAL_WORDS:
        cond = cond | low.contains(w)
    return F.coalesce(cond, F.lit(False))


def climate_normal(latitude, region_name, day_of_year) -> Column:
    """30 - |lat|/3 + sin(doy/365 * 2pi) * (coastal ? 5 : 10)."""
    swing = F.when(coastal(region_name), F.lit(float(X.TEMP_SWING["coastal"]))) \
        .otherwise(F.lit(float(X.TEMP_SWING["inland"])))
    base = F.lit(float(X.TEMP_BASE)) - F.abs(_c(latitude)) / F.lit(float(X.TEMP_LAT_DIVISOR))
    seasonal = F.sin(_c(day_of_year) / F.lit(365.0) * F.lit(2.0) * F.lit(math.pi))
    return base + seasonal * swing


def clamp(c, lo, hi) -> Column:
    """Clamp into [lo, hi]; null stays null (least/greatest would skip it)."""
    c = _c(c)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))
