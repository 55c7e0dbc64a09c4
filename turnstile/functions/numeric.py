"""Numeric helpers: coercion, flags, units, log target, chart axis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model thresholds (raw units) and unit conversions.
HEAVY_RAIN_MM = 10.0
HIGH_TEMP_C = 30.0
MM_PER_INCH = 25.4
# Chart axis: about five steps, never finer than 1000, rounded half-even to thousands.
AXIS_MIN_STEP = 1000
AXIS_STEPS = 5
X_TICKS = 5


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c) -> Column:
    """Text -> double, bad text -> null (``try_cast``)."""
    return _col(c).try_cast("double")


def flag_above(c, threshold: float) -> Column:
    """1 when strictly above ``threshold``; null and equal -> 0."""
    return F.coalesce((_col(c) > F.lit(threshold)).cast("int"), F.lit(0))


def heavy_rain(precip_mm) -> Column:
    return flag_above(precip_mm, HEAVY_RAIN_MM)


def high_temp(temp_c) -> Column:
    return flag_above(temp_c, HIGH_TEMP_C)


def fahrenheit_to_celsius(c) -> Column:
    return (_col(c) - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0)


def inches_to_mm(c) -> Column:
    return _col(c) * F.lit(MM_PER_INCH)


def log_target(c) -> Column:
    return F.log1p(_col(c))


def from_log_target(c) -> Column:
    return F.expm1(_col(c))


def ceil_count(c) -> Column:
    """Predicted count on the original scale, rounded up."""
    return F.ceil(F.expm1(_col(c)))


def axis_step(max_value) -> Column:
    """max(1000, round-half-even(max / 5, -3)); 1000 when max <= 0."""
    m = _col(max_value)
    return F.when(m <= 0, F.lit(float(AXIS_MIN_STEP))).otherwise(
        F.greatest(F.lit(float(AXIS_MIN_STEP)), F.bround(m / F.lit(AXIS_STEPS), -3)))


def axis_ticks(max_value, step) -> Column:
    """Array 0, step, 2*step, ... below max + step (``arange(0, max + step, step)``)."""
    m, s = _col(max_value).cast("double"), _col(step).cast("double")
    n = F.ceil((m + s) / s).cast("int")
    ticks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("double") * s)
    return F.when(n > 0, ticks).otherwise(F.array().cast("array<double>"))


def x_tick_every(n_rows) -> Column:
    """Every n-th point of a series carries an x tick: max(1, n // 5)."""
    return F.greatest(F.lit(1), F.floor(_col(n_rows) / F.lit(X_TICKS)).cast("int"))
