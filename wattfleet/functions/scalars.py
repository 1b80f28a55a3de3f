"""Column expressions shared by the jobs."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from wattfleet.schema import METER_NAMES, MONTH_LABELS


def number(value, name: str, minimum: float | None = None) -> float:
    """Check a numeric parameter: finite, and not below ``minimum`` when given."""
    try:
        out = float(value)
    except (TypeError, ValueError):
        raise TypeError(f"{name} must be a number, got {value!r}") from None
    if not math.isfinite(out):
        raise ValueError(f"{name} must be finite, got {value!r}")
    if minimum is not None and out < minimum:
        raise ValueError(f"{name} must be at least {minimum}, got {value!r}")
    return out


def null_if_nan(c: Column) -> Column:
    """Missing is NULL everywhere; Spark would sort NaN above every number."""
    return F.when(~F.isnan(c), c)


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def hours(n) -> Column:
    """A day-time interval of ``n`` hours (an int or an integer column)."""
    return F.make_dt_interval(F.lit(0), F.lit(n) if isinstance(n, int) else n.cast("int"))


def log_reading(c: Column) -> Column:
    return F.log1p(c)


def kwh_from_log(c: Column) -> Column:
    return F.expm1(c)


def non_negative(c: Column) -> Column:
    """Clip at zero and keep NULL (``greatest`` alone would turn NULL into 0)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def percent_of(delta: Column, base: Column) -> Column:
    """delta as a percentage of base; 0 where the base is not positive."""
    return F.when(base > 0, F.try_divide(delta, base) * 100.0).otherwise(F.lit(0.0))


def calendar(ts: Column, closing_hour_open: bool = False) -> dict[str, Column]:
    """The ten calendar features. ``closing_hour_open`` counts 18:00-18:59 as business hours."""
    hour, month = F.hour(ts).cast("long"), F.month(ts).cast("long")
    weekday = F.weekday(ts).cast("long")
    weekend = weekday.isin(5, 6).cast("long")
    last_hour = 18 if closing_hour_open else 17
    turn = lambda x, period: 2 * F.pi() * x / float(period)
    return {
        "hour": hour,
        "dayofweek": weekday,
        "month": month,
        "dayofyear": F.dayofyear(ts).cast("long"),
        "is_weekend": weekend,
        "is_business_hours": ((weekend == 0) & (hour >= 8) & (hour <= last_hour)).cast("long"),
        "hour_sin": F.sin(turn(hour, 24)),
        "hour_cos": F.cos(turn(hour, 24)),
        "month_sin": F.sin(turn(month, 12)),
        "month_cos": F.cos(turn(month, 12)),
    }


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def display_time(ts: Column) -> Column:
    return F.date_format(ts, "dd MMM HH:mm")


def month_label(month: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTH_LABELS)), month.cast("int"))


def meter_name(meter: Column) -> Column:
    """Name of a meter code, ``Meter n`` for an unknown one."""
    named = F.when(F.lit(False), F.lit(""))
    for code, label in METER_NAMES.items():
        named = named.when(meter == code, F.lit(label))
    return named.otherwise(F.concat(F.lit("Meter "), meter.cast("string")))
