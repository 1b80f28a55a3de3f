"""Time slices of stored tables, pruned to the folders that can hold them.

A stored feature table has one folder per meter and month (``year_month``, as 202403). Reports about
one month, and reports that look back from a time of each series' own, read only the folders
they need: the months are worked out from the request, or, per meter, from the reference times in a
scalar subquery that runs before the scan. A meter or series whose last reading is old adds its own month, not all months
since. Tables without the folder column give the same rows by filters alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattfleet.functions.scalars import hours
from wattfleet.schema import SERIES_KEYS, YEAR_MONTH


def year_month(time: Column) -> Column:
    return (F.year(time) * 100 + F.month(time)).cast("int")


def calendar_month(table: DataFrame, month: int) -> DataFrame:
    """Rows of a month number, of all years."""
    rows = table.where(F.month("timestamp") == int(month))
    return rows.where(F.col(YEAR_MONTH) % 100 == int(month)) if YEAR_MONTH in table.columns else rows


def between(table: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Rows from ``first`` to ``last``, both included; either may be absent."""
    folders = YEAR_MONTH in table.columns
    for bound, within in ((first, lambda c, b: c >= b), (last, lambda c, b: c <= b)):
        if bound is not None:
            table = table.where(within(F.col("timestamp"), bound))
            if folders:
                table = table.where(within(F.col(YEAR_MONTH), year_month(bound)))
    return table


def before(table: DataFrame, time: Column) -> DataFrame:
    """Rows before ``time``."""
    return between(table, last=time).where(F.col("timestamp") < time)


def _folders(spans: DataFrame, first: Column, last: Column) -> Column:
    """The (meter, month) pairs that the spans meet, as a scalar subquery: at most one per folder."""
    month = lambda t: F.date_trunc("month", t.cast("timestamp"))
    start, end = month(F.col("__first")), month(F.col("__last"))
    met = (spans.select("meter", first.alias("__first"), last.alias("__last"))
           .groupBy("meter", start.alias("start"), end.alias("end")).agg(F.lit(1))       # few rows before they are unfolded
           .where("start <= end").select("meter", F.explode(F.sequence("start", "end", F.expr("INTERVAL 1 MONTH"))).alias("t")))
    return met.agg(F.collect_set(F.struct(F.col("meter"), year_month(F.col("t")).alias(YEAR_MONTH)))).scalar()


def around(table: DataFrame, references: DataFrame, time: str, back: Column, ahead: Column) -> DataFrame:
    """Rows of [time + back, time + ahead] per series, with the columns of ``references``.

    ``references`` has one row per series; ``back`` and ``ahead`` are intervals, back usually negative.
    """
    at = F.col(time)
    first, last = at + back, at + ahead
    if YEAR_MONTH in table.columns:
        here = F.struct(F.col("meter"), F.col(YEAR_MONTH))
        table = table.where(F.array_contains(_folders(references, first, last), here))
    else:
        bounds = references.agg(F.min(first).alias("a"), F.max(last).alias("b"))
        low, high = bounds.select("a").scalar(), bounds.select("b").scalar()
        table = table.where((F.col("timestamp") >= low) & (F.col("timestamp") <= high))
    return table.join(references, SERIES_KEYS).where((F.col("timestamp") >= first) & (F.col("timestamp") <= last))


def look_back(table: DataFrame, references: DataFrame, back_hours: int, time: str = "reference") -> DataFrame:
    """Rows of [time − back_hours, time] per series."""
    return around(table, references, time, hours(-back_hours), hours(0))
