"""Aggregates of readings and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattfleet.functions.quantiles import exact_quantile
from wattfleet.functions.scalars import meter_name, month_label
from wattfleet.schema import READING, SERIES_KEYS
from wattfleet.sources.tables import building_ids, load_slice, meters

DEFAULT_MONTH = 5       # fixed value: the month a report opens with when it has data


def monthly_summary(df: DataFrame, meter: int = 0, per_year: bool = False) -> DataFrame:
    """Total, mean and peak per month number over all buildings; years merge unless asked for."""
    keys = [F.month("timestamp").alias("month")]
    if per_year:
        keys.insert(0, F.year("timestamp").alias("year"))
    out = df.where(F.col("meter") == int(meter)).groupBy(*keys).agg(
        F.sum(READING).alias("total"), F.avg(READING).alias("avg"), F.max(READING).alias("peak"))
    return out.withColumn("month_name", month_label(F.col("month")))


def buildings_list(df: DataFrame, meter: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(buildings, meters with their names) of the fleet; count the first for the total."""
    return building_ids(df, meter), meters(df).withColumn("name", meter_name(F.col("meter")))


def median_by(df: DataFrame, column: str, meter: int | None = 0, refine: bool | None = None) -> DataFrame:
    """Median reading per value of ``column``, for one meter."""
    rows = df if meter is None else df.where(F.col("meter") == int(meter))
    return exact_quantile(rows, [column], READING, 0.5, "median", refine)


def median_week(df: DataFrame, start, end, meter: int = 0) -> DataFrame:
    """Hourly medians inside a time range, both ends included."""
    return median_by(load_slice(df, start_time=start, end_time=end, ordered=False), "timestamp", meter)


def median_patterns(df: DataFrame, meter: int | None = 0, refine: bool | None = None) -> DataFrame:
    """Medians by hour, by weekday and by month as rows (pattern, bucket, median)."""
    ts = F.col("timestamp")
    rows = df if meter is None else df.where(F.col("meter") == int(meter))
    cell = lambda name, v: F.struct(F.lit(name).alias("pattern"), v.cast("long").alias("bucket"))
    stacked = rows.select(READING, F.explode(F.array(
        cell("hour", F.hour(ts)), cell("dayofweek", F.weekday(ts)), cell("month", F.month(ts)))).alias("p"))
    return exact_quantile(stacked.select(READING, "p.*"), ["pattern", "bucket"], READING, 0.5, "median", refine)


def hourly_pattern(df: DataFrame, refine: bool | None = None) -> DataFrame:
    """Median reading by hour of day for every building."""
    return exact_quantile(df.withColumn("hour", F.hour("timestamp").cast("long")),
                          ["building_id", "hour"], READING, 0.5, "median", refine)


def available_months(df: DataFrame) -> DataFrame:
    """Months with data per building and the one a report opens with."""
    months = F.array_sort(F.collect_set(F.month("timestamp").cast("long")))
    return df.groupBy("building_id").agg(months.alias("months")).withColumn(
        "default_month",
        F.when(F.array_contains("months", F.lit(DEFAULT_MONTH).cast("long")), F.lit(DEFAULT_MONTH).cast("long"))
        .otherwise(F.coalesce(F.array_min("months"), F.lit(1).cast("long"))))


def forecast_summary(forecast: DataFrame, keys=SERIES_KEYS) -> DataFrame:
    """Total, peak and low of each forecast with their first hours.

    A tie goes to the earliest hour: the time is compared in descending order.
    """
    kwh, ts = F.col("predicted_kwh"), F.col("timestamp")
    micros = F.unix_micros(ts.cast("timestamp"))
    return forecast.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("horizon_hours"),
        F.sum(kwh).alias("total_kwh"), F.avg(kwh).alias("average_kwh"),
        F.max(kwh).alias("peak_kwh"), F.max_by(ts, F.struct(kwh, -micros)).alias("peak_hour"),
        F.min(kwh).alias("low_kwh"), F.min_by(ts, F.struct(kwh, micros)).alias("low_hour"),
    )
