"""Cleaning and joining of readings, building metadata and weather."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattfleet.functions.quantiles import exact_quantile, medians_row, one_map_is_too_small
from wattfleet.functions.scalars import log_reading
from wattfleet.functions.series import running_last
from wattfleet.schema import FILLED_WEATHER, READING, SERIES_KEYS, TARGET_LOG
from wattfleet.session import materialize


def fill_weather(weather: DataFrame, split: bool | None = None) -> DataFrame:
    """Fill the four core measures per site forwards, then backwards, then by the overall median.

    The median is that of the already filled column and only reaches sites that never
    reported the measure. The filled rows, sites × hours, are written once, as the medians need them all before
    the first can be completed.
    """
    columns = [c for c in FILLED_WEATHER if c in weather.columns]
    seen = lambda prefix: lambda _: {f"__{prefix}_{c}": F.col(c) for c in columns}
    # two passes in opposite time order: a frame that looks ahead would rescan the rest per row
    ahead = running_last(weather, seen("f"), ["site_id"], ["timestamp"], split)
    both = running_last(ahead, seen("b"), ["site_id"], ["timestamp"], split, descending=True)
    filled = both.select(*[
        F.coalesce(f"__f_{c}", f"__b_{c}").alias(c) if c in columns else F.col(c) for c in weather.columns])
    filled = materialize(filled, "weather")
    middle = medians_row(filled, columns).select(F.struct(*columns)).scalar()
    return (filled.withColumn("__mid", middle)
            .withColumns({c: F.coalesce(F.col(c), F.col("__mid")[c]) for c in columns}).drop("__mid"))


def reading_limits(df: DataFrame, reading_col: str = READING, quantile_cutoff: float = 0.999) -> DataFrame:
    """The upper limit of positive readings per meter, or one overall when there is no meter column."""
    groups = ["meter"] if "meter" in df.columns else []
    limits = exact_quantile(df.where(F.col(reading_col) > 0), groups, reading_col, quantile_cutoff, "limit", one_map_is_too_small(df))
    return limits.withColumn("limit", F.round("limit", 9))


def filter_outliers(df: DataFrame, reading_col: str = READING, quantile_cutoff: float = 0.999) -> DataFrame:
    """Keep positive readings up to the quantile of their meter; rows without a meter drop out."""
    limits = reading_limits(df, reading_col, quantile_cutoff)
    positive = df.where(F.col(reading_col) > 0)
    if "meter" not in df.columns:
        return positive.where(F.col(reading_col) <= limits.scalar())
    # Written, the limits have a known size: Spark broadcasts a few of them, so that the readings are
    # cut in the scan, and joins by meter if there are very many.
    limits = materialize(limits, "limits")
    return positive.join(limits, "meter").where(F.col(reading_col) <= F.col("limit")).select(*df.columns)


def merge_sources(readings: DataFrame, buildings: DataFrame, weather: DataFrame) -> DataFrame:
    """Readings with building attributes, site weather and the log target.

    No join hint: Spark broadcasts a side only when its size is below the threshold, and
    otherwise splits skewed partitions of the left side at run time.
    """
    out = readings.join(buildings, "building_id", "left").join(weather, ["site_id", "timestamp"], "left")
    if READING in out.columns:
        out = out.withColumn(TARGET_LOG, log_reading(F.col(READING)))
    lead = [c for c in readings.columns]
    return out.select(*lead, *[c for c in out.columns if c not in lead])


def deduplicate(df: DataFrame) -> DataFrame:
    """One row per (building_id, meter, timestamp): the highest reading wins."""
    keys = [*SERIES_KEYS, "timestamp"]
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(READING), *[F.col(c) for c in rest if c != READING])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
