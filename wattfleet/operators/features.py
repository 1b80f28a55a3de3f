"""Model features: calendar, lags, rolling statistics, interactions.

Lags and rolling frames count rows of a series, not hours; a gap shifts them. All of them
share one exchange and one sort. Inputs should hold one row per series and hour
(``cleaning.deduplicate``); ties in time are otherwise broken by the reading.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from wattfleet.functions import scalars
from wattfleet.functions.quantiles import median_of, one_map_is_too_small
from wattfleet.functions.sampling import hash_sample
from wattfleet.functions.series import sliding_means, trailing
from wattfleet.schema import ALL_COLUMNS, READING, SERIES_KEYS, TARGET_LOG
from wattfleet.session import input_bytes, materialize

NO_STATISTICS = 1 << 62      # bytes that Spark states for rows of unknown size
MODEL_TABLE_REQUIRED = ["lag_1hr", "lag_24hr", "rolling_mean_6hr"]


def calendar_features(df: DataFrame, closing_hour_open: bool = False) -> DataFrame:
    return df.withColumns(scalars.calendar(F.col("timestamp"), closing_hour_open))


def _keys(df: DataFrame, keys: Sequence[str] | None) -> list[str]:
    return list(keys) if keys else [k for k in SERIES_KEYS if k in df.columns]


def _order(df: DataFrame, target: str) -> list[str]:
    return ["timestamp", target]


def _lags(w: WindowSpec, target: str) -> dict[str, Column]:
    return {f"lag_{n}hr": F.lag(target, n).over(w) for n in (1, 24, 168)}


def _rolling(w: WindowSpec, target: str) -> list[dict[str, Column]]:
    """Means as differences of running sums; the deviation, which these would not give exactly, over its own 24 rows."""
    sums, means = sliding_means(w, F.col(target), {f"rolling_mean_{n}hr": n for n in (6, 24, 168)})
    spread = F.coalesce(F.stddev_samp(F.col(target)).over(w.rowsBetween(-24, -1)), F.lit(0.0))
    return [{**sums, "__p_spread": spread}, {**means, "rolling_std_24hr": F.col("__p_spread")}]


def _backfill_week_lag(df: DataFrame) -> DataFrame:
    return df.withColumn("lag_168hr", F.coalesce("lag_168hr", "rolling_mean_24hr"))


def lag_features(df, target: str = TARGET_LOG, keys=None, split: bool | None = None) -> DataFrame:
    return trailing(df, lambda w: _lags(w, target), _keys(df, keys), _order(df, target), 168, split)


def rolling_features(df, target: str = TARGET_LOG, keys=None, split: bool | None = None) -> DataFrame:
    """Means of the last 6, 24 and 168 earlier rows and the deviation of the last 24."""
    out = trailing(df, lambda w: _rolling(w, target), _keys(df, keys), _order(df, target), 168, split)
    return _backfill_week_lag(out) if "lag_168hr" in out.columns else out


def interaction_features(df: DataFrame, temperature_fill: Column | None = None) -> DataFrame:
    """Temperature and occupancy products.

    A missing temperature counts as the overall median, inside the products only. Pass
    ``temperature_fill`` when the median is known already.
    """
    fill = median_of(df, "air_temperature") if temperature_fill is None else temperature_fill
    temp = F.coalesce(F.col("air_temperature"), fill)
    mean6 = F.col("rolling_mean_6hr") if "rolling_mean_6hr" in df.columns else F.lit(0.0)
    return df.withColumns({
        "temp_x_hour": temp * F.col("hour"),
        "temp_x_weekend": temp * F.col("is_weekend"),
        "occupancy_proxy": F.col("is_business_hours") * mean6,
    })


def joined_median(
    readings: DataFrame, buildings: DataFrame, weather: DataFrame, column: str = "air_temperature", refine: bool | None = None,
) -> Column:
    """The median that a weather column has in the merged table, without merging.

    Each weather row counts as often as readings meet it. These counts, per site and hour, are
    pre-aggregated from two columns of the readings and one of the buildings; only they meet the weather, whose rows bound them.
    """
    met = (readings.select("building_id", "timestamp").join(buildings.select("building_id", "site_id"), "building_id")
           .groupBy("site_id", "timestamp").agg(F.count(F.lit(1)).alias("__met")))
    met = met.join(weather.select("site_id", "timestamp", column), ["site_id", "timestamp"])
    if refine is None:
        if input_bytes(readings) >= NO_STATISTICS:      # rows that are not stored by column: this branch would read all of their columns
            met = materialize(met, "met-hours")
        refine = one_map_is_too_small(weather)
    return median_of(met, column, refine, weight="__met")


def feature_table(
    df: DataFrame, closing_hour_open: bool = False, split: bool | None = None, temperature_fill: Column | None = None,
) -> DataFrame:
    """All engineered columns over the merged table, in one window stage.

    Without ``temperature_fill`` the temperature median is taken from the input, before the windows, so that its pass
    reads one column; where the sources are at hand, ``joined_median`` gives it without a second merge.
    """
    fill = median_of(df, "air_temperature") if temperature_fill is None else temperature_fill
    def windows(w: WindowSpec) -> list[dict[str, Column]]:
        first, second = _rolling(w, TARGET_LOG)
        return [{**_lags(w, TARGET_LOG), **first}, second]

    out = trailing(df, windows, _keys(df, None), _order(df, TARGET_LOG), 168, split)
    out = _backfill_week_lag(calendar_features(out, closing_hour_open))
    out = interaction_features(out, fill)
    known = [c for c in ALL_COLUMNS if c in out.columns]
    return out.select(*known, *[c for c in out.columns if c not in known])


def model_table(features: DataFrame) -> DataFrame:
    """Rows a model can learn from: short lags present, the week lag back-filled."""
    return _backfill_week_lag(features.dropna(subset=MODEL_TABLE_REQUIRED))


def band_baseline(df: DataFrame, reading: str = READING, split: bool | None = None) -> DataFrame:
    """Mean of the last 168 rows including the current one, with a band of half to one and a half."""
    out = trailing(df, lambda w: sliding_means(w, F.col(reading), {"baseline": 168}, current=True),
                   _keys(df, None), _order(df, reading), 168, split)
    return out.withColumns({
        "upper_band": F.col("baseline") * 1.5,
        "lower_band": F.col("baseline") * 0.5,
    }).withColumn("above_band", F.col(reading) > F.col("upper_band"))


def correlation_matrix(df: DataFrame, columns: Sequence[str], sample: int | None = None) -> DataFrame:
    """Pearson correlation of every pair of columns over the complete rows, or a seeded sample of them.

    Two passes, means first: the second then only sums products of deviations, which stays in
    generated code where one ``corr`` per pair does not.
    """
    rows = df.dropna(subset=list(columns))
    rows = hash_sample(rows, sample) if sample else rows
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in columns])
    means = rows.agg(*[F.avg(c).alias(c) for c in columns]).select(F.struct(*columns)).scalar()
    centred = rows.withColumn("__m", means).select(*[(F.col(c) - F.col("__m")[c]).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = centred.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    product = lambda a, b: F.col(f"`{a}|{b}`")

    def cell(a: str, b: str, of: Column) -> Column:
        size = F.sqrt(product(a, a) * product(b, b)) if a != b else product(a, a)
        return F.struct(F.lit(a).alias("row_feature"), F.lit(b).alias("col_feature"),
                        F.try_divide(of, size).alias("corr"))

    cells = [cell(a, b, product(a, b)) for a, b in pairs] + [
        cell(b, a, product(a, b)) for a, b in pairs if a != b]
    return sums.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
