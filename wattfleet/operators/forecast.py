"""Recursive 24-hour forecasts of every series at once.

One row per series carries the last 168 log readings and the 24 coming temperatures. The
24 steps run inside that row: as column expressions for a linear scorer, or as numpy over
Arrow batches of series for a tree model. Nothing is shuffled after the row is built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from wattfleet.functions import scalars
from wattfleet.functions.scalars import hours
from wattfleet.schema import MODEL_FEATURES, READING, SERIES_KEYS, TARGET_LOG, YEAR_MONTH, column_type, require_columns
from wattfleet.session import materialize
from wattfleet.sources import slices

HISTORY_HOURS = 168
HORIZON = 24

# parameters of the built-in linear scorer: a blend of recent, daily and weekly level
BLEND = {
    "intercept": 0.1, "lag_1hr": 0.25, "lag_24hr": 0.2, "lag_168hr": 0.15, "rolling_mean_6hr": 0.1,
    "rolling_mean_24hr": 0.15, "rolling_mean_168hr": 0.1, "rolling_std_24hr": 0.05, "hour_sin": 0.02,
    "is_business_hours": 0.03, "air_temperature": 0.0005, "temp_x_weekend": -0.0002,
}


def default_cutoffs(df: DataFrame, back_hours: int = HORIZON) -> DataFrame:
    """Per series: its last hour minus ``back_hours``."""
    return df.groupBy(*SERIES_KEYS).agg((F.max("timestamp") - hours(back_hours)).alias("cutoff"))


def cutoffs_at(df: DataFrame, cutoff) -> DataFrame:
    """The same cutoff for every series."""
    return df.select(*SERIES_KEYS).distinct().withColumn("cutoff", F.lit(str(cutoff)).cast("timestamp_ntz"))


def _log_target(df: DataFrame) -> Column:
    if TARGET_LOG in df.columns:
        return F.col(TARGET_LOG)
    require_columns(df.columns, [READING], "history")
    return F.log1p(READING)


def history_buffers(history: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Per series with a cutoff: the 168 hours up to it, and why they do not serve (``reason``).

    Rows are first reduced per hour, before they meet the cutoffs, so a series with repeated rows
    grows neither the join nor the buffer. Of a stored table only the months of the windows are read.
    """
    area = F.col("square_feet").cast("double") if "square_feet" in history.columns else F.lit(None).cast("double")
    known = [c for c in (YEAR_MONTH,) if c in history.columns]
    past = history.select(*SERIES_KEYS, "timestamp", _log_target(history).alias("y"), area.alias("area"), *known)
    per_hour = lambda rows: rows.groupBy(*SERIES_KEYS, "timestamp", *known).agg(
        F.count(F.lit(1)).alias("n"), F.max("y").alias("y"), F.max("area").alias("area"))
    rows = slices.around(per_hour(past), cutoffs, "cutoff", hours(-HISTORY_HOURS), hours(0)).where(
        F.col("timestamp") > F.col("cutoff") - hours(HISTORY_HOURS))
    apart = F.unix_micros(F.col("cutoff").cast("timestamp")) - F.unix_micros(F.col("timestamp").cast("timestamp"))
    aligned = apart % 3_600_000_000 == 0
    per_series = rows.groupBy(*SERIES_KEYS, "cutoff").agg(
        F.sum("n").alias("rows"), F.count_if(aligned).alias("hours"), F.count("y").alias("values"),
        # at most 168 aligned hours survive the filter above
        F.array_sort(F.collect_list(F.when(aligned, F.struct("timestamp", "y")))).alias("past"),
        F.max_by("area", F.when(F.col("area").isNotNull(), F.col("timestamp"))).alias("area"),
    )
    full = HISTORY_HOURS
    return cutoffs.join(per_series, [*SERIES_KEYS, "cutoff"], "left").select(
        *SERIES_KEYS, "cutoff", F.coalesce("rows", F.lit(0)).alias("history_rows"),
        F.coalesce("hours", F.lit(0)).alias("history_hours"),
        F.transform("past", lambda p: p["y"]).alias("buf"), "area",
        F.when(F.coalesce("rows", F.lit(0)) < full, F.lit("fewer than 168 readings"))
        .when((F.col("rows") != full) | (F.col("hours") != full), F.lit("readings are not hourly"))
        .when(F.col("values") != full, F.lit("readings are missing")).alias("reason"),
    )


def forecast_eligibility(history: DataFrame, cutoffs: DataFrame | None = None) -> DataFrame:
    """Per series: whether its history supports a forecast, and the reason if not."""
    cutoffs = default_cutoffs(history) if cutoffs is None else cutoffs
    return history_buffers(history, cutoffs).select(
        *SERIES_KEYS, "cutoff", "history_rows", "history_hours",
        F.col("reason").isNull().alias("eligible"), F.coalesce("reason", F.lit("")).alias("reason"))


def observed_weather(df: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Temperatures of the 24 hours after each cutoff, from the table's own rows."""
    known = [c for c in (YEAR_MONTH,) if c in df.columns]
    ahead = (F.unix_micros(F.col("timestamp").cast("timestamp"))
             - F.unix_micros(F.col("cutoff").cast("timestamp"))) / 3600e6
    hourly = df.groupBy(*SERIES_KEYS, "timestamp", *known).agg(F.min("air_temperature").alias("air_temperature"))
    return (
        slices.around(hourly, cutoffs, "cutoff", hours(0), hours(HORIZON))
        .select(*SERIES_KEYS, ahead.alias("step"), "air_temperature")
        .where((F.col("step") > 0) & (F.col("step") <= HORIZON))
    )


def weather_from_list(cutoffs: DataFrame, values) -> DataFrame:
    """The same given temperatures, at least 24, for every series."""
    temps = [float(v) for v in values][:HORIZON]
    if len(temps) < HORIZON:
        raise ValueError(f"24 temperatures are needed, got {len(temps)}")
    if not all(np.isfinite(temps)):
        raise ValueError("temperatures must be numbers")
    table = F.array(*[F.struct(F.lit(i + 1.0).alias("step"), F.lit(t).alias("air_temperature"))
                      for i, t in enumerate(temps)])
    return cutoffs.select(*SERIES_KEYS, F.explode(table).alias("w")).select(*SERIES_KEYS, "w.*")


def weather_from_table(cutoffs: DataFrame, weather: DataFrame, buildings: DataFrame | None = None) -> DataFrame:
    """Temperatures given as a table, taken as they come: the n-th row after a series' cutoff is its n-th hour.

    ``weather`` has ``timestamp``, ``air_temperature`` and the keys it holds for: ``building_id``, both series keys, or
    ``site_id``, which needs ``buildings``. Rows of one time count once, the lowest temperature of them; gaps
    are not filled, so later rows move up. A missing or NaN temperature among the 24 rejects the series, and so do fewer than 24 rows
    (``forecast_inputs`` states which). Rows up to the cutoff are not read. Series of one place and cutoff share one look-up.
    """
    require_columns(weather.columns, ["timestamp", "air_temperature"], "weather table")
    keys = [c for c in (*SERIES_KEYS, "site_id") if c in weather.columns]
    places = cutoffs
    if "site_id" in keys:
        if buildings is None:
            raise ValueError("weather by site needs the buildings")
        places = cutoffs.join(buildings.select("building_id", "site_id"), "building_id")
    if not keys:
        raise ValueError("the weather table names no building, meter or site")
    temp = F.col("air_temperature").cast("double")
    given = weather.groupBy(*keys, "timestamp").agg(F.min(F.when(~F.isnan(temp), temp)).alias("air_temperature"))
    in_order = Window.partitionBy(*keys, "cutoff").orderBy("timestamp")
    first = (
        places.select(*keys, "cutoff").distinct().join(given, keys).where(F.col("timestamp") > F.col("cutoff"))
        .withColumn("step", F.row_number().over(in_order)).where(F.col("step") <= HORIZON))
    return places.join(first, [*keys, "cutoff"]).select(*SERIES_KEYS, F.col("step").cast("double").alias("step"), "air_temperature")


def forecast_inputs(
    history: DataFrame, cutoffs: DataFrame, weather: DataFrame, source: str, buildings: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(ready, rejects): series rows with buffer and temperatures, and the series that lack them."""
    step = F.col("step").cast("double")
    hourly = (
        weather.where((step >= 1) & (step <= HORIZON) & (step == F.floor(step)))
        .groupBy(*SERIES_KEYS, step.alias("step")).agg(F.min("air_temperature").alias("air_temperature")))
    temps = hourly.groupBy(*SERIES_KEYS).agg(       # at most 24 rows each
        F.count(F.lit(1)).alias("steps"), F.count("air_temperature").alias("known"),
        F.array_sort(F.collect_list(F.struct("step", "air_temperature"))).alias("w"))
    rows = history_buffers(history, cutoffs).join(temps, SERIES_KEYS, "left")
    if buildings is not None:
        rows = rows.join(buildings.select("building_id", F.col("square_feet").cast("double").alias("__area")),
                         "building_id", "left").withColumn("area", F.coalesce("area", "__area")).drop("__area")
    rows = rows.withColumn("reason", F.coalesce(
        "reason",
        F.when(F.coalesce("steps", F.lit(0)) < HORIZON, F.lit("weather does not cover the horizon"))
        .when(F.col("known") < HORIZON, F.lit("weather is missing"))))
    ready = rows.where("reason IS NULL").select(
        *SERIES_KEYS, "cutoff", "buf", F.transform("w", lambda x: x["air_temperature"]).alias("temps"), "area",
        F.lit(source).alias("weather_source"))
    return ready, rows.where("reason IS NOT NULL").select(*SERIES_KEYS, "cutoff", "reason")


_RESULT = ["timestamp", "step", "predicted_kwh", "predicted_log", "building_id", "meter", "weather_source"]


def result_schema() -> T.StructType:
    plain = {"step": T.LongType(), "predicted_kwh": T.DoubleType(), "predicted_log": T.DoubleType(),
             "weather_source": T.StringType()}
    fields = [T.StructField(c, plain.get(c) or column_type(c)) for c in _RESULT]
    double = {"air_temperature", "square_feet"}
    return T.StructType(fields + [
        T.StructField(c, T.DoubleType() if c in double else column_type(c)) for c in MODEL_FEATURES])


# ---- linear scorer: column expressions only ----------------------------------

def _mean(values: Column, n: int) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / float(n)


def roll_linear(ready: DataFrame, weights: Mapping[str, float] = BLEND, closing_hour_open: bool = True) -> DataFrame:
    """24 recursive steps of a linear scorer over each row, in one narrow stage.

    Within 24 steps the daily and weekly lags still point into the history, so the state that
    moves is only the last 24 values and the sum of the last 168.
    """
    unknown = set(weights) - set(MODEL_FEATURES) - {"intercept"}
    if unknown:
        raise ValueError(f"weights name unknown features {sorted(unknown)}")
    schema = result_schema()
    types = {f.name: f.dataType for f in schema}
    let = lambda value, body: F.transform(F.array(value), body)[0]

    def features(state: Column, h: Column) -> Column:
        ts = F.col("cutoff") + hours(h)
        temp = F.element_at("temps", h)
        day = state["day"]

        def with_stats(s: Column) -> Column:
            spread = F.aggregate(day, F.lit(0.0), lambda a, x: a + (x - s["m24"]) * (x - s["m24"]))
            cal = scalars.calendar(ts, closing_hour_open)
            cols = {
                **cal,
                "lag_1hr": F.element_at(day, -1), "lag_24hr": F.element_at(day, 1),
                "lag_168hr": F.element_at("buf", h),
                "rolling_mean_6hr": s["m6"], "rolling_mean_24hr": s["m24"],
                "rolling_std_24hr": F.sqrt(spread / 23.0), "rolling_mean_168hr": state["week"] / float(HISTORY_HOURS),
                "temp_x_hour": temp * cal["hour"], "temp_x_weekend": temp * cal["is_weekend"],
                "occupancy_proxy": cal["is_business_hours"] * s["m6"],
                "air_temperature": temp, "square_feet": F.coalesce("area", F.lit(10000.0)),
            }
            return F.struct(ts.alias("timestamp"), *[cols[c].cast(types[c]).alias(c) for c in MODEL_FEATURES])

        stats = F.struct(_mean(F.slice(day, -6, 6), 6).alias("m6"), _mean(day, 24).alias("m24"))
        return let(stats, with_stats)

    def predict(f: Column) -> Column:
        total = F.lit(float(weights.get("intercept", 0.0)))
        for name in MODEL_FEATURES:
            if weights.get(name):
                total = total + f[name] * float(weights[name])
        return total

    def step(state: Column, h: Column) -> Column:
        scored = lambda f: F.struct(h.cast("long").alias("step"), predict(f).alias("predicted_log"), f.alias("f"))
        return let(let(features(state, h), scored), lambda r: F.struct(
            F.concat(F.slice(state["day"], 2, 23), F.array(r["predicted_log"])).alias("day"),
            (state["week"] + r["predicted_log"] - F.element_at("buf", h)).alias("week"),
            F.concat(state["rows"], F.array(r)).alias("rows")))

    feature_ddl = ",".join(["timestamp:timestamp_ntz"] + [f"{c}:{types[c].simpleString()}" for c in MODEL_FEATURES])
    empty = F.array().cast(f"array<struct<step:bigint,predicted_log:double,f:struct<{feature_ddl}>>>")
    week = F.aggregate("buf", F.lit(0.0), lambda a, x: a + x)
    start = F.struct(F.slice("buf", -24, 24).alias("day"), week.alias("week"), empty.alias("rows"))
    rows = F.aggregate(F.sequence(F.lit(1), F.lit(HORIZON)), start, step, lambda s: s["rows"])
    return _flatten(ready.select(*SERIES_KEYS, "weather_source", F.explode(rows).alias("r")).select(
        *SERIES_KEYS, "weather_source", "r.step", "r.predicted_log", "r.f.*"))


def _flatten(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("predicted_kwh", F.greatest(F.expm1("predicted_log"), F.lit(0.0)))
    return out.select(*_RESULT, *MODEL_FEATURES)


# ---- tree scorer: numpy over Arrow batches ------------------------------------

def _step_features(buf: np.ndarray, ts: pd.Series, temp: np.ndarray, area: np.ndarray, closing_hour_open: bool) -> np.ndarray:
    """The 22 features of one step for all series of a batch, in contract order."""
    hour, day, month = ts.dt.hour.to_numpy(), ts.dt.dayofweek.to_numpy(), ts.dt.month.to_numpy()
    weekend = (day >= 5).astype(float)
    open_hours = ((weekend == 0) & (hour >= 8) & (hour <= (18 if closing_hour_open else 17))).astype(float)
    mean6 = buf[:, -6:].mean(axis=1)
    turn = 2 * np.pi
    return np.column_stack([
        hour, day, month, ts.dt.dayofyear.to_numpy(), weekend, open_hours,
        np.sin(turn * hour / 24), np.cos(turn * hour / 24), np.sin(turn * month / 12), np.cos(turn * month / 12),
        buf[:, -1], buf[:, -24], buf[:, -168],
        mean6, buf[:, -24:].mean(axis=1), buf[:, -24:].std(axis=1, ddof=1), buf[:, -168:].mean(axis=1),
        temp * hour, temp * weekend, open_hours * mean6, temp, area,
    ])


def roll_model(ready: DataFrame, score: Callable[[np.ndarray], np.ndarray], closing_hour_open: bool = True) -> DataFrame:
    """24 recursive steps of any numpy scorer; all series of a batch advance together."""
    schema = result_schema()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            buf = np.stack(pdf["buf"].to_numpy()).astype(float)
            temps = np.stack(pdf["temps"].to_numpy()).astype(float)
            area = pdf["area"].fillna(10000.0).to_numpy(dtype=float)
            for h in range(1, HORIZON + 1):
                ts = pdf["cutoff"] + pd.Timedelta(hours=h)
                x = _step_features(buf, ts, temps[:, h - 1], area, closing_hour_open)
                log = score(x)
                buf = np.column_stack([buf[:, 1:], log])
                out = pd.DataFrame(x, columns=MODEL_FEATURES)
                for c in ("hour", "dayofweek", "month", "dayofyear", "is_weekend", "is_business_hours"):
                    out[c] = out[c].astype("int64")
                out["timestamp"], out["step"] = ts.to_numpy(), h
                out["predicted_log"], out["predicted_kwh"] = log, np.maximum(np.expm1(log), 0.0)
                for c in (*SERIES_KEYS, "weather_source"):
                    out[c] = pdf[c].to_numpy()
                yield out[schema.names]

    return ready.mapInPandas(run, schema)


def forecast_24h(
    history: DataFrame,
    cutoffs: DataFrame | None = None,
    weather: DataFrame | None = None,
    scorer: Mapping[str, float] | Callable[[np.ndarray], np.ndarray] = BLEND,
    buildings: DataFrame | None = None,
    closing_hour_open: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(forecast rows, rejects) of every series.

    Without cutoffs each series is forecast over its own last 24 hours. Without weather the
    temperatures observed in ``history`` after the cutoff are used. Readings after the cutoff
    are never read. The cutoffs, one short row per series, are written once: four parts of the
    plan use them, and each would scan the table's keys again.
    """
    cutoffs = materialize(default_cutoffs(history) if cutoffs is None else cutoffs, "cutoffs")
    source = "dataset_observed" if weather is None else "provided"
    weather = observed_weather(history, cutoffs) if weather is None else weather
    ready, rejects = forecast_inputs(history, cutoffs, weather, source, buildings)
    roll = roll_model if callable(scorer) else roll_linear
    return roll(ready, scorer, closing_hour_open), rejects


def forecast_band(rows: DataFrame, predicted: str = "predicted_kwh", width: float = 0.15) -> DataFrame:
    """An illustrative band of ±15 % around a prediction."""
    return rows.withColumns({"lower": F.col(predicted) * (1 - width), "upper": F.col(predicted) * (1 + width)})


def evaluate(rows: DataFrame, actual_log: str = TARGET_LOG, predicted_log: str = "predicted_log") -> DataFrame:
    """RMSE on the log scale, MAPE in kWh (percent) and 100 − MAPE."""
    tiny = float(np.finfo(float).eps)
    y, p = F.expm1(actual_log), F.expm1(predicted_log)
    out = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(F.pow(F.col(actual_log) - F.col(predicted_log), 2))).alias("rmse_log"),
        (F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(tiny))) * 100).alias("mape"))
    return out.withColumn("accuracy_proxy", 100 - F.col("mape"))


def linear_log(weights: Mapping[str, float] = BLEND) -> Column:
    """One-step prediction of the linear scorer from feature columns."""
    total = F.lit(float(weights.get("intercept", 0.0)))
    for name in MODEL_FEATURES:
        if weights.get(name):
            total = total + F.col(name) * float(weights[name])
    return total
