"""Fleet reports: the answers of the building views, for all series in one job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from wattfleet.functions.scalars import display_time, hours
from wattfleet.operators import advice, anomaly, forecast, impact, scenario, state, summaries
from wattfleet.operators.impact import CARBON, TARIFF
from wattfleet.schema import MODEL_FEATURES, READING, SERIES_KEYS, TARGET_LOG
from wattfleet.session import materialize
from wattfleet.sources import slices
from wattfleet.sources.tables import latest_timestamps

MAX_LOOKBACK = 1000     # fixed value: longest look-back a report accepts


def references_at_latest(table: DataFrame) -> DataFrame:
    return latest_timestamps(table).withColumnRenamed("latest", "reference")


def references_at(table: DataFrame, time) -> DataFrame:
    return table.select(*SERIES_KEYS).distinct().withColumn("reference", F.lit(str(time)).cast("timestamp_ntz"))


def anomaly_window(
    features: DataFrame, references: DataFrame | None = None, limit: int = 168, start_time=None, end_time=None,
    forest_score: Callable[[DataFrame], DataFrame] | None = None, expected=None,
) -> DataFrame:
    """Scored rows of the report window; the limit shapes the default window and never caps rows."""
    if not 1 <= limit <= MAX_LOOKBACK:
        raise ValueError(f"limit must lie in 1..{MAX_LOOKBACK}")
    if start_time is not None and end_time is not None and pd.Timestamp(start_time) > pd.Timestamp(end_time):
        raise ValueError("start_time lies after end_time")
    if references is None:
        references = references_at_latest(features) if end_time is None else references_at(features, end_time)
    if start_time is None:
        rows = slices.look_back(features, references, limit - 1)
    else:
        at = F.lit(str(start_time)).cast("timestamp_ntz")
        rows = slices.between(features, first=at, last=None if end_time is None else F.lit(str(end_time)).cast("timestamp_ntz"))
        rows = rows.join(references, SERIES_KEYS).where(F.col("timestamp") <= F.col("reference"))
    return anomaly.detect(rows, expected=expected, forest_score=forest_score)


def anomaly_report(features: DataFrame, references: DataFrame | None = None, **window) -> tuple[DataFrame, DataFrame]:
    """(summary per series, flagged rows). A series without rows in its window reports zeros."""
    references = references_at_latest(features) if references is None and window.get("end_time") is None else (
        references if references is not None else references_at(features, window["end_time"]))
    scored = anomaly_window(features, references, **window)
    zero = F.create_map(*[x for s in ("NORMAL", "WARNING", "CRITICAL") for x in (F.lit(s), F.lit(0).cast("long"))])
    counts = references.join(anomaly.anomaly_counts(scored), SERIES_KEYS, "left").withColumns({
        "counts_by_severity": F.coalesce("counts_by_severity", zero),
        "counts_by_type": F.coalesce("counts_by_type", F.map_from_arrays(
            F.array().cast("array<string>"), F.array().cast("array<bigint>"))),
        **{c: F.coalesce(c, F.lit(0)) for c in ("total_records", "anomaly_count", "forest_count")}})
    return counts, scored.where("is_anomaly = 1")


def month_alerts(features: DataFrame, month: int, predicted_log: Column, n: int = 8) -> DataFrame:
    """The first ``n`` alerts of each series in a month, against the model where the month is complete."""
    rows = slices.calendar_month(features, month)
    model = F.greatest(F.expm1(predicted_log), F.lit(0.0))
    return top_anomalies(anomaly.add_residual(rows, model=model, frame=SERIES_KEYS), n)


def top_anomalies(scored: DataFrame, n: int = 8, keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """The first n flagged rows of each series and how many more there are.

    Each task keeps only its own first n rows per series before the shuffle.
    """
    flagged = scored.where("is_anomaly = 1")
    first = (
        flagged.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("timestamp")))
        .where(F.col("place") <= n).withColumn("shown_time", display_time(F.col("timestamp")))
    )
    more = flagged.groupBy(*keys).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more"))
    return first.join(more, list(keys))


def forecast_report(table: DataFrame, references: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Forecasts from 24 hours before each reference, and the series without one."""
    cutoffs = None if references is None else references.select(
        *SERIES_KEYS, (F.col("reference") - hours(24)).alias("cutoff"))
    return forecast.forecast_24h(table, cutoffs, **options)


def impact_report(rows: DataFrame, tariff: float = TARIFF, carbon: float = CARBON) -> DataFrame:
    return impact.impact_summary(impact.hourly_impact(rows, tariff, carbon), tariff, carbon)


def scenario_report(rows: DataFrame, scenarios: Sequence[tuple[str, float]], tariff: float = TARIFF, carbon: float = CARBON) -> DataFrame:
    hourly, _ = scenario.sweep(rows, scenarios)
    return scenario.scenario_summary(hourly, tariff, carbon)


def fleet_state(
    features: DataFrame, references: DataFrame | None = None, forecast_rows: DataFrame | None = None,
    forest_score: Callable[[DataFrame], DataFrame] | None = None, scorer=forecast.BLEND,
    tariff: float = TARIFF, carbon: float = CARBON,
) -> DataFrame:
    """State of every series at its reference: the 24 hours up to it as anomaly window, and as
    forecast horizon. Parts that cannot be computed stay NULL.

    ``forecast_rows`` is a stored forecast of the same references; without it one is computed.
    Forecast and impact figures come from one aggregation of it.
    """
    references = materialize(references_at_latest(features) if references is None else references, "references")
    rows = forecast_report(features, references, scorer=scorer)[0] if forecast_rows is None else forecast_rows
    ahead = impact.hourly_impact(rows, tariff, carbon).groupBy(*SERIES_KEYS).agg(
        *state.forecast_figures(), *impact.impact_figures())
    scored = anomaly.detect(slices.look_back(features, references, 24), forest_score=forest_score).drop("reference")
    return state.build_state(references, state.row_at(scored, references), ahead, ahead)


def recommendation_report(states: DataFrame, scenarios: DataFrame | None = None, **thresholds) -> DataFrame:
    return advice.recommendations(states, scenarios, **thresholds)


def monthly_kpis(features: DataFrame, month: int, predicted_log: Column | None = None, carbon: float = CARBON,
                 meter: int = 0, expect_model: bool = False) -> DataFrame:
    """Month panel per building: last actual and predicted energy, mean, total, anomalies, carbon, delta.

    Energy figures use complete feature rows; anomalies count all rows of the month, against the six-hour mean or,
    with ``expect_model``, against the prediction in months of which every row is complete.
    """
    rows = slices.calendar_month(features, month).where(F.col("meter") == int(meter))
    log = forecast.linear_log() if predicted_log is None else predicted_log
    clean = rows.dropna(subset=MODEL_FEATURES).withColumns({
        "actual": F.expm1(TARGET_LOG), "predicted": F.greatest(F.expm1(log), F.lit(0.0))})
    panel = clean.groupBy("building_id").agg(
        F.max_by("actual", "timestamp").alias("current_kwh"),
        F.max_by("predicted", "timestamp").alias("predicted_kwh"),
        F.avg("actual").alias("average_kwh"), F.sum("actual").alias("total_kwh"))
    model = F.greatest(F.expm1(log), F.lit(0.0)) if expect_model else None
    flags = anomaly.add_residual(rows, model=model, frame=SERIES_KEYS).groupBy("building_id").agg(F.sum("is_anomaly").alias("anomaly_count"))
    delta = F.try_divide(F.col("current_kwh") - F.col("predicted_kwh"), F.col("predicted_kwh")) * 100
    return panel.join(flags, "building_id", "left").withColumns({
        "co2_kg": F.col("total_kwh") * float(carbon), "delta_percent": delta})


def anomaly_overlay(features: DataFrame, month: int, meter: int = 0) -> DataFrame:
    """Flagged rows of a month with the actual energy of the complete row at the same time, if any."""
    rows = slices.calendar_month(features, month).where(F.col("meter") == int(meter))
    clean = rows.dropna(subset=MODEL_FEATURES).select(*SERIES_KEYS, "timestamp", F.expm1(TARGET_LOG).alias("actual"))
    flagged = anomaly.add_residual(rows).where("is_anomaly = 1").select(
        *SERIES_KEYS, "timestamp", F.expm1(TARGET_LOG).alias("marker_kwh"), "severity")
    return flagged.join(clean, [*SERIES_KEYS, "timestamp"], "left")


def explain_targets(features: DataFrame, month: int, at=None, meter: int = 0) -> DataFrame:
    """Per building the complete row to explain: the one at the chosen time, by default the time of the
    first flagged row, else the first complete row; the row of highest energy when nothing is flagged."""
    rows = slices.calendar_month(features, month).where(F.col("meter") == int(meter))
    complete = ~F.greatest(*[F.col(c).isNull() for c in MODEL_FEATURES])
    scored = anomaly.add_residual(rows).withColumn("__whole", complete)
    row = F.struct(*[F.col(c) for c in features.columns])
    if at is not None:
        chosen = F.col("timestamp") == F.lit(str(at)).cast("timestamp_ntz")
    else:
        chosen = F.col("is_anomaly") == 1
    late = F.unix_micros(F.col("timestamp").cast("timestamp"))
    picks = scored.groupBy("building_id").agg(
        F.min_by(F.struct("__whole", row.alias("r")), F.when(chosen, F.col("timestamp"))).alias("hit"),
        F.min_by(row, F.when(F.col("__whole"), F.col("timestamp"))).alias("first"),
        F.max_by(row, F.when(F.col("__whole"), F.struct(F.col(READING), -late))).alias("peak"))
    other = F.when(F.lit(at is not None) | F.col("hit").isNotNull(), F.col("first")).otherwise(F.col("peak"))
    pick = F.when(F.col("hit")["__whole"], F.col("hit")["r"]).otherwise(other)
    return picks.select(pick.alias("r")).where("r IS NOT NULL").select("r.*")
