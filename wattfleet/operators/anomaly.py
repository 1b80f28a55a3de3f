"""Residual anomalies: actual against expected energy, severity, type and reason.

Missing values stay missing: a row without an actual or expected value keeps NULL severity
and type. Streaks are counted per series; filter the report window first, a streak then
starts with the window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattfleet.functions.scalars import kwh_from_log, non_negative
from wattfleet.functions.series import running_last
from wattfleet.schema import ANOMALY_FEATURES, MODEL_FEATURES, READING, SERIES_KEYS, TARGET_LOG

# fixed values
EPSILON = 0.001
WARNING_RATIO = 0.25
CRITICAL_RATIO = 0.50
SPIKE_RATIO = 0.35
PERSISTENT_STREAK = 3
PERSISTENT_MEAN_FACTOR = 1.25
CAUSALITY_NOTE = "A deviation from the expected level is statistical evidence, not proof of a cause."
FOREST_SCOPE_NOTE = "The forest signal is auxiliary and only calibrated for the scope it was fitted on."

TYPE_RANK = {"NORMAL": 1, "LOW_DEMAND": 2, "RAPID_SPIKE": 3, "PERSISTENT_HIGH": 4, "HIGH_DEMAND": 5}


def _column(df: DataFrame, given: str | Column | None) -> Column | None:
    if given is None or isinstance(given, Column):
        return given
    if given not in df.columns:
        raise ValueError(f"no column {given!r}")
    return F.col(given)


def resolve_actual(df: DataFrame, actual: str | Column | None = None) -> Column:
    """The observed energy: the argument, or the first column that holds it; never negative."""
    found = _column(df, actual)
    if found is None:
        named = [c for c in ("actual", "actual_kwh", READING) if c in df.columns]
        if named:
            found = F.col(named[0])
        elif TARGET_LOG in df.columns:
            found = kwh_from_log(F.col(TARGET_LOG))
        else:
            raise ValueError("no actual energy: give a column, or actual, actual_kwh, meter_reading or its log")
    return non_negative(found.cast("double"))


def resolve_expected(
    df: DataFrame, actual: Column, expected: str | Column | None = None, model: Column | None = None,
    frame: Sequence[str] | None = None,
) -> Column:
    """The expected energy; ``model`` is a prediction column, used for rows with all features.

    With ``frame``, the columns that tell report frames apart, a frame takes the model only if none of its rows lacks a
    feature, and else the six-hour mean throughout.
    """
    found = _column(df, expected)
    if found is None:
        named = [c for c in ("expected", "expected_kwh", "predicted", "predicted_kwh") if c in df.columns]
        if named:
            found = F.col(named[0])
        else:
            found = actual
            if "rolling_mean_6hr" in df.columns:
                mean6 = F.col("rolling_mean_6hr")
                found = F.when(mean6 > 0, kwh_from_log(mean6)).otherwise(actual)
            if model is not None and set(MODEL_FEATURES) <= set(df.columns):
                complete = ~F.greatest(*[F.col(c).isNull() for c in MODEL_FEATURES])
                if frame is not None:
                    complete = F.every(complete).over(Window.partitionBy(*frame))
                found = F.when(complete, model).otherwise(found)
    return non_negative(found.cast("double"))


def score_residual(df: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Residual, ratios, severity, flag and direction from actual_kwh and expected_kwh."""
    out = df.withColumn("residual", F.col("actual_kwh") - F.col("expected_kwh"))
    base = F.when(F.col("expected_kwh").isNotNull(), F.greatest("expected_kwh", F.lit(epsilon)))
    out = out.withColumn("deviation_ratio", F.try_divide("residual", base))
    out = out.withColumn("abs_deviation_ratio", F.abs("deviation_ratio"))
    size = F.col("abs_deviation_ratio")
    out = out.withColumn(
        "severity",
        F.when(size > CRITICAL_RATIO, F.lit("CRITICAL")).when(size > WARNING_RATIO, F.lit("WARNING"))
        .when(size.isNotNull(), F.lit("NORMAL")))
    flagged = F.col("severity") != "NORMAL"
    return out.withColumns({
        "is_anomaly": F.coalesce(flagged, F.lit(False)).cast("long"),
        "anomaly_direction": F.when(flagged & (F.col("residual") > 0), F.lit("HIGH_DEMAND"))
        .when(flagged, F.lit("LOW_DEMAND")).otherwise(F.lit("NOMINAL")),
    })


def add_residual(
    df, expected=None, actual=None, epsilon: float = EPSILON, model: Column | None = None, frame: Sequence[str] | None = None,
) -> DataFrame:
    """Resolve both sides and score the difference."""
    act = resolve_actual(df, actual)
    exp = resolve_expected(df, act, expected, model, frame)
    return score_residual(df.withColumns({"actual_kwh": act, "expected_kwh": exp}), epsilon)


def add_streak(df: DataFrame, split: bool | None = None) -> DataFrame:
    """Length of the run of positive anomalies that ends at each row of its series."""
    hit = (F.col("is_anomaly") == 1) & (F.col("residual") > 0)
    broken = lambda pos: {"__broken": F.when(~F.coalesce(hit, F.lit(False)), pos)}
    out = running_last(df, broken, SERIES_KEYS, ["timestamp"], split, position="__at")
    return out.withColumn(
        "streak_hours", F.col("__at") - F.coalesce("__broken", F.lit(-1))).drop("__broken", "__at")


def classify(df: DataFrame, mean6: Column | None, mean24: Column | None, epsilon: float = EPSILON) -> DataFrame:
    """Type, rank and reason of scored rows; needs ``streak_hours``. Means are in kWh."""
    missing = F.lit(None).cast("double")
    mean6, mean24 = (missing if m is None else m for m in (mean6, mean24))
    ratio, act, exp = F.col("deviation_ratio"), F.col("actual_kwh"), F.col("expected_kwh")
    surge = F.try_divide(act - mean6, F.greatest(mean6, F.lit(epsilon)))
    spike = (mean6 > 0) & (surge > SPIKE_RATIO) & (ratio > SPIKE_RATIO)
    long_run = F.col("streak_hours") >= PERSISTENT_STREAK
    high_day = (mean24 > 0) & (mean24 > PERSISTENT_MEAN_FACTOR * exp) & (ratio > WARNING_RATIO)
    pct = lambda c: F.format_string("%.1f%%", c * 100.0)
    kwh = lambda c: F.format_string("%.1f kWh", c)
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    branches = [
        (F.col("severity") == "NORMAL", "NORMAL",
         text("Within the normal range, deviation ", pct(ratio), ".")),
        (F.col("residual") < 0, "LOW_DEMAND",
         text("Demand of ", kwh(act), " is ", pct(F.abs(ratio)), " below the expected ", kwh(exp), ".")),
        (spike, "RAPID_SPIKE",
         text("Demand jumped to ", kwh(act), ", ", pct(surge), " over the six-hour mean of ", kwh(mean6),
              " and ", pct(ratio), " over the expected level.")),
        (long_run, "PERSISTENT_HIGH",
         text("Demand stayed high for ", F.col("streak_hours").cast("string"), " readings in a row (", kwh(act),
              " against ", kwh(exp), " expected).")),
        (high_day, "PERSISTENT_HIGH",
         text("The day mean of ", kwh(mean24), " is high against the expected ", kwh(exp),
              F.coalesce(text(" by ", pct(F.try_divide(mean24 - exp, exp))), F.lit("")),
              "; demand is now ", pct(ratio), " over it.")),
        (F.col("severity").isNotNull(), "HIGH_DEMAND",
         text("Demand of ", kwh(act), " exceeds the expected ", kwh(exp), " by ", pct(ratio), ".")),
    ]
    kind, reason = F, F
    for cond, name, why in branches:
        kind = kind.when(cond, F.lit(name))
        reason = reason.when(cond, why)
    out = df.withColumns({"anomaly_type": kind, "classification_reason": reason})
    rank = F
    for name, place in TYPE_RANK.items():
        rank = rank.when(F.col("anomaly_type") == name, F.lit(place))
    return out.withColumn("priority_rank", rank.cast("long"))


def analyze(
    df: DataFrame, expected=None, actual=None, epsilon: float = EPSILON, model: Column | None = None,
    split: bool | None = None, frame: Sequence[str] | None = None,
) -> DataFrame:
    """All residual columns, the streak, and the type with its reason."""
    scored = add_streak(add_residual(df, expected, actual, epsilon, model, frame), split)
    mean = lambda c: kwh_from_log(F.col(c)) if c in df.columns else None
    return classify(scored, mean("rolling_mean_6hr"), mean("rolling_mean_24hr"), epsilon)


def analyze_points(points: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Single observations: actual_kwh and expected_kwh, optionally the two means in kWh and a streak (1 by default)."""
    have = set(points.columns)
    out = points.withColumns({c: non_negative(F.col(c)) for c in ("actual_kwh", "expected_kwh")})
    if "streak_hours" not in have:
        out = out.withColumn("streak_hours", F.lit(1).cast("long"))
    mean = lambda c: F.col(c) if c in have else None
    return classify(score_residual(out, epsilon), mean("rolling_mean_6hr_kwh"), mean("rolling_mean_24hr_kwh"), epsilon)


def detect(
    df: DataFrame, expected=None, forest_score: Callable[[DataFrame], DataFrame] | None = None,
    model: Column | None = None, split: bool | None = None, frame: Sequence[str] | None = None,
) -> DataFrame:
    """``analyze`` plus the forest signal, or its neutral values without a forest or its features."""
    out = analyze(df, expected, model=model, split=split, frame=frame)
    if forest_score is not None and set(ANOMALY_FEATURES) <= set(df.columns):
        out = forest_score(out)
    else:
        out = out.withColumns({
            "isoforest_anomaly": F.lit(0).cast("long"), "isoforest_score": F.lit(0.0),
            "anomaly_score": F.lit(1).cast("long")})
    return out.withColumn("isoforest_warning", F.lit(FOREST_SCOPE_NOTE))


def count_map(values: Column, names: list[str]) -> Column:
    """Counts of the listed names as a map; names that do not occur have no entry."""
    entries = F.array(*[F.struct(F.lit(n).alias("k"), F.count_if(values == n).alias("n")) for n in names])
    return F.map_from_entries(F.filter(entries, lambda e: e["n"] > 0))


def anomaly_counts(scored: DataFrame, keys=SERIES_KEYS) -> DataFrame:
    """Per series: rows, flags, counts by severity and by type, forest flags."""
    forest = F.sum("isoforest_anomaly") if "isoforest_anomaly" in scored.columns else F.lit(0)
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.sum("is_anomaly").alias("anomaly_count"),
        count_map(F.col("severity"), ["NORMAL", "WARNING", "CRITICAL"]).alias("counts_by_severity"),
        count_map(F.col("anomaly_type"), list(TYPE_RANK)).alias("counts_by_type"),
        forest.alias("forest_count"),
    )
