"""The state of every series at a reference time: energy, anomaly, forecast and impact in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattfleet.functions.scalars import iso_text, is_finite
from wattfleet.schema import SERIES_KEYS, STATE_STATUSES

_CURRENT = ["actual_kwh", "expected_kwh", "residual_kwh", "deviation_ratio"]
_ANOMALY = ["severity", "anomaly_type", "classification_reason"]
STATE_COLUMNS = [
    "building_id", "timestamp", "meter", *_CURRENT, *_ANOMALY, "forecast_horizon_hours", "forecast_total_kwh",
    "forecast_peak_kwh", "forecast_peak_hour", "forecast_total_cost", "forecast_total_carbon_kg",
    "weather_source", "state_status",
]
_FLOATS = [*_CURRENT, "forecast_total_kwh", "forecast_peak_kwh", "forecast_total_cost", "forecast_total_carbon_kg"]


def derive_status(severity: Column, has_energy: Column) -> Column:
    """Status from severity; UNAVAILABLE without energy or with an unknown severity."""
    level = F.upper(severity)
    return F.when(has_energy & level.isin("NORMAL", "WARNING", "CRITICAL"), level).otherwise(F.lit("UNAVAILABLE"))


def row_at(scored: DataFrame, references: DataFrame) -> DataFrame:
    """Per series the row at its reference time, or the last one before it. One pre-aggregated pass."""
    carried = [c for c in ("actual_kwh", "expected_kwh", "residual", "deviation_ratio", *_ANOMALY)
               if c in scored.columns]
    return (
        scored.join(references, SERIES_KEYS).where(F.col("timestamp") <= F.col("reference"))
        .groupBy(*SERIES_KEYS).agg(F.max_by(F.struct(*carried), "timestamp").alias("a"))
        .select(*SERIES_KEYS, "a.*").withColumnRenamed("residual", "residual_kwh")
    )


def forecast_figures() -> list[Column]:
    early = -F.unix_micros(F.col("timestamp").cast("timestamp"))
    return [
        F.count(F.lit(1)).alias("forecast_horizon_hours"),
        F.sum("predicted_kwh").alias("forecast_total_kwh"),
        F.max("predicted_kwh").alias("forecast_peak_kwh"),
        F.max_by("timestamp", F.struct(F.col("predicted_kwh"), early)).alias("forecast_peak_hour"),
        F.min_by("weather_source", "timestamp").alias("weather_source"),
    ]


def forecast_part(forecast: DataFrame) -> DataFrame:
    """Horizon, total, first peak and weather source per series."""
    return forecast.groupBy(*SERIES_KEYS).agg(*forecast_figures())


def build_state(
    references: DataFrame, anomaly_rows: DataFrame | None = None, forecast: DataFrame | None = None,
    impact: DataFrame | None = None, current: DataFrame | None = None,
) -> DataFrame:
    """One state row per reference (building_id, meter, reference).

    Each part is one row per series (``row_at``, ``forecast_part`` and ``impact_summary`` rows) and
    may be absent. Given current values win over the anomaly row; impact totals stand in for a
    missing forecast.
    """
    out = references

    def attach(part: DataFrame | None, names: dict[str, str]) -> None:
        nonlocal out
        if part is None:
            out = out.withColumns({alias: F.lit(None) for alias in names.values()})
            return
        have = [F.col(c).alias(alias) if c in part.columns else F.lit(None).alias(alias) for c, alias in names.items()]
        out = out.join(part.select(*SERIES_KEYS, *have), SERIES_KEYS, "left")

    attach(current, {c: f"cur_{c}" for c in _CURRENT})
    attach(anomaly_rows, {c: f"row_{c}" for c in [*_CURRENT, *_ANOMALY]})
    ahead = {c: c for c in ("forecast_horizon_hours", "forecast_total_kwh", "forecast_peak_kwh",
                            "forecast_peak_hour", "weather_source")}
    money = {"total_kwh": "imp_kwh", "total_cost": "forecast_total_cost",
             "total_carbon_kg": "forecast_total_carbon_kg", "peak_cost_hour": "imp_hour"}
    if forecast is impact:          # one table holds both parts
        attach(forecast, {**ahead, **money})
    else:
        attach(forecast, ahead)
        attach(impact, money)
    either = lambda c: F.coalesce(F.col(f"cur_{c}").cast("double"), F.col(f"row_{c}").cast("double"))
    actual, expected = either("actual_kwh"), either("expected_kwh")
    typed = {
        "timestamp": F.col("reference"),
        "actual_kwh": actual, "expected_kwh": expected,
        "residual_kwh": F.coalesce(either("residual_kwh"), actual - expected),
        "deviation_ratio": either("deviation_ratio"),
        **{c: F.col(f"row_{c}").cast("string") for c in _ANOMALY},
        "forecast_horizon_hours": F.col("forecast_horizon_hours").cast("long"),
        "forecast_total_kwh": F.coalesce(F.col("forecast_total_kwh").cast("double"), F.col("imp_kwh").cast("double")),
        "forecast_peak_kwh": F.col("forecast_peak_kwh").cast("double"),
        "forecast_peak_hour": F.coalesce(F.col("forecast_peak_hour").cast("timestamp_ntz"),
                                         F.col("imp_hour").cast("timestamp_ntz")),
        "forecast_total_cost": F.col("forecast_total_cost").cast("double"),
        "forecast_total_carbon_kg": F.col("forecast_total_carbon_kg").cast("double"),
        "weather_source": F.col("weather_source").cast("string"),
        "state_status": derive_status(F.col("row_severity").cast("string"), actual.isNotNull() | expected.isNotNull()),
    }
    return out.select(*[typed[c].alias(c) if c in typed else F.col(c) for c in STATE_COLUMNS])


def state_faults(states: DataFrame) -> DataFrame:
    """States that break an integrity rule, one row per broken rule."""
    rules = [
        ("building_id is missing or negative", F.coalesce(F.col("building_id") < 0, F.lit(True))),
        ("meter is missing or negative", F.coalesce(F.col("meter") < 0, F.lit(True))),
        ("timestamp is missing", F.col("timestamp").isNull()),
        ("state_status is unknown", ~F.coalesce(F.col("state_status").isin(STATE_STATUSES), F.lit(False))),
        *[(f"{c} is not finite", F.coalesce(~is_finite(F.col(c)), F.lit(False))) for c in _FLOATS],
    ]
    found = F.filter(F.array(*[F.when(cond, F.lit(text)) for text, cond in rules]), lambda r: r.isNotNull())
    return states.withColumn("fault", F.explode(found))


def valid_states(states: DataFrame) -> DataFrame:
    """States that keep every rule (ids present, so the keys identify a row)."""
    faulty = state_faults(states).select("building_id", "meter", "timestamp").distinct()
    on = [states[c].eqNullSafe(faulty[c]) for c in ("building_id", "meter", "timestamp")]
    return states.join(faulty, on, "left_anti")


def state_json(states: DataFrame, stamp: bool = True) -> DataFrame:
    """Each state as a JSON text with ISO times; ``stamp`` adds the time of writing."""
    cols = [iso_text(F.col(c)).alias(c) if c in ("timestamp", "forecast_peak_hour") else F.col(c) for c in STATE_COLUMNS]
    if stamp:
        cols.append(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"))
    text = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return states.select("building_id", "meter", text.alias("state"))
