"""What-if scenarios projected over forecast tables.

Every forecast row meets every scenario of a short list, held as an array literal in the
plan: no join, no shuffle before the summary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattfleet.functions.scalars import is_finite, number, percent_of
from wattfleet.operators.impact import CARBON, TARIFF, rates
from wattfleet.schema import SERIES_KEYS, require_columns

# fixed values: (lower, upper, lower allowed, upper allowed) of each scenario's magnitude
BOUNDS = {
    "ENERGY_MULTIPLIER": (0.0, float("inf"), False, False),
    "ENERGY_REDUCTION": (0.0, 1.0, True, False),
    "FIXED_KWH_ADDITION": (float("-inf"), float("inf"), False, False),
    "OCCUPANCY_CHANGE": (-0.90, 2.0, True, True),
    "TEMPERATURE_CHANGE": (-15.0, 15.0, True, True),
    "EFFICIENCY_MULTIPLIER": (0.0, 2.0, False, True),
}
OCCUPANCY_SENSITIVITY = 0.40
TEMPERATURE_SENSITIVITY = 0.025
TEMPERATURE_CLIP = (0.1, 3.0)


def check_scenario(kind: str, value) -> tuple[str, float]:
    """Reject unknown scenarios and magnitudes out of bounds."""
    if kind not in BOUNDS:
        raise ValueError(f"unknown scenario {kind!r}, expected one of {sorted(BOUNDS)}")
    v = number(value, kind)
    low, high, low_ok, high_ok = BOUNDS[kind]
    if v < low or v > high or (v == low and not low_ok) or (v == high and not high_ok):
        raise ValueError(f"{kind} does not accept {v}")
    return kind, v


def _occupied(forecast: DataFrame) -> Column:
    if "is_business_hours" in forecast.columns:
        return F.col("is_business_hours").cast("double")
    if "occupancy_proxy" in forecast.columns:
        return (F.col("occupancy_proxy") > 0).cast("double")
    ts = F.col("timestamp")
    return ((F.weekday(ts) < 5) & F.hour(ts).between(8, 17)).cast("double")


def valid_baseline(forecast: DataFrame) -> Column:
    kwh = F.col("predicted_kwh")
    return F.coalesce(is_finite(kwh) & (kwh >= 0), F.lit(False))


def sweep(forecast: DataFrame, scenarios: Sequence[tuple[str, float]], keys=SERIES_KEYS) -> tuple[DataFrame, DataFrame]:
    """(hourly rows, rejected series) of every scenario.

    A series whose baseline holds a missing, infinite or negative value is rejected, and so is
    a fixed addition that drives a series below zero; no other scenario can make a sound baseline negative. Both
    are known per series, before the scenarios are unfolded, from one window over its hours, whose exchange also serves the summary.
    """
    require_columns(forecast.columns, ["timestamp", "predicted_kwh"], "forecast")
    checked = [check_scenario(k, v) for k, v in scenarios]
    table = F.array(*[F.struct(F.lit(k).alias("scenario_type"), F.lit(v).alias("scenario_value")) for k, v in checked])
    base, value = F.col("predicted_kwh"), F.col("scenario_value")
    warm = F.greatest(F.least(1 + value * TEMPERATURE_SENSITIVITY, F.lit(TEMPERATURE_CLIP[1])), F.lit(TEMPERATURE_CLIP[0]))
    kind = F.col("scenario_type")
    simulated = (
        F.when(kind == "ENERGY_REDUCTION", base * (1 - value))
        .when(kind == "FIXED_KWH_ADDITION", base + value)
        .when(kind == "OCCUPANCY_CHANGE", base * (1 + value * OCCUPANCY_SENSITIVITY * _occupied(forecast)))
        .when(kind == "TEMPERATURE_CHANGE", base * warm)
        .otherwise(base * value)
    )
    series = Window.partitionBy(*keys)
    reason = (F.when(~F.col("__valid"), F.lit("baseline is missing, infinite or negative"))
              .when((kind == "FIXED_KWH_ADDITION") & (F.col("__low") + value < 0), F.lit("energy would fall below zero")))
    judged = forecast.withColumns({"__valid": F.every(valid_baseline(forecast)).over(series), "__low": F.min("predicted_kwh").over(series)})
    rows = (
        judged.withColumn("__s", F.explode(table)).select("*", "__s.*").drop("__s")
        .withColumn("simulated_kwh", simulated).withColumn("reason", reason)
    )
    rejects = rows.where("reason IS NOT NULL").select(*keys, "scenario_type", "scenario_value", "reason").distinct()
    delta = F.col("simulated_kwh") - base
    hourly = rows.where("reason IS NULL").select(
        *keys, "scenario_type", "scenario_value", "timestamp", base.alias("baseline_kwh"), "simulated_kwh",
        delta.alias("delta_kwh"), percent_of(delta, base).alias("delta_percent"))
    return hourly, rejects


def scenario_summary(hourly: DataFrame, tariff: float = TARIFF, carbon: float = CARBON, keys=SERIES_KEYS) -> DataFrame:
    """Totals, first peaks, cost and carbon of both sides per series and scenario."""
    t, c = rates(tariff, carbon)
    early = -F.unix_micros(F.col("timestamp").cast("timestamp"))
    sides = [a for side in ("baseline", "simulated") for a in (
        F.sum(f"{side}_kwh").alias(f"{side}_total_kwh"),
        F.max(f"{side}_kwh").alias(f"{side}_peak_kwh"),
        F.max_by("timestamp", F.struct(F.col(f"{side}_kwh"), early)).alias(f"{side}_peak_hour"),
        F.sum(F.col(f"{side}_kwh") * t).alias(f"{side}_total_cost"),
        F.sum(F.col(f"{side}_kwh") * c).alias(f"{side}_total_carbon_kg"),
    )]
    out = hourly.groupBy(*keys, "scenario_type", "scenario_value").agg(*sides)
    diff = lambda m: F.col(f"simulated_{m}") - F.col(f"baseline_{m}")
    out = out.withColumns({f"delta_{m}": diff(m) for m in ("total_kwh", "total_cost", "total_carbon_kg")})
    return out.withColumns({
        "delta_total_percent": percent_of(F.col("delta_total_kwh"), F.col("baseline_total_kwh")),
        "tariff_per_kwh": F.lit(t), "carbon_intensity_kg_per_kwh": F.lit(c)})
