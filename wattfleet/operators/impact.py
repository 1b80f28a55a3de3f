"""Cost and carbon of forecast energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattfleet.functions.scalars import non_negative, number
from wattfleet.schema import SERIES_KEYS

# fixed values: default tariff and grid intensity per kWh
TARIFF = 8.0
CARBON = 0.70


def rates(tariff: float = TARIFF, carbon: float = CARBON) -> tuple[float, float]:
    return number(tariff, "tariff", 0.0), number(carbon, "carbon", 0.0)


def point_impact(points: DataFrame, tariff: float = TARIFF, carbon: float = CARBON, energy: str = "energy_kwh") -> DataFrame:
    """Cost and carbon of single energy values; negative energy counts as zero."""
    t, c = rates(tariff, carbon)
    kwh = non_negative(F.col(energy))
    return points.withColumns({"predicted_kwh": kwh, "hourly_cost": kwh * t, "hourly_carbon_kg": kwh * c})


def hourly_impact(forecast: DataFrame, tariff: float = TARIFF, carbon: float = CARBON, strict: bool = False) -> DataFrame:
    """Forecast rows with cost and carbon, energy taken as it is.

    ``strict`` stops the job on a missing energy value; otherwise ``impact_rejects`` lists them.
    """
    t, c = rates(tariff, carbon)
    kwh = F.col("predicted_kwh")
    if strict:
        kwh = F.when(kwh.isNull() | F.isnan(kwh), F.raise_error(F.lit("predicted_kwh is missing"))).otherwise(kwh)
    return forecast.withColumns({"hourly_cost": kwh * t, "hourly_carbon_kg": kwh * c})


def impact_rejects(forecast: DataFrame) -> DataFrame:
    return forecast.where(F.col("predicted_kwh").isNull() | F.isnan("predicted_kwh"))


def impact_figures() -> list[Column]:
    """Aggregates of ``hourly_impact`` rows: totals, means and the first peak hours."""
    early = -F.unix_micros(F.col("timestamp").cast("timestamp"))
    peak = lambda v: F.max_by("timestamp", F.struct(F.col(v), early))
    return [
        F.sum("predicted_kwh").alias("total_kwh"),
        F.sum("hourly_cost").alias("total_cost"),
        F.sum("hourly_carbon_kg").alias("total_carbon_kg"),
        F.avg("hourly_cost").alias("average_hourly_cost"),
        F.avg("hourly_carbon_kg").alias("average_hourly_carbon_kg"),
        peak("hourly_cost").alias("peak_cost_hour"),
        peak("hourly_carbon_kg").alias("peak_carbon_hour"),
    ]


def impact_summary(hourly: DataFrame, tariff: float = TARIFF, carbon: float = CARBON, keys=SERIES_KEYS) -> DataFrame:
    """Totals, means and first peak hours per series, with the rates used."""
    t, c = rates(tariff, carbon)
    return hourly.groupBy(*keys).agg(*impact_figures()).withColumns(
        {"tariff_per_kwh": F.lit(t), "carbon_intensity_kg_per_kwh": F.lit(c)})
