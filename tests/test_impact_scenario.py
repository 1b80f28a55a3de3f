"""Cost, carbon and what-if projections."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from wattfleet.operators import impact, scenario


def forecast(spark, values, start="2016-05-15 13:00", building=1, **extra):
    return rows_of(spark, pd.DataFrame({
        "building_id": building, "meter": 0, "timestamp": pd.date_range(start, periods=len(values), freq="h"),
        "predicted_kwh": values, **extra}))


def ramp(spark):
    return forecast(spark, [100.0 + 2 * i for i in range(24)])


def one(spark, df, kind, value):
    hourly, rejects = scenario.sweep(df, [(kind, value)])
    return hourly.orderBy("timestamp").toPandas(), rejects.collect(), scenario.scenario_summary(hourly).collect()


def test_points(spark):
    df = spark.createDataFrame([(10.0,), (-4.0,)], "energy_kwh double")
    a, b = impact.point_impact(df).collect()
    assert (a["hourly_cost"], a["hourly_carbon_kg"]) == (80.0, 7.0) and b["hourly_cost"] == 0.0
    r = impact.point_impact(spark.createDataFrame([(20.0,)], "energy_kwh double"), 12.5, 0.5).first()
    assert (r["hourly_cost"], r["hourly_carbon_kg"]) == (250.0, 10.0)
    for bad in (-1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            impact.rates(bad, 0.5)
    with pytest.raises(TypeError):
        impact.rates("cheap", 0.5)


def test_summary(spark):
    hourly = impact.hourly_impact(ramp(spark))
    r = impact.impact_summary(hourly).first()
    total = sum(100.0 + 2 * i for i in range(24))
    assert r["total_kwh"] == total and r["total_cost"] == total * 8 and r["total_carbon_kg"] == pytest.approx(total * 0.7)
    assert r["average_hourly_cost"] == total * 8 / 24 and r["peak_cost_hour"].hour == 12
    flat = impact.impact_summary(impact.hourly_impact(forecast(spark, [5.0, 5.0]))).first()
    assert flat["peak_cost_hour"].hour == 13


def test_missing_energy(spark):
    df = forecast(spark, [1.0, 2.0]).withColumn("predicted_kwh", F.when(F.hour("timestamp") == 13, F.col("predicted_kwh")))
    assert impact.impact_rejects(df).count() == 1
    with pytest.raises(Exception, match="predicted_kwh is missing"):
        impact.hourly_impact(df, strict=True).collect()


@pytest.mark.parametrize("kind, value, factor", [
    ("ENERGY_MULTIPLIER", 1.1, 1.1), ("ENERGY_REDUCTION", 0.15, 0.85), ("EFFICIENCY_MULTIPLIER", 0.9, 0.9),
    ("TEMPERATURE_CHANGE", 4.0, 1.1), ("TEMPERATURE_CHANGE", -15.0, 0.625), ("ENERGY_REDUCTION", 0.0, 1.0),
])
def test_factors(spark, kind, value, factor):
    hourly, rejects, (s,) = one(spark, ramp(spark), kind, value)
    assert not rejects
    assert (hourly["simulated_kwh"] / hourly["baseline_kwh"]).tolist() == pytest.approx([factor] * 24)
    assert s["delta_total_percent"] == pytest.approx((factor - 1) * 100, abs=1e-9)
    assert s["delta_total_cost"] == pytest.approx(s["delta_total_kwh"] * 8)
    assert s["simulated_total_carbon_kg"] == pytest.approx(s["simulated_total_kwh"] * 0.7)


def test_occupancy_masks(spark):
    hours = [13, 17, 18, 23]
    values = [100.0] * 24
    by_time, _, _ = one(spark, forecast(spark, values, "2016-05-16 00:00"), "OCCUPANCY_CHANGE", 0.5)      # a Monday
    assert [by_time["simulated_kwh"][h] for h in hours] == pytest.approx([120, 120, 100, 100])
    weekend, _, _ = one(spark, forecast(spark, values, "2016-05-15 00:00"), "OCCUPANCY_CHANGE", 0.5)
    assert set(weekend["simulated_kwh"]) == {100.0}
    proxy, _, _ = one(spark, forecast(spark, [10.0, 10.0], occupancy_proxy=[0.0, 3.0]), "OCCUPANCY_CHANGE", -0.5)
    assert proxy["simulated_kwh"].tolist() == pytest.approx([10.0, 8.0])
    flag, _, _ = one(spark, forecast(spark, [10.0, 10.0], occupancy_proxy=[1.0, 1.0], is_business_hours=[1, 0]), "OCCUPANCY_CHANGE", 1.0)
    assert flag["simulated_kwh"].tolist() == pytest.approx([14.0, 10.0])


def test_addition_zero_base_and_rejects(spark):
    hourly, _, _ = one(spark, forecast(spark, [0.0, 0.0, 10.0, 20.0, 0.0]), "FIXED_KWH_ADDITION", 5.0)
    assert hourly["delta_percent"].tolist() == [0.0, 0.0, 50.0, 25.0, 0.0]
    both = ramp(spark).unionByName(forecast(spark, [500.0, 300.0], building=2))
    hourly, rejects, summary = one(spark, both, "FIXED_KWH_ADDITION", -200.0)
    assert [r["building_id"] for r in rejects] == [1] and set(hourly["building_id"]) == {2} and len(summary) == 1
    assert "below zero" in rejects[0]["reason"]


def test_bad_baselines_are_rejected(spark):
    df = ramp(spark)
    for i, v in enumerate([float("nan"), float("inf"), -1.0, None]):
        df = df.unionByName(forecast(spark, [5.0, 1.0], building=10 + i).withColumn(
            "predicted_kwh", F.when(F.hour("timestamp") == 13, F.lit(v)).otherwise(F.col("predicted_kwh"))))
    hourly, rejects, _ = one(spark, df, "ENERGY_MULTIPLIER", 2.0)
    assert {r["building_id"] for r in rejects} == {10, 11, 12, 13} and set(hourly["building_id"]) == {1}


def test_peak_moves_with_the_scenario(spark):
    values = [50.0] * 24
    values[1] = 250.0
    _, _, (s,) = one(spark, forecast(spark, values), "ENERGY_MULTIPLIER", 1.10)
    assert s["simulated_peak_kwh"] == pytest.approx(275.0)
    assert s["baseline_peak_hour"] == s["simulated_peak_hour"] and s["baseline_peak_hour"].hour == 14
    _, _, (zero,) = one(spark, forecast(spark, [0.0, 0.0]), "ENERGY_MULTIPLIER", 1.5)
    assert zero["delta_total_percent"] == 0.0


@pytest.mark.parametrize("kind, value", [
    ("ENERGY_MULTIPLIER", 0), ("ENERGY_MULTIPLIER", -0.5), ("ENERGY_REDUCTION", -0.1), ("ENERGY_REDUCTION", 1.0),
    ("OCCUPANCY_CHANGE", -0.95), ("OCCUPANCY_CHANGE", 2.1), ("TEMPERATURE_CHANGE", 20), ("EFFICIENCY_MULTIPLIER", 2.5),
    ("EFFICIENCY_MULTIPLIER", 0), ("FIXED_KWH_ADDITION", math.nan), ("FIXED_KWH_ADDITION", math.inf), ("NO_SUCH", 1.0),
])
def test_bounds(kind, value):
    with pytest.raises(ValueError):
        scenario.check_scenario(kind, value)


def test_bounds_accept_edges_and_text_is_refused(spark):
    for kind, value in (("EFFICIENCY_MULTIPLIER", 2.0), ("OCCUPANCY_CHANGE", -0.9), ("TEMPERATURE_CHANGE", 15)):
        assert scenario.check_scenario(kind, value) == (kind, float(value))
    with pytest.raises(TypeError):
        scenario.check_scenario("ENERGY_MULTIPLIER", "lots")
    with pytest.raises(ValueError):
        scenario.sweep(ramp(spark).drop("timestamp"), [("ENERGY_MULTIPLIER", 1.0)])
