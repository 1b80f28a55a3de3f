"""State rows and the recommendations they trigger."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from wattfleet.operators import advice, impact, state

REF = "2024-05-01 12:00:00"


def refs(spark, *keys):
    df = spark.createDataFrame([(b, m, REF) for b, m in keys or [(1, 0)]], "building_id long, meter long, reference string")
    return df.withColumn("reference", F.col("reference").cast("timestamp_ntz"))


def scored(spark, severity="WARNING", kind="HIGH_DEMAND", hours=(10, 11, 12)):
    pdf = pd.DataFrame({"building_id": 1, "meter": 0, "timestamp": [pd.Timestamp(f"2024-05-01 {h:02d}:00") for h in hours],
                        "actual_kwh": [10.0 * h for h in hours], "expected_kwh": 100.0, "severity": severity,
                        "anomaly_type": kind, "classification_reason": "why"})
    return rows_of(spark, pdf).withColumns({"residual": F.col("actual_kwh") - 100, "deviation_ratio": F.col("actual_kwh") / 100 - 1})


def ramp(spark):
    return rows_of(spark, pd.DataFrame({
        "building_id": 1, "meter": 0, "timestamp": pd.date_range("2024-05-01", periods=24, freq="h"),
        "predicted_kwh": [100.0 + i for i in range(24)], "weather_source": "provided"}))


def build(spark, **parts):
    return state.build_state(refs(spark), **parts)


def test_full_state(spark):
    rows = scored(spark)
    hourly = impact.hourly_impact(ramp(spark))
    r = build(spark, anomaly_rows=state.row_at(rows, refs(spark)), forecast=state.forecast_part(ramp(spark)),
              impact=impact.impact_summary(hourly)).first()
    assert r.asDict().keys() == dict.fromkeys(state.STATE_COLUMNS).keys()
    assert (r["actual_kwh"], r["residual_kwh"], r["state_status"]) == (120.0, 20.0, "WARNING")
    assert (r["forecast_horizon_hours"], r["forecast_peak_kwh"], r["forecast_peak_hour"].hour) == (24, 123.0, 23)
    assert r["forecast_total_cost"] == r["forecast_total_kwh"] * 8 and r["weather_source"] == "provided"


def test_row_falls_back_to_the_last_before_the_reference(spark):
    r = state.row_at(scored(spark, hours=(9, 10, 13)), refs(spark)).first()
    assert r["actual_kwh"] == 100.0


@pytest.mark.parametrize("severity, status", [
    ("NORMAL", "NORMAL"), ("warning", "WARNING"), ("CRITICAL", "CRITICAL"), ("ODD", "UNAVAILABLE"), (None, "UNAVAILABLE")])
def test_status(spark, severity, status):
    df = spark.createDataFrame([(severity,)], "s string")
    assert df.select(state.derive_status(F.col("s"), F.lit(True))).first()[0] == status
    assert df.select(state.derive_status(F.col("s"), F.lit(False))).first()[0] == "UNAVAILABLE"


def test_parts_may_be_missing(spark):
    r = build(spark).first()
    assert r["state_status"] == "UNAVAILABLE" and r["forecast_total_kwh"] is None and r["actual_kwh"] is None
    now = spark.createDataFrame([(1, 0, 50.0, 40.0)], "building_id long, meter long, actual_kwh double, expected_kwh double")
    r = build(spark, current=now, anomaly_rows=state.row_at(scored(spark), refs(spark))).first()
    assert (r["actual_kwh"], r["expected_kwh"], r["residual_kwh"]) == (50.0, 40.0, 20.0)
    r = build(spark, current=now).first()
    assert r["residual_kwh"] == 10.0 and r["state_status"] == "UNAVAILABLE"
    r = build(spark, impact=impact.impact_summary(impact.hourly_impact(ramp(spark)))).first()
    assert r["forecast_total_kwh"] == sum(100.0 + i for i in range(24)) and r["forecast_peak_hour"].hour == 23


def test_faults_and_json(spark):
    good = build(spark, anomaly_rows=state.row_at(scored(spark), refs(spark)))
    bad = (good.withColumn("building_id", F.lit(-1).cast("long")).unionByName(good.withColumn("actual_kwh", F.lit(float("nan"))).withColumn("meter", F.lit(1).cast("long")))
           .unionByName(good.withColumn("state_status", F.lit("FINE")).withColumn("meter", F.lit(2).cast("long")))
           .unionByName(good.withColumn("timestamp", F.lit(None).cast("timestamp_ntz")).withColumn("meter", F.lit(3).cast("long"))))
    faults = {(r["building_id"], r["meter"]): r["fault"] for r in state.state_faults(bad).collect()}
    assert faults == {(-1, 0): "building_id is missing or negative", (1, 1): "actual_kwh is not finite",
                      (1, 2): "state_status is unknown", (1, 3): "timestamp is missing"}
    assert state.valid_states(bad.unionByName(good)).count() == 1 and state.state_faults(good).count() == 0
    text = json.loads(state.state_json(good).first()["state"])
    assert list(text) == [*state.STATE_COLUMNS, "generated_at"]
    assert text["timestamp"] == "2024-05-01T12:00:00" and text["forecast_peak_hour"] is None


def base(spark, **over):
    row = {"building_id": 1, "meter": 0, "actual_kwh": 100.0, "expected_kwh": 100.0, "residual_kwh": 0.0,
           "deviation_ratio": 0.0, "severity": "NORMAL", "anomaly_type": "NORMAL", "state_status": "NORMAL",
           "forecast_total_cost": 100.0, "forecast_total_carbon_kg": 10.0, **over}
    return rows_of(spark, pd.DataFrame([row])).withColumn("timestamp", F.lit(REF).cast("timestamp_ntz"))


def codes(recs):
    return [(r["recommendation_id"], r["priority"], r["category"]) for r in recs.orderBy("rank").collect()]


@pytest.mark.parametrize("over, want", [
    ({}, [("REC-NORM-001", "INFO", "ENERGY")]),
    ({"severity": "CRITICAL", "anomaly_type": "RAPID_SPIKE", "state_status": "CRITICAL"},
     [("REC-CRIT-001", "CRITICAL", "ANOMALY"), ("REC-SPIKE-002", "HIGH", "ANOMALY")]),
    ({"anomaly_type": "HIGH_DEMAND"}, [("REC-ANOM-001", "HIGH", "ANOMALY")]),
    ({"anomaly_type": "PERSISTENT_HIGH"}, [("REC-PERS-001", "HIGH", "OPERATIONS")]),
    ({"anomaly_type": "LOW_DEMAND"}, [("REC-LOW-001", "MEDIUM", "OPERATIONS")]),
    ({"forecast_total_cost": 10000.0, "forecast_total_carbon_kg": 1000.0}, [("REC-NORM-001", "INFO", "ENERGY")]),
    ({"forecast_total_cost": 10000.5, "forecast_total_carbon_kg": 1000.5},
     [("REC-COST-001", "MEDIUM", "COST"), ("REC-CARB-002", "MEDIUM", "CARBON")]),
    ({"severity": None, "anomaly_type": None, "state_status": "UNAVAILABLE"}, []),
])
def test_rules(spark, over, want):
    assert codes(advice.recommendations(base(spark, **over))) == want


def test_scenarios_order_and_lists(spark):
    s = spark.createDataFrame([(1, 0, "ENERGY_REDUCTION", 0.1, -5.0, -40.0)] * 2,
                              "building_id long, meter long, scenario_type string, scenario_value double, delta_total_kwh double, delta_total_cost double")
    states = base(spark, anomaly_type="LOW_DEMAND", severity="CRITICAL", state_status="CRITICAL")
    recs = advice.recommendations(states, s.limit(1))
    assert codes(recs) == [("REC-CRIT-001", "CRITICAL", "ANOMALY"), ("REC-LOW-002", "MEDIUM", "OPERATIONS"), ("REC-SIM-003", "LOW", "ENERGY")]
    lists = advice.recommendation_lists(states, recs).first()
    assert lists["total_count"] == 3 and [r["rank"] for r in lists["recommendations"]] == [1, 2, 3]
    quiet = base(spark, severity=None, anomaly_type=None, state_status="UNAVAILABLE")
    assert advice.recommendation_lists(quiet, advice.recommendations(quiet)).first()["total_count"] == 0
    assert codes(advice.recommendations(base(spark), cost_threshold=50.0))[0][0] == "REC-COST-001"
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            advice.recommendations(states, cost_threshold=bad)
    for word in ("caused", "failure", "fault diagnosed"):
        assert all(word not in (rule[4] + rule[5]) for rule in advice.RULES)


def test_several_scenarios_of_a_series_give_one_list(spark):
    states = spark.createDataFrame(
        [(1, 0, "CRITICAL", "HIGH_DEMAND", "WATCH", 50000.0, 1.0, 9.0, 5.0, 0.8)],
        "building_id int, meter int, severity string, anomaly_type string, state_status string, forecast_total_cost double, "
        "forecast_total_carbon_kg double, actual_kwh double, expected_kwh double, deviation_ratio double",
    ).withColumn("timestamp", F.lit("2024-01-01").cast("timestamp_ntz"))
    runs = spark.createDataFrame(
        [(1, 0, "A", 0.1, -5.0, -1.0), (1, 0, "B", 0.2, -9.0, -2.0), (1, 0, "C", 1.0, 4.0, 3.0)],
        "building_id int, meter int, scenario_type string, scenario_value double, delta_total_kwh double, delta_total_cost double")
    recs = advice.recommendations(states, runs)
    got = recs.orderBy("rank").collect()
    assert [r["code"] for r in got] == ["CRIT", "ANOM", "COST", "SIM"] and "B at 0.2" in got[-1]["evidence"]
    later = states.withColumn("timestamp", F.lit("2024-01-02").cast("timestamp_ntz"))
    two = states.unionByName(later)
    lists = advice.recommendation_lists(two, advice.recommendations(two, runs)).collect()
    assert [r["total_count"] for r in lists] == [4, 4]
