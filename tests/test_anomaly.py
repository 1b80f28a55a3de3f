"""Residual scoring and classification on hand-built points and frames."""

import math

import pytest
from pyspark.sql import functions as F

from wattfleet.operators import anomaly
from wattfleet.plans import reports
from wattfleet.sources import tables

POINTS = [
    # actual, expected, mean6, mean24, streak -> type, rank
    ((100.0, 100.0, None, None, 1), "NORMAL", 1),
    ((60.0, 100.0, None, None, 1), "LOW_DEMAND", 2),
    ((145.0, 100.0, 100.0, None, 1), "RAPID_SPIKE", 3),
    ((140.0, 100.0, 135.0, None, 3), "PERSISTENT_HIGH", 4),
    ((140.0, 100.0, 135.0, 130.0, 1), "PERSISTENT_HIGH", 4),
    ((130.0, 100.0, 125.0, 110.0, 1), "HIGH_DEMAND", 5),
    ((150.0, 100.0, 100.0, None, 4), "RAPID_SPIKE", 3),
    ((5.0, 0.0, 4.0, 1.0, 1), "PERSISTENT_HIGH", 4),
]


def test_point_types(spark):
    rows = [(i, *p, t, k) for i, (p, t, k) in enumerate(POINTS)]
    df = spark.createDataFrame(rows, "i int, actual_kwh double, expected_kwh double, rolling_mean_6hr_kwh double, "
                                     "rolling_mean_24hr_kwh double, streak_hours long, want string, rank long")
    for r in anomaly.analyze_points(df).collect():
        assert (r["anomaly_type"], r["priority_rank"]) == (r["want"], r["rank"]), r["i"]
        assert r["classification_reason"]


def test_thresholds_are_strict(spark):
    df = spark.createDataFrame([(a, 100.0) for a in (125.0, 125.1, 150.0, 150.1, 75.0, 74.9)], "actual_kwh double, expected_kwh double")
    got = [r["severity"] for r in anomaly.analyze_points(df).collect()]
    assert got == ["NORMAL", "WARNING", "WARNING", "CRITICAL", "NORMAL", "WARNING"]


def test_zero_expected_and_negative_values(spark):
    df = spark.createDataFrame([(0.0, 0.0), (5.0, 0.0), (-3.0, -1.0)], "actual_kwh double, expected_kwh double")
    got = anomaly.analyze_points(df).collect()
    assert [r["severity"] for r in got] == ["NORMAL", "CRITICAL", "NORMAL"]
    assert all(math.isfinite(r["deviation_ratio"]) for r in got)
    assert got[1]["deviation_ratio"] == pytest.approx(5000.0) and got[2]["actual_kwh"] == 0.0


def test_missing_values_stay_missing(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None)], "actual_kwh double, expected_kwh double")
    for r in anomaly.analyze_points(df).collect():
        assert r["severity"] is None and r["anomaly_type"] is None and r["is_anomaly"] == 0


def frame(spark, rows, cols):
    df = spark.createDataFrame([(1, 0, f"2024-01-01 {i:02d}:00:00", *r) for i, r in enumerate(rows)],
                               f"building_id long, meter long, timestamp string, {cols}")
    return tables.parse_timestamps(df, ["timestamp"])


def test_frame_and_streak(spark):
    log = math.log1p(100.0)
    df = frame(spark, [(100.0, 100.0, log), (60.0, 100.0, log), (145.0, 100.0, log), (130.0, 100.0, math.log1p(125.0)),
                       (130.0, 100.0, math.log1p(128.0))], "actual_kwh double, expected_kwh double, rolling_mean_6hr double")
    got = anomaly.analyze(df).orderBy("timestamp").collect()
    assert [r["anomaly_type"] for r in got] == ["NORMAL", "LOW_DEMAND", "RAPID_SPIKE", "HIGH_DEMAND", "PERSISTENT_HIGH"]
    assert [r["streak_hours"] for r in got] == [0, 0, 1, 2, 3]
    assert [r["anomaly_direction"] for r in got] == ["NOMINAL", "LOW_DEMAND", "HIGH_DEMAND", "HIGH_DEMAND", "HIGH_DEMAND"]


def test_expected_falls_back(spark):
    mean6 = math.log1p(50.0)
    df = frame(spark, [(80.0, mean6), (80.0, 0.0), (80.0, None)], "meter_reading double, rolling_mean_6hr double")
    got = anomaly.add_residual(df).orderBy("timestamp").collect()
    assert [round(r["expected_kwh"], 6) for r in got] == [50.0, 80.0, 80.0]
    got = anomaly.add_residual(df, expected=F.lit(40.0)).collect()
    assert {r["residual"] for r in got} == {40.0}
    log_only = df.select("building_id", "meter", "timestamp", F.log1p("meter_reading").alias("meter_reading_log"))
    assert {round(r["actual_kwh"], 6) for r in anomaly.add_residual(log_only).collect()} == {80.0}
    with pytest.raises(ValueError):
        anomaly.add_residual(df.drop("meter_reading"))
    with pytest.raises(ValueError):
        anomaly.add_residual(df, expected="no_such")


def test_detect_without_forest_is_neutral(spark):
    df = frame(spark, [(80.0,)], "meter_reading double")
    r = anomaly.detect(df).first()
    assert (r["isoforest_anomaly"], r["isoforest_score"], r["anomaly_score"]) == (0, 0.0, 1)


def test_report_window_and_top_list(spark):
    df = frame(spark, [(100.0 if i % 3 else 200.0, 100.0) for i in range(24)], "actual_kwh double, expected_kwh double")
    counts, flagged = reports.anomaly_report(df, limit=12)
    r = counts.first()
    assert (r["total_records"], r["anomaly_count"]) == (12, 4)
    assert r["counts_by_severity"] == {"NORMAL": 8, "CRITICAL": 4} and flagged.count() == 4
    empty, _ = reports.anomaly_report(df, end_time="2023-01-01")
    r = empty.first()
    assert r["total_records"] == 0 and r["counts_by_severity"] == {"NORMAL": 0, "WARNING": 0, "CRITICAL": 0}
    assert r["counts_by_type"] == {}
    top = reports.top_anomalies(anomaly.add_residual(df), n=3).orderBy("place").collect()
    assert [t["place"] for t in top] == [1, 2, 3] and top[0]["more"] == 5
    assert [t["timestamp"].hour for t in top] == [0, 3, 6]
    with pytest.raises(ValueError):
        reports.anomaly_window(df, limit=1001)
    with pytest.raises(ValueError):
        reports.anomaly_window(df, start_time="2024-01-02", end_time="2024-01-01")
