"""Forecast gates, recursion, given weather, and the two ways to roll."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from wattfleet.operators import forecast as fc, summaries
from wattfleet.schema import MODEL_FEATURES


def history(spark, hours=240, drop=(), building=1, start="2024-01-01", **extra):
    ts = pd.date_range(start, periods=hours, freq="h")
    pdf = pd.DataFrame({
        "building_id": building, "meter": 0, "timestamp": ts,
        "meter_reading": 50 + 20 * np.sin(np.arange(hours) * 2 * np.pi / 24) + np.arange(hours) * 0.01,
        "air_temperature": 10 + np.arange(hours) % 7 * 1.0, "square_feet": 1234.0, **extra})
    return rows_of(spark, pdf[~pdf.index.isin(drop)])


def reasons(rejects):
    return {r["building_id"]: r["reason"] for r in rejects.collect()}


def test_gates(spark):
    good = history(spark)
    short = history(spark, hours=74, building=2)
    gap = history(spark, building=3, drop=[100])
    dry = history(spark, building=4).withColumn(
        "air_temperature", F.when(F.col("timestamp") < "2024-01-10 20:00:00", F.col("air_temperature")))
    twice = history(spark, building=5)
    twice = twice.unionByName(twice.where("timestamp = '2024-01-05 00:00:00'"))
    missing = history(spark, building=6).withColumn(
        "meter_reading", F.when(F.col("timestamp") != "2024-01-05 00:00:00", F.col("meter_reading")))
    table = good
    for df in (short, gap, dry, twice, missing):
        table = table.unionByName(df)
    rows, rejects = fc.forecast_24h(table)
    assert {r[0] for r in rows.select("building_id").distinct().collect()} == {1}
    assert rows.count() == 24
    assert reasons(rejects) == {
        2: "fewer than 168 readings", 3: "fewer than 168 readings", 4: "weather is missing",
        5: "readings are not hourly", 6: "readings are missing"}
    ok = {r["building_id"]: r["eligible"] for r in fc.forecast_eligibility(table).collect()}
    assert ok == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}


def test_half_hours(spark):
    half = history(spark, start="2024-01-01 00:30")
    rows, _ = fc.forecast_24h(half)
    assert rows.count() == 24 and {r[0].minute for r in rows.select("timestamp").collect()} == {30}
    mixed = half.unionByName(history(spark))
    rows, rejects = fc.forecast_24h(mixed)
    assert rows.count() == 0 and reasons(rejects) == {1: "readings are not hourly"}


def test_horizon_and_recursion(spark):
    table = history(spark)
    cut = fc.cutoffs_at(table, "2024-01-09 12:00:00")
    rows, _ = fc.forecast_24h(table, cut)
    got = rows.orderBy("step").toPandas()
    assert got["timestamp"].tolist() == list(pd.date_range("2024-01-09 13:00", periods=24, freq="h"))
    assert got["step"].tolist() == list(range(1, 25))
    np.testing.assert_allclose(got["lag_1hr"][1:], got["predicted_log"][:-1])
    past = np.log1p(table.orderBy("timestamp").toPandas()["meter_reading"].to_numpy())
    at = 8 * 24 + 12
    buf = list(past[at - 167: at + 1])
    for i, r in got.iterrows():
        assert r["lag_24hr"] == pytest.approx(buf[-24]) and r["lag_168hr"] == pytest.approx(buf[-168])
        assert r["rolling_mean_6hr"] == pytest.approx(np.mean(buf[-6:]))
        assert r["rolling_std_24hr"] == pytest.approx(np.std(buf[-24:], ddof=1))
        assert r["rolling_mean_168hr"] == pytest.approx(np.mean(buf[-168:]))
        buf.append(r["predicted_log"])
    assert got["is_business_hours"].tolist()[:7] == [1, 1, 1, 1, 1, 1, 0]      # 18:00 still counts here
    assert set(got["square_feet"]) == {1234.0} and set(got["weather_source"]) == {"dataset_observed"}
    np.testing.assert_allclose(got["predicted_kwh"], np.maximum(np.expm1(got["predicted_log"]), 0))


def test_future_readings_are_never_read(spark):
    table = history(spark)
    cut = fc.cutoffs_at(table, "2024-01-09 12:00:00")
    spoiled = table.withColumn("meter_reading", F.when(
        F.col("timestamp") > "2024-01-09 12:00:00", 1e6).otherwise(F.col("meter_reading")))
    a, b = (fc.forecast_24h(t, cut)[0].orderBy("step").toPandas() for t in (table, spoiled))
    pd.testing.assert_frame_equal(a, b)


def test_given_weather(spark):
    table = history(spark)
    cut = fc.default_cutoffs(table, 0)
    temps = [18.5 + i % 5 for i in range(30)]
    rows, rejects = fc.forecast_24h(table, cut, fc.weather_from_list(cut, temps))
    got = rows.orderBy("step").toPandas()
    assert got["air_temperature"].tolist() == temps[:24] and set(got["weather_source"]) == {"provided"}
    assert rejects.count() == 0
    observed, rejects = fc.forecast_24h(table, cut)
    assert observed.count() == 0 and reasons(rejects) == {1: "weather does not cover the horizon"}
    with pytest.raises(ValueError):
        fc.weather_from_list(cut, temps[:23])
    with pytest.raises(ValueError):
        fc.weather_from_list(cut, [float("nan")] * 24)


def test_numpy_and_column_rolls_agree(spark):
    table = history(spark).unionByName(history(spark, building=2, start="2024-01-03"))
    weights = np.array([fc.BLEND.get(c, 0.0) for c in MODEL_FEATURES])
    score = lambda x: x @ weights + fc.BLEND["intercept"]
    order = ["building_id", "step"]
    a = fc.forecast_24h(table)[0].toPandas().sort_values(order, ignore_index=True)
    b = fc.forecast_24h(table, scorer=score)[0].toPandas().sort_values(order, ignore_index=True)
    pd.testing.assert_frame_equal(a, b, atol=1e-9, rtol=1e-9)


def test_area_comes_from_metadata_when_history_has_none(spark):
    table = history(spark).drop("square_feet")
    meta = spark.createDataFrame([(1, 777)], "building_id long, square_feet long")
    assert {r[0] for r in fc.forecast_24h(table, buildings=meta)[0].select("square_feet").collect()} == {777.0}


def test_summary_keeps_the_first_peak(spark):
    pdf = pd.DataFrame({"building_id": 1, "meter": 0, "timestamp": pd.date_range("2024-01-01", periods=4, freq="h"),
                        "predicted_kwh": [1.0, 5.0, 5.0, 1.0]})
    r = summaries.forecast_summary(rows_of(spark, pdf)).first()
    assert r["peak_hour"].hour == 1 and r["low_hour"].hour == 0 and r["total_kwh"] == 12.0


def test_evaluation(spark):
    df = spark.createDataFrame([(np.log1p(100.0).item(), np.log1p(90.0).item()), (0.0, 0.0)], "meter_reading_log double, predicted_log double")
    r = fc.evaluate(df).first()
    assert r["mape"] == pytest.approx(5.0) and r["accuracy_proxy"] == pytest.approx(95.0)
    assert r["rmse_log"] == pytest.approx(np.sqrt((np.log1p(100) - np.log1p(90)) ** 2 / 2))
