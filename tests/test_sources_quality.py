"""Scans, slices, sinks, metadata and the contract checks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattfleet.operators import cleaning, features, quality
from wattfleet.schema import ALL_COLUMNS, FEATURE_TABLE, MODEL_FEATURES, RAW_READINGS
from wattfleet.session import materialize, scratch_path
from wattfleet.sources import tables
from tests.conftest import plan_text


def test_slice_bounds_are_inclusive_and_ordered(series):
    pdf, df = series
    got = tables.load_slice(df, 1, 0, "2024-01-21", "2024-01-22 05:00:00", ["timestamp", "meter_reading"]).toPandas()
    want = pdf[(pdf.building_id == 1) & (pdf.meter == 0) & (pdf.timestamp >= "2024-01-21")
               & (pdf.timestamp <= "2024-01-22 05:00:00")]
    assert got["timestamp"].tolist() == want["timestamp"].tolist()
    assert tables.load_slice(df, [1, 2], [0], limit=5).count() == 5
    with pytest.raises(ValueError, match="nope"):
        tables.load_slice(df, columns=["nope"])


def test_filters_and_columns_reach_the_scan(spark, series):
    stored = materialize(series[1], "slice-test")
    plan = tables.load_slice(stored, 1, 0, "2024-01-21", columns=["timestamp", "meter_reading"], limit=3)
    text = plan_text(plan)
    assert "TakeOrderedAndProject" in text
    for part in ("EqualTo(building_id,1)", "EqualTo(meter,0)", "GreaterThanOrEqual(timestamp"):
        assert part in text
    assert "meter_reading_log" not in text.split("ReadSchema")[1]


def test_csv_and_parquet(spark, series):
    _, df = series
    rows = df.select("building_id", "meter", "timestamp", "meter_reading")
    csv, parquet = scratch_path(spark, "csv"), scratch_path(spark, "parquet")
    tables.write_csv(rows, csv)
    report = tables.convert_csv_to_parquet(spark, csv, parquet, RAW_READINGS).first()
    assert report["ratio"] == pytest.approx(report["csv_bytes"] / report["parquet_bytes"])
    back = tables.read_parquet(spark, parquet, RAW_READINGS)
    assert back.count() == rows.count() and back.exceptAll(rows).count() == 0
    iso = spark.createDataFrame([("2024-01-01T05:00:00",), ("2024-01-01 06:00:00",)], "timestamp string")
    path = scratch_path(spark, "iso")
    iso.coalesce(1).write.csv(path, header=True)
    from pyspark.sql import types as T
    read = tables.read_csv(spark, path, T.StructType([T.StructField("timestamp", T.TimestampNTZType())]))
    assert [r[0].hour for r in read.orderBy("timestamp").collect()] == [5, 6]


def test_sample_and_partitioned_table(spark, series):
    _, df = series
    path = scratch_path(spark, "sample")
    tables.create_sample(df, path, [2, 77])
    assert {r[0] for r in spark.read.parquet(path).select("building_id").distinct().collect()} == {2}
    path = scratch_path(spark, "table")
    tables.write_feature_table(df, path)
    back = tables.read_feature_table(spark, path, df.schema)
    assert back.exceptAll(df).count() == 0
    assert "PartitionFilters: [isnotnull(meter" in plan_text(back.where("meter = 1"))


def test_timestamps(spark):
    df = spark.createDataFrame([("2024-01-01 01:00:00",), ("junk",)], "t string")
    got = [r[0] for r in tables.parse_timestamps(df, ["t"], strict=False).collect()]
    assert got[0].hour == 1 and got[1] is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE|cannot be"):
        tables.parse_timestamps(df, ["t"]).collect()


def test_nan_becomes_null(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert tables.nan_to_null(df).where("x IS NULL").count() == 1


def test_requests(spark, series):
    want = spark.createDataFrame([(1, 0), (9, 0), (-1, 0), (1, -2)], "building_id long, meter long")
    good, bad = tables.split_requests(want, series[1])
    assert [tuple(r) for r in good.collect()] == [(1, 0)]
    assert {(r["building_id"], r["meter"]): r["reason"] for r in bad.collect()} == {
        (9, 0): "unknown series", (-1, 0): "negative id", (1, -2): "negative id"}


def test_metadata_takes_the_first_row(spark):
    rows = [(1, 0, "2024-01-02", 5, "a"), (1, 0, "2024-01-01", 7, "b"), (2, 0, "2024-01-01", None, "c")]
    df = spark.createDataFrame(rows, "building_id long, meter long, timestamp string, site_id long, primary_use string")
    df = tables.parse_timestamps(df, ["timestamp"]).withColumns({
        "square_feet": F.lit(1), "year_built": F.lit(1.0), "floor_count": F.lit("2")})
    got = {r["building_id"]: (r["site_id"], r["primary_use"]) for r in tables.building_metadata(df).collect()}
    assert got == {1: (7, "b"), 2: (None, "c")}
    assert tables.building_metadata(df, 2, strict=True).count() == 1
    with pytest.raises(Exception, match="no rows of building 9"):
        tables.building_metadata(df, [1, 9], strict=True).collect()


@pytest.fixture(scope="module")
def good_table(spark):
    n = 400
    pdf = pd.DataFrame({"building_id": 1, "meter": 0, "timestamp": pd.date_range("2024-01-01", periods=n, freq="h"),
                        "meter_reading": np.linspace(10, 90, n)})
    from tests.conftest import rows_of
    df = rows_of(spark, pdf).withColumns({
        "site_id": F.lit(1).cast("long"), "primary_use": F.lit("x"), "square_feet": F.lit(10).cast("long"),
        "year_built": F.lit(1990.0), "floor_count": F.lit("2"), "meter_reading_log": F.log1p("meter_reading"),
        **{c: F.lit(1.0) for c in ("air_temperature", "cloud_coverage", "dew_temperature", "precip_depth_1_hr",
                                   "sea_level_pressure", "wind_direction", "wind_speed")}})
    return materialize(features.model_table(features.feature_table(df)), "good")


def checks(df):
    return {r["check"]: (r["passed"], r["metrics"]) for r in quality.validate_all(df).collect()}


def test_contract_passes_on_a_good_table(good_table):
    assert good_table.columns == ALL_COLUMNS
    assert {f.name: f.dataType for f in good_table.schema} == {f.name: f.dataType for f in FEATURE_TABLE}
    results = checks(good_table)
    assert len(results) == 9 and all(p for p, _ in results.values())
    row = quality.validation_summary(quality.validate_all(good_table)).first()
    assert (row["passed"], row["total_checks"], row["passed_checks"]) == (True, 9, 9)


def test_each_fault_is_found(good_table):
    fault = lambda c, v: checks(good_table.withColumn(c, F.when(F.hour("timestamp") == 3, F.lit(v)).otherwise(F.col(c))))
    assert not fault("timestamp", None)["timestamps"][0]
    assert not fault("building_id", -1)["building_ids"][0]
    assert not fault("meter", 9)["meters"][0] and not fault("meter", None)["meters"][0]
    assert not fault("meter_reading", 0.0)["target"][0]
    assert not fault("meter_reading_log", 0.5)["target"][0]
    assert not fault("lag_24hr", None)["model_features"][0]
    assert not fault("lag_24hr", None)["anomaly_features"][0]
    assert not fault("square_feet", None)["missing_values"][0]
    twice = checks(good_table.unionByName(good_table.limit(3)))
    assert twice["unique_timestamps"] == (False, {"duplicate_timestamp_count": "3"})
    gone = checks(good_table.drop("hour", "meter"))
    assert not gone["required_columns"][0] and gone["required_columns"][1]["missing"] == "hour, meter"
    assert not gone["model_features"][0] and not gone["meters"][0] and not gone["unique_timestamps"][0]


def test_deduplicate(spark, series):
    _, df = series
    doubled = df.unionByName(df.withColumn("meter_reading", F.col("meter_reading") + 1))
    out = cleaning.deduplicate(doubled)
    assert out.count() == df.count() and quality.duplicate_surplus(out).first()[0] == 0
    assert quality.duplicate_surplus(doubled).first()[0] == df.count()
    top = out.join(df.withColumnRenamed("meter_reading", "old"), ["building_id", "meter", "timestamp"])
    assert top.where("abs(meter_reading - old - 1) > 1e-9").count() == 0


def test_correlations(good_table):
    cols = ["hour", "meter_reading_log", "rolling_mean_6hr"]
    want = good_table.select(*cols).toPandas().astype(float).corr()
    for r in features.correlation_matrix(good_table, cols).collect():
        assert r["corr"] == pytest.approx(want.loc[r["row_feature"], r["col_feature"]], abs=1e-9)
    assert features.correlation_matrix(good_table, cols, sample=50).count() == 9


def test_calendar(spark):
    rows = [("2024-01-06 17:30:00",), ("2024-01-05 17:00:00",), ("2024-01-05 18:00:00",), ("2024-12-31 08:00:00",)]
    df = tables.parse_timestamps(spark.createDataFrame(rows, "timestamp string"), ["timestamp"])
    got = features.calendar_features(df).orderBy("timestamp").collect()
    late = features.calendar_features(df, closing_hour_open=True).orderBy("timestamp").collect()
    assert [r["dayofweek"] for r in got] == [4, 4, 5, 1] and [r["is_weekend"] for r in got] == [0, 0, 1, 0]
    assert [r["is_business_hours"] for r in got] == [1, 0, 0, 1]
    assert [r["is_business_hours"] for r in late] == [1, 1, 0, 1]
    assert got[3]["dayofyear"] == 366 and got[3]["month"] == 12
    assert got[0]["hour_sin"] == pytest.approx(np.sin(2 * np.pi * 17 / 24))


def test_features_share_one_exchange(good_table):
    plan = plan_text(features.feature_table(good_table.select(*ALL_COLUMNS[:17])))
    main = plan.split("===== Subqueries =====")[0].split("(1)")[0]
    assert main.count("Exchange") == 1


def test_no_leak_from_the_current_row(good_table):
    rows = good_table.select(*ALL_COLUMNS[:17])
    last = rows.agg(F.max("timestamp")).first()[0]
    moved = rows.withColumn("meter_reading_log", F.when(F.col("timestamp") == F.lit(last), 99.0).otherwise(F.col("meter_reading_log")))
    pick = lambda df: features.feature_table(df).where(F.col("timestamp") == F.lit(last)).select(*MODEL_FEATURES).first()
    assert pick(rows) == pick(moved)
