"""Exact quantiles: the builtin and the narrowing way against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_text
from wattfleet.functions.quantiles import exact_quantile, median_of, medians_row
from wattfleet.operators import cleaning, features, summaries


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    pdf = pd.concat([
        pd.DataFrame({"g": "normal", "v": rng.normal(0, 50, 997)}),
        pd.DataFrame({"g": "hot", "v": np.where(rng.random(2000) < 0.6, 5.0, rng.uniform(0, 1e6, 2000))}),
        pd.DataFrame({"g": "tiny", "v": [3.5, -1.25]}),
        pd.DataFrame({"g": "one", "v": [42.0]}),
        pd.DataFrame({"g": "close", "v": 100 + rng.integers(0, 50, 400) * 1e-13}),
    ])
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("prob", [0.0, 0.05, 0.5, 0.75, 0.999, 1.0])
@pytest.mark.parametrize("refine", [False, True])
def test_groups(values, prob, refine):
    pdf, df = values
    got = {r["g"]: r["q"] for r in exact_quantile(df, ["g"], "v", prob, "q", refine).collect()}
    assert set(got) == set(pdf["g"])
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(np.quantile(part["v"], prob), rel=1e-12, abs=1e-12)


def test_overall(values):
    pdf, df = values
    got = exact_quantile(df, [], "v", 0.5, "q", True).collect()
    assert len(got) == 1 and got[0]["q"] == pytest.approx(pdf["v"].median())
    assert df.limit(1).select(median_of(df, "v", True).alias("m")).first()["m"] == pytest.approx(pdf["v"].median())


def test_medians_row_and_missing_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (9.0, None)], "a double, b double")
    for refine in (False, True):
        row = medians_row(df, ["a", "b"], refine).first()
        assert row["a"] == 2.0 and row["b"] is None


def test_outlier_cut(spark):
    rows = [(0, float(i)) for i in range(1, 1001)] + [(1, 5.0), (1, 5.0), (0, -3.0), (0, 0.0), (None, 7.0)]
    df = spark.createDataFrame(rows, "meter long, meter_reading double")
    kept = cleaning.filter_outliers(df)
    assert kept.where("meter = 0").count() == 999 and kept.where("meter = 1").count() == 2
    assert kept.where("meter IS NULL OR meter_reading <= 0").count() == 0
    assert cleaning.filter_outliers(df.drop("meter"), quantile_cutoff=0.5).count() == 502


def test_patterns_agree(series):
    _, df = series
    a = {(r[0], r[1]): r[2] for r in summaries.median_patterns(df, meter=None, refine=False).collect()}
    b = {(r[0], r[1]): r[2] for r in summaries.median_patterns(df, meter=None, refine=True).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_nan_and_infinities_both_ways(spark):
    values = [1.0, 2.5, float("nan"), 3.3, None, 7.7, float("inf"), 0.1, float("-inf")]
    df = spark.createDataFrame([(g, v) for g in (1, 2) for v in values], "g int, v double")
    for prob in (0.0, 0.3, 0.5, 0.999 / 2, 0.7):
        plain, narrowed = (
            sorted(map(tuple, exact_quantile(df, ["g"], "v", prob, "q", refine=r).collect())) for r in (False, True))
        assert plain == narrowed
    assert exact_quantile(df, ["g"], "v", 0.5, "q").first()["q"] == 2.5


def test_many_values_never_meet_in_one_map(spark, tmp_path):
    """Scores that hardly repeat outgrow the map of one task long before their file is large."""
    spark.range(2_500_000).select((F.col("id") % 4).alias("meter"), (1 + F.rand(1)).alias("meter_reading")).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    whole, limits = exact_quantile(rows, [], "meter_reading", 0.05, "cut"), cleaning.reading_limits(rows)
    assert "percentile" not in plan_text(whole) + plan_text(limits)
    pdf = rows.toPandas()
    assert whole.first()["cut"] == pytest.approx(np.quantile(pdf["meter_reading"], 0.05), rel=1e-12)
    want = pdf.groupby("meter")["meter_reading"].quantile(0.999).to_dict()
    assert {r["meter"]: r["limit"] for r in limits.collect()} == pytest.approx(want)


def test_a_median_counted_by_hours_is_bounded_by_the_weather(spark, tmp_path):
    spark.range(2_500_000).select(
        F.col("id").alias("building_id"), (F.lit("2024-01-01").cast("timestamp_ntz")).alias("timestamp"), F.rand(1).alias("r")).write.parquet(f"{tmp_path}/t")
    weather = spark.createDataFrame([(0, "2024-01-01", 3.0)], "site_id long, t string, air_temperature double").withColumn("timestamp", F.col("t").cast("timestamp_ntz"))
    weather.write.parquet(f"{tmp_path}/w")
    buildings = spark.range(2_500_000).select(F.col("id").alias("building_id"), F.lit(0).cast("long").alias("site_id"))
    middle = features.joined_median(spark.read.parquet(f"{tmp_path}/t"), buildings, spark.read.parquet(f"{tmp_path}/w"))
    plan = spark.range(1).select(middle.alias("m"))
    assert "percentile" in plan_text(plan) and plan.first()["m"] == 3.0
