"""Running-sum means, medians by counts, quantile plans, given weather, frame expectations, and the prefix of boosted trees."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_text, rows_of
from wattfleet.functions.quantiles import exact_quantile
from wattfleet.functions.series import sliding_means, trailing
from wattfleet.operators import anomaly, cleaning, features, forecast as fc, model
from wattfleet.plans import offline
from wattfleet.schema import MODEL_FEATURES, SERIES_KEYS, TARGET_LOG


def long_series(spark, values):
    ts = pd.date_range("2024-01-01", periods=len(values), freq="h")
    return rows_of(spark, pd.DataFrame({"building_id": 1, "meter": 0, "timestamp": ts, "i": range(len(values)), "v": values}))


@pytest.mark.parametrize("split", [False, True])
def test_running_sums_equal_frames(spark, split):
    rng = np.random.default_rng(2)
    values = rng.uniform(-5, 5, 700)
    values[100] = 3e9                                    # a spike leaves no trace once it is out of the frame
    values[300:340] = 60.0
    # NULL values are absent, as in avg
    df = long_series(spark, values).withColumn("v", F.when(F.col("i") % 7 != 3, F.col("v")))
    make = lambda w: sliding_means(w, F.col("v"), {"m6": 6, "m168": 168})
    now = lambda w: sliding_means(w, F.col("v"), {"m168": 168}, current=True)
    got = trailing(df, make, split=split, segment_rows=200).orderBy("i").toPandas()
    here = trailing(df, now, split=split, segment_rows=200).orderBy("i").toPandas()
    assert not [c for c in got.columns if c.startswith("__")]
    kept = [None if i % 7 == 3 else v for i, v in enumerate(values)]

    def mean(part):
        part = [v for v in part if v is not None]
        return math.fsum(part) / len(part) if part else None

    for i in range(len(values)):
        for name, want, of in (("m6", mean(kept[max(0, i - 6):i]), got), ("m168", mean(kept[max(0, i - 168):i]), got), ("m168", mean(kept[max(0, i - 167):i + 1]), here)):
            have = of[name][i]
            assert (want is None and pd.isna(have)) or have == pytest.approx(want, rel=1e-13, abs=1e-11), (i, name)


def test_infinite_values_stay_in_their_frames(spark):
    values = [1.0] * 40
    values[5], values[20], values[21] = math.inf, math.nan, -math.inf
    df = long_series(spark, values).withColumn("v", F.when(F.col("i") == 20, float("nan")).otherwise(F.col("v")))
    got = trailing(df, lambda w: sliding_means(w, F.col("v"), {"m": 3}), split=False).orderBy("i").collect()
    for i, r in enumerate(got):
        part = values[max(0, i - 3):i]
        want = None if not part else math.nan if any(math.isnan(v) or v == -math.inf for v in part) else sum(part) / len(part)
        assert r["m"] == want or (want is not None and math.isnan(want) and math.isnan(r["m"])), i


def sources(spark):
    readings = spark.createDataFrame([(b, m, f"2024-01-01 {h:02d}:00:00", 10.0 + h) for b in (1, 2, 3, 4) for m in range(b % 3 + 1) for h in range(b, 20)],
                                     "building_id long, meter long, timestamp string, meter_reading double")
    readings = readings.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    buildings = spark.createDataFrame([(0, 1), (1, 2), (None, 3), (1, 4)], "site_id long, building_id long").withColumns(
        {c: F.lit(None).cast(t) for c, t in (("primary_use", "string"), ("square_feet", "long"), ("year_built", "double"), ("floor_count", "string"))})
    weather = spark.createDataFrame([(s, f"2024-01-01 {h:02d}:00:00", float((h * 7 + s) % 11)) for s in (0, 1) for h in range(3, 18) if h != 9],
                                    "site_id long, timestamp string, air_temperature double").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return readings, buildings, weather


@pytest.mark.parametrize("refine", [False, True])
def test_median_without_the_merge(spark, refine):
    readings, buildings, weather = sources(spark)
    merged = cleaning.merge_sources(readings, buildings, weather)
    want = np.median([r[0] for r in merged.select("air_temperature").collect() if r[0] is not None])
    assert spark.range(1).select(features.joined_median(readings, buildings, weather, refine=refine)).first()[0] == want
    a, b = offline.build_features(readings, buildings, weather), features.feature_table(offline.merged_table(readings, buildings, weather))
    key = lambda df: sorted(map(str, df.collect()))
    assert a.columns == b.columns and key(a) == key(b)


def test_feature_plan_merges_once(spark):
    """The readings are merged with the weather once; the median's branch reads two of their columns."""
    readings, buildings, weather = sources(spark)
    text = plan_text(offline.build_features(readings, buildings, weather))
    assert text.count("Window") and "percentile" in text
    assert sum("meter_reading" in s for s in text.split("\n\n") if "Scan" in s.strip().split("\n")[0]) <= 1


@pytest.mark.parametrize("prob", [0.0, 0.3, 0.5, 0.999, 1.0])
@pytest.mark.parametrize("refine", [False, True])
def test_weights_count_rows(spark, prob, refine):
    rng = np.random.default_rng(4)
    values, weights = rng.normal(0, 9, 300).round(2), rng.integers(0, 6, 300)
    df = spark.createDataFrame([(int(i % 2), float(v), int(w)) for i, (v, w) in enumerate(zip(values, weights))], "g int, v double, w long")
    got = {r["g"]: r["q"] for r in exact_quantile(df, ["g"], "v", prob, "q", refine, weight="w").collect()}
    for g in (0, 1):
        assert got[g] == pytest.approx(np.quantile(np.repeat(values[g::2], weights[g::2]), prob), rel=1e-12)


def test_quantiles_do_not_shuffle_values(spark, monkeypatch, tmp_path):
    """Exchanges of the narrowing way carry cells; two scans settle a column of cents."""
    from wattfleet.functions import quantiles

    seen = []
    inner = quantiles.materialize
    monkeypatch.setattr(quantiles, "materialize", lambda df, name: seen.append(plan_text(df)) or inner(df, name))
    spark.range(20000).select((F.col("id") % 3).alias("g"), (F.rand(1) * 1000).cast("decimal(9,2)").cast("double").alias("v")).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    got = {r["g"]: r["q"] for r in exact_quantile(rows, ["g"], "v", 0.999, "q", True).collect()}
    pdf = rows.toPandas()
    assert got == {g: pytest.approx(np.quantile(p["v"], 0.999)) for g, p in pdf.groupby("g")}
    assert len(seen) == 2
    for text in seen:
        for node in text.split("\n\n"):
            if "Exchange" in node.strip().split("\n")[0] and "hashpartitioning" in node:
                assert "__v" not in node.split("hashpartitioning(")[1].split(")")[0]


def test_outliers_are_cut_in_one_scan(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 5).alias("meter"), F.col("id").cast("double").alias("meter_reading"), F.lit(1).alias("x"))
    rows.write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    text = plan_text(cleaning.filter_outliers(df, quantile_cutoff=0.9))
    assert sum(f"{tmp_path}/t" in s for s in text.split("\n\n")) == 1 and "BroadcastHashJoin" in text
    kept = cleaning.filter_outliers(df, quantile_cutoff=0.9)
    assert kept.columns == df.columns and all(r["count"] in (899, 900) for r in kept.groupBy("meter").count().collect())


# ---- given weather ---------------------------------------------------------

def history(spark, building):
    ts = pd.date_range("2024-01-01", periods=240, freq="h")
    return rows_of(spark, pd.DataFrame({"building_id": building, "meter": 0, "timestamp": ts, "meter_reading": 50.0 + np.arange(240) % 24, "square_feet": 10.0}))


def temps(spark, key, value, hours, start="2024-01-11", null_at=None):
    ts = pd.date_range(start, periods=hours, freq="h")
    return rows_of(spark, pd.DataFrame({key: value, "timestamp": ts, "air_temperature": [None if i == null_at else float(i) for i in range(hours)]}))


def test_weather_tables(spark):
    table = history(spark, 1)
    for b in (2, 3, 4, 5):
        table = table.unionByName(history(spark, b))
    cut = fc.default_cutoffs(table, 0)
    given = temps(spark, "building_id", 1, 30, start="2024-01-10 20:00")                 # begins before the cutoff
    given = given.unionByName(temps(spark, "building_id", 2, 23)).unionByName(temps(spark, "building_id", 3, 24, null_at=7))
    gappy = temps(spark, "building_id", 4, 40).where("air_temperature NOT IN (3, 4)")     # later rows move up
    twice = gappy.where("air_temperature = 5").withColumn("air_temperature", F.lit(-5.0))  # one time, two values
    rows, rejects = fc.forecast_24h(table, cut, fc.weather_from_table(cut, given.unionByName(gappy).unionByName(twice)))
    got = {b: [r["air_temperature"] for r in rows.where(f"building_id = {b}").orderBy("step").collect()] for b in (1, 4)}
    assert got[1] == [float(i) for i in range(4, 28)]
    assert got[4] == [0.0, 1.0, 2.0, -5.0] + [float(i) for i in range(6, 26)]
    assert {r["weather_source"] for r in rows.collect()} == {"provided"}
    assert {r["building_id"]: r["reason"] for r in rejects.collect()} == {
        2: "weather does not cover the horizon", 3: "weather is missing", 5: "weather does not cover the horizon"}


def test_weather_tables_by_site_and_bad_ones(spark):
    table = history(spark, 1).unionByName(history(spark, 2))
    cut = fc.default_cutoffs(table, 0)
    buildings = spark.createDataFrame([(7, 1), (None, 2)], "site_id long, building_id long")
    by_site = temps(spark, "site_id", 7, 24).withColumn("air_temperature", F.when(F.col("air_temperature") == 2, float("nan")).otherwise(F.col("air_temperature")))
    _, rejects = fc.forecast_24h(table, cut, fc.weather_from_table(cut, by_site, buildings))
    assert {r["building_id"]: r["reason"] for r in rejects.collect()} == {1: "weather is missing", 2: "weather does not cover the horizon"}
    for bad in (lambda: fc.weather_from_table(cut, by_site), lambda: fc.weather_from_table(cut, by_site.drop("site_id")),
                lambda: fc.weather_from_table(cut, by_site.drop("air_temperature"), buildings)):
        with pytest.raises(ValueError):
            bad()


# ---- model expectations -------------------------------------------------------

def test_frames_take_the_model_whole_or_not_at_all(spark):
    rows = [(b, 0, f"2024-01-01 {h:02d}:00:00", 100.0, None if (b, h) == (2, 3) else 1.0) for b in (1, 2) for h in range(5)]
    df = spark.createDataFrame(rows, "building_id long, meter long, timestamp string, meter_reading double, x double")
    df = df.withColumns({**{c: F.lit(1.0) for c in MODEL_FEATURES if c != "lag_1hr"}, "lag_1hr": F.col("x"), "rolling_mean_6hr": F.log1p(F.lit(80.0)),
                         "timestamp": F.col("timestamp").cast("timestamp_ntz")})
    expected = lambda **k: {(r["building_id"], r["timestamp"].hour): round(r["expected_kwh"], 6) for r in anomaly.add_residual(df, model=F.lit(50.0), **k).collect()}
    per_row, per_frame = expected(), expected(frame=SERIES_KEYS)
    assert per_row[2, 3] == 80.0 and per_row[2, 2] == 50.0
    assert {per_frame[1, h] for h in range(5)} == {50.0} and {per_frame[2, h] for h in range(5)} == {80.0}


def test_first_trees_equal_a_shorter_fit(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (400, len(MODEL_FEATURES)))
    df = spark.createDataFrame([(*map(float, r), float(r[0] * 3 + r[1])) for r in x], [*MODEL_FEATURES, TARGET_LOG])
    fit = lambda n: model.train_gbt(df, max_iter=n, max_depth=3, min_rows=5)
    part, short = model.first_trees(fit(6), 4), fit(4)
    assert part.getNumTrees == 4 and part.numFeatures == len(MODEL_FEATURES)
    score = lambda m: [r[0] for r in model.predict(df.limit(50), m).select("predicted_log").collect()]
    np.testing.assert_allclose(score(part), score(short), rtol=1e-12)


# ---- stamps, contract values, draws ------------------------------------------

def test_stamps_are_utc_and_set_apart(spark):
    import json
    import re
    from datetime import datetime, timezone

    from wattfleet.operators import state

    ref = spark.createDataFrame([(1, 0, "2024-05-01 12:00:00")], "building_id long, meter long, reference string").withColumn(
        "reference", F.col("reference").cast("timestamp_ntz"))
    states = state.build_state(ref)
    stamped, plain = (json.loads(state.state_json(states, stamp=s).first()["state"]) for s in (True, False))
    at = stamped.pop("generated_at")
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", at) and stamped == plain
    assert abs((datetime.now(timezone.utc) - datetime.strptime(at, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)).total_seconds()) < 120


def test_contract_values_agree_with_their_copies():
    from oracle import contract
    from wattfleet import schema
    from wattfleet.operators import advice, quality
    from wattfleet.sources import standin

    for name in ("ALL_COLUMNS", "MODEL_FEATURES", "ANOMALY_FEATURES", "CORRELATION_COLUMNS", "FILLED_WEATHER", "PRIORITY_RANK"):
        assert getattr(contract, name) == getattr(schema, name), name
    assert contract.BLEND == fc.BLEND and contract.CRITICAL_COLUMNS == quality.CRITICAL_COLUMNS
    assert contract.RULES == [r[:3] for r in advice.RULES]
    assert (contract.HOURS, contract.SCENARIOS) == (standin.HOURS, standin.SCENARIOS)


def test_forest_draws_go_round_a_short_table(spark):
    from wattfleet.operators import forest
    from wattfleet.schema import ANOMALY_FEATURES, IDENTIFIERS

    rng = np.random.default_rng(1)
    rows = [(1, 0, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", *map(float, rng.normal(size=8))) for i in range(60)]
    df = spark.createDataFrame(rows, [*IDENTIFIERS, *ANOMALY_FEATURES]).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    found = forest.fit(df, trees=5, sample_rows=16)
    assert set(found.forest.cover[found.forest.roots]) == {16.0}
    short = forest.fit(df.limit(7), trees=3, sample_rows=16)
    assert set(short.forest.cover[short.forest.roots]) == {7.0}
    assert len(forest.fit(df.limit(0), trees=3, sample_rows=16).forest.roots) == 0
