"""Boosted trees, their attributions, and the isolation forest."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from wattfleet.operators import boosting, explain, features, forecast, forest, model
from wattfleet.operators.trees import Forest
from wattfleet.plans import reports
from wattfleet.schema import ANOMALY_FEATURES, MODEL_FEATURES
from wattfleet.session import materialize, scratch_path


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    n = 700
    parts = []
    for b in (1, 2):
        load = 60 + 25 * np.sin(np.arange(n) * 2 * np.pi / 24) + rng.normal(0, 4, n)
        load[rng.random(n) < 0.02] += 150
        parts.append(pd.DataFrame({
            "building_id": b, "meter": 0, "timestamp": pd.date_range("2024-02-01", periods=n, freq="h"),
            "meter_reading": load, "air_temperature": rng.normal(15, 5, n)}))
    df = rows_of(spark, pd.concat(parts)).withColumns({
        "meter_reading_log": F.log1p("meter_reading"),
        "square_feet": F.when(F.col("building_id") == 1, F.lit(1000)).cast("long"),
        "air_temperature": F.when(F.hour("timestamp") != 4, F.col("air_temperature"))})
    return materialize(features.model_table(features.feature_table(df)), "model-test")


@pytest.fixture(scope="module")
def fitted(spark, table):
    train, test = model.temporal_split(table, "2024-02-25")
    assert train.count() + test.count() == table.count() and test.agg(F.min("timestamp")).first()[0].day == 25
    return model.with_nodes(spark, model.train_gbt(train, test, max_iter=8, max_depth=4, step_size=0.3))


def test_number_of_trees_from_the_hold_out(table):
    train, test = model.temporal_split(table, "2024-02-25")
    fit = model.train_gbt(train, test, max_iter=60, max_depth=3, step_size=0.2, patience=8, first_rounds=10)
    errors = fit.evaluateEachIteration(model._assembled(test.dropna(subset=["meter_reading_log"])), "squared")
    assert 1 < fit.getNumTrees < 60 and errors[-1] == min(errors)
    held = forecast.evaluate(model.predict(test, fit)).first()["rmse_log"]
    y = [r[0] for r in train.select("meter_reading_log").collect()]
    constant = forecast.evaluate(test.withColumn("predicted_log", F.lit(float(np.mean(y))))).first()["rmse_log"]
    six = forecast.evaluate(test.withColumn("predicted_log", F.col("rolling_mean_6hr"))).first()["rmse_log"]
    assert held < min(constant, six)
    assert model.best_prefix([3, 2, 1, 2, 2, 0], 2) == (3, True) and model.best_prefix([3, 2, 1, 2], 2) == (3, False)


def matrix(df):
    return df.select(*model.tree_inputs(df).values()).toPandas().to_numpy(dtype=float)


def test_predictions_and_scores(table, fitted):
    rows = model.predict(table, fitted.model)
    assert rows.count() == table.count() and rows.where("predicted_kwh < 0 OR predicted_log IS NULL").count() == 0
    quality = forecast.evaluate(rows).first()
    plain = forecast.evaluate(table.withColumn("predicted_log", F.lit(4.0))).first()
    assert quality["rmse_log"] < plain["rmse_log"]
    with pytest.raises(ValueError, match="lag_1hr"):
        model.predict(table.drop("lag_1hr"), fitted.model)
    with pytest.raises(ValueError):
        model.check_contract(MODEL_FEATURES[::-1])


def test_arrays_predict_what_spark_predicts(table, fitted):
    rows = model.predict(table, fitted.model).orderBy("building_id", "timestamp")
    want = np.array([r[0] for r in rows.select("predicted_log").collect()])
    np.testing.assert_allclose(fitted.forest.predict(matrix(rows)), want, atol=1e-9)


def test_persistence(spark, table, fitted):
    path = scratch_path(spark, "model")
    model.save_model(fitted.model, path)
    a, b = (model.predict(table, m).agg(F.sum("predicted_log")).first()[0] for m in (fitted.model, model.load_model(path)))
    assert a == pytest.approx(b)


def test_importance_and_metadata(spark, fitted):
    nodes = fitted.nodes(spark)
    gain = model.feature_importance(nodes).collect()
    assert len(gain) == 22 and [r["importance"] for r in gain] == sorted((r["importance"] for r in gain), reverse=True)
    splits = sum(r["importance"] for r in model.feature_importance(nodes, "split").collect())
    assert splits == (fitted.forest.feature >= 0).sum()
    top = model.feature_importance(nodes, top=5).collect()
    low = model.feature_importance(nodes, top=5, lowest=True).collect()
    assert [r["feature"] for r in top] == [r["feature"] for r in gain[:5]] and [r["feature"] for r in low] == [r["feature"] for r in gain[-5:]]
    meta = model.model_metadata(spark, fitted).first()
    assert meta["num_trees"] == len(fitted.forest.roots) and meta["features"] == MODEL_FEATURES


def conditional(f: Forest, node, x, known):
    """Expected value of a tree when only the known features are fixed."""
    if f.feature[node] < 0:
        return f.value[node]
    i, left, right = f.feature[node], f.left[node], f.right[node]
    if i in known:
        return conditional(f, left if x[i] <= f.threshold[node] else right, x, known)
    return (f.cover[left] * conditional(f, left, x, known) + f.cover[right] * conditional(f, right, x, known)) / f.cover[node]


def brute_shapley(f: Forest, x, n):
    used = sorted({int(i) for i in f.feature if i >= 0})
    phi = np.zeros(n)
    for t, root in enumerate(f.roots):
        for i in used:
            rest = [j for j in used if j != i]
            for k in range(len(rest) + 1):
                w = factorial(k) * factorial(len(used) - k - 1) / factorial(len(used))
                for s in combinations(rest, k):
                    phi[i] += f.weights[t] * w * (conditional(f, root, x, set(s) | {i}) - conditional(f, root, x, set(s)))
    return phi


def test_shapley_against_brute_force():
    # two trees over four features; feature 0 occurs twice on one path
    f = Forest(
        roots=np.array([0, 7]), weights=np.array([1.0, 0.5]),
        left=np.array([1, 2, -1, -1, 5, -1, -1, 8, -1, -1]), right=np.array([4, 3, -1, -1, 6, -1, -1, 9, -1, -1]),
        feature=np.array([0, 1, -1, -1, 0, -1, -1, 2, -1, -1]),
        threshold=np.array([0.5, 0.3, 0, 0, 0.8, 0, 0, 0.4, 0, 0.0]),
        value=np.array([0, 0, 1.0, 4.0, 0, -2.0, 7.0, 0, 3.0, -1.0]),
        cover=np.array([100, 60, 20, 40, 40, 10, 30, 100, 25, 75.0]), gain=np.zeros(10))
    x = np.random.default_rng(0).random((20, 4))
    phi = explain.shap_values(f, x)
    for row, got in zip(x, phi):
        np.testing.assert_allclose(got, brute_shapley(f, row, 4), atol=1e-12)
    np.testing.assert_allclose(phi.sum(axis=1) + explain.expected_value(f), f.predict(x), atol=1e-12)


def test_explanations_add_up(table, fitted):
    rows = explain.explain_sample(table, fitted.forest, 40)
    got = rows.collect()
    assert len(got) == 40
    for r in got:
        parts = [c["shap_value"] for c in r["contributions"]]
        assert r["base_value"] + sum(parts) == pytest.approx(r["predicted_log"]) and len(parts) == 22
        sizes = [c["abs_shap"] for c in r["contributions"]]
        assert sizes == sorted(sizes, reverse=True)
        assert len(r["top_positive_drivers"]) <= 5 and all(c["shap_value"] > 0 for c in r["top_positive_drivers"])
        assert all(c["shap_value"] < 0 for c in r["top_negative_drivers"])
    again = {tuple(r[:3]) for r in explain.explain_sample(table.repartition(7), fitted.forest, 40).collect()}
    assert again == {tuple(r[:3]) for r in got}
    whole = explain.explain(table, fitted.forest)
    pred = model.predict(table, fitted.model).select("building_id", "meter", "timestamp", F.col("predicted_log").alias("p"))
    assert whole.join(pred, ["building_id", "meter", "timestamp"]).where("abs(predicted_log - p) > 1e-9").count() == 0
    mean = explain.mean_attribution(whole).collect()
    assert len(mean) == 22 and mean[0]["mean_abs_shap"] >= mean[-1]["mean_abs_shap"]


def test_linear_attribution(table):
    means = table.agg(*[F.avg(c).alias(c) for c in forecast.BLEND if c != "intercept"]).first().asDict()
    rows = table.dropna(subset=MODEL_FEATURES)
    phi = explain.linear_attribution(rows, forecast.BLEND, {c: F.lit(means.get(c) or 0.0) for c in MODEL_FEATURES})
    base = forecast.BLEND["intercept"] + sum(forecast.BLEND[c] * m for c, m in means.items())
    off = F.aggregate(phi, F.lit(base), lambda a, v: a + v) - forecast.linear_log()
    assert rows.where(F.abs(off) > 1e-9).count() == 0


def test_tree_forecast(table, fitted):
    rows, _ = forecast.forecast_24h(table.fillna(12.0, ["air_temperature"]), scorer=fitted.forest.predict)
    got = rows.where("building_id = 1").orderBy("step").toPandas()
    assert len(got) == 24
    np.testing.assert_allclose(got["lag_1hr"][1:], got["predicted_log"][:-1])
    np.testing.assert_allclose(fitted.forest.predict(got[MODEL_FEATURES].to_numpy(float)), got["predicted_log"])


def test_isolation_forest(spark, table):
    found = forest.fit(table, trees=40, sample_rows=128)
    assert len(found.forest.roots) == 40 and set(found.forest.cover[found.forest.roots]) == {128.0}
    scored = forest.score(table, found)
    rows = scored.select("isoforest_score", "isoforest_anomaly", "meter_reading", "air_temperature").toPandas()
    known = rows[rows["air_temperature"].notna()]
    assert ((known["isoforest_score"] < 0) & (known["isoforest_score"] >= -1)).all()
    assert 0.02 < known["isoforest_anomaly"].mean() < 0.08
    assert rows[rows["air_temperature"].isna()]["isoforest_anomaly"].sum() == 0
    spikes = known["meter_reading"] > 150
    assert known["isoforest_score"][spikes].mean() < known["isoforest_score"][~spikes].mean()
    path = scratch_path(spark, "forest")
    forest.save_forest(spark, found, path)
    back = forest.load_forest(spark, path)
    x = known.shape and np.random.default_rng(0).normal(size=(50, len(ANOMALY_FEATURES)))
    np.testing.assert_allclose(back.score_array(x), found.score_array(x))
    assert back.offset == found.offset
    summary = forest.forest_summary(scored).collect()
    assert sum(r["flags"] for r in summary) == rows["isoforest_anomaly"].sum()
    again = forest.fit(table.repartition(5), trees=40, sample_rows=128)
    np.testing.assert_allclose(again.score_array(x), found.score_array(x))


def test_average_path():
    np.testing.assert_allclose(forest.average_path([1, 2, 256]), [0.0, 1.0, 10.2448], atol=1e-3)


def test_explain_target_choices(table):
    month = reports.explain_targets(table, 2).collect()
    assert {r["building_id"] for r in month} == {1}       # building 2 has no floor area, so no complete row
    at = reports.explain_targets(table, 2, at="2024-02-20 09:00:00").collect()[0]
    assert at["timestamp"].day == 20 and at["timestamp"].hour == 9
    other = reports.explain_targets(table, 2, at="2030-01-01").collect()[0]
    first = table.dropna(subset=MODEL_FEATURES).where("building_id = 1").agg(F.min("timestamp")).first()[0]
    assert other["timestamp"] == first


# ---- boosting over bins ------------------------------------------------------

INPUTS = ["a", "b", "c"]


def boosted(spark, n, seed=0, **settings):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, len(INPUTS))), 1)
    y = np.where(x[:, 0] > 0.3, 2.0, 0.0) + np.where(x[:, 1] > -0.5, x[:, 0], 1.0) + rng.normal(0, 0.1, n)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], [*INPUTS, "y"]).repartition(3)
    return df, x, y, boosting.Settings(**{"max_iter": 3, "step_size": 0.2, "max_depth": 3, "min_rows": 5, "sampling": 1.0, "seed": 1, "max_bins": 64} | settings)


def test_splits_are_the_best_of_all_cuts(spark):
    df, x, y, settings = boosted(spark, 400, max_iter=1)
    (tree,), cuts = boosting.fit(df, INPUTS, "y", None, settings)
    assert all(set(c) <= set(x[:, f]) for f, c in enumerate(cuts))
    sse = lambda part: ((part - part.mean()) ** 2).sum()
    place = np.zeros(len(x), int)
    for level, (feature, cut) in enumerate(zip(tree.features, tree.cuts)):
        right = np.zeros(len(x), int)
        for node in range(2 ** level):
            mine = place == node
            assert tree.stats[level][node, 0] == mine.sum()
            got = x[:, feature[node]] > cuts[feature[node]][cut[node]]
            best = min(sse(y[mine & ~r]) + sse(y[mine & r]) for f in range(3) for c in cuts[f]
                       for r in [x[:, f] > c] if min((mine & r).sum(), (mine & ~r).sum()) >= 5)
            assert sse(y[mine & ~got]) + sse(y[mine & got]) == pytest.approx(best)
            assert tree.gains[level][node] == pytest.approx((sse(y[mine]) - best) / mine.sum())
            right[mine] = got[mine]
        place = 2 * place + right
    for leaf, value in enumerate(tree.values()):
        assert value == pytest.approx(y[place == leaf].mean())


def test_written_remainders_and_small_blocks_change_nothing(spark, monkeypatch):
    df, _, _, settings = boosted(spark, 500, max_iter=6)
    held = boosted(spark, 200, seed=5)[0]
    seen = []

    def keep_all(errors):
        seen.append(list(errors))
        return len(errors), False

    whole, _ = boosting.fit(df, INPUTS, "y", held, settings, keep_all)
    for name, value in (("LINEAGE", 2), ("EVERY", 2), ("BLOCK_ROWS", 16)):
        monkeypatch.setattr(boosting, name, value)
    parts, _ = boosting.fit(df, INPUTS, "y", held, settings, keep_all)
    for a, b in zip(whole, parts, strict=True):
        np.testing.assert_array_equal(np.concatenate(a.cuts), np.concatenate(b.cuts))
        np.testing.assert_allclose(a.values(), b.values(), atol=1e-9)
    np.testing.assert_allclose(seen[0], seen[-1])
    assert [len(e) for e in seen] == [6, 2, 4, 6] and seen[0][-1] < seen[0][0]


def test_no_round_is_fitted_twice(table, monkeypatch):
    train, test = model.temporal_split(table, "2024-02-25")
    grown, errors, grow, best = [], [], boosting.grow, model.best_prefix
    monkeypatch.setattr(boosting, "grow", lambda *a: grown.append(a[3]) or grow(*a))
    monkeypatch.setattr(model, "best_prefix", lambda e, patience: errors.append(e) or best(e, patience))
    fit = model.train_gbt(train, test, max_iter=200, max_depth=4, step_size=0.5, patience=4)
    stop = next(i for i in range(len(errors[-1])) if best(errors[-1][:i + 1], 4)[1])
    assert grown == list(range(len(grown))) and stop < len(grown) <= stop + boosting.EVERY
    assert fit.getNumTrees == best(errors[-1], 4)[0]
    held = model._assembled(test.dropna(subset=["meter_reading_log"]))
    np.testing.assert_allclose(fit.evaluateEachIteration(held, "squared"), errors[-1][:fit.getNumTrees])
