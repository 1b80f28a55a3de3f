"""Work per task and passes over the data that must not grow faster than the input."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import plan_text, rows_of
from wattfleet.functions import quantiles
from wattfleet.functions.quantiles import exact_quantile
from wattfleet.operators import forest, trees
from wattfleet.operators.trees import Forest
from wattfleet.plans import catalog
from wattfleet.schema import ANOMALY_FEATURES, IDENTIFIERS, YEAR_MONTH
from wattfleet.session import configure, scratch_path
from wattfleet.sources import standin


def lines(spark, rows):
    """A folder with a lineitem table of (order key, line number, supplier, quantity)."""
    folder = scratch_path(spark, "lines")
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double").withColumns(
        {"l_tax": F.lit(0.01), "l_discount": F.lit(0.0)})
    df.write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_dense_series_unfold_where_their_readings_lie(spark):
    hours = standin.HOURS
    folder = lines(spark, [
        (5, 1, 1, 1.0), (9, 1, 1, 2.0), (9, 5, 1, 3.0), (hours + 2, 2, 1, 4.0), (hours + 12, 2, 1, 5.0), (7, 3, 1, float("nan")), (8, None, 1, 7.0)])
    rows = standin.dense(spark, folder)
    assert "Join" not in plan_text(rows)     # a join would begin from the bare list of series, in one task
    got = rows.toPandas()
    start = pd.Timestamp("2024-01-01")
    span = [start + pd.Timedelta(hours=h) for h in range(2, 13)]
    read = {(0, 0, 5): 41.0, (0, 0, 9): 85.0, (1, 1, 2): 44.0, (1, 1, 12): 45.0}
    want = {(b, m, t): 60.0 for b, m in ((0, 0), (1, 1), (0, 2), (0, None)) for t in span}
    want |= {(b, m, start + pd.Timedelta(hours=h)): v for (b, m, h), v in read.items()}
    found = {(b, None if pd.isna(m) else m, t): v for b, m, t, v in got.itertuples(index=False)}
    assert len(got) == len(want) and found == want


def test_tasks_of_an_exchange_follow_the_input(spark):
    names = ["spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"]
    before = [spark.conf.get(n, None) for n in names]
    try:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        wanted = [least, 160, 960]
        for size, tasks in zip((1, 640 << 20, 3840 << 20), wanted):
            assert configure(spark, size).conf.get(names[0]) == str(tasks)
            assert int(spark.conf.get(names[2])) <= 16 << 20
    finally:
        for n, v in zip(names, before):
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def random_forest(seed, trees, rows, depth):
    """A forest of random cuts with leaves at all depths."""
    rng = np.random.default_rng(seed)
    nodes, roots = [], []

    def grow(level):
        me = len(nodes)
        nodes.append([-1, -1, -1, 0.0, rng.normal()])
        if level < depth and rng.random() > 0.15:
            nodes[me][2], nodes[me][3] = int(rng.integers(4)), rng.normal()
            nodes[me][0] = grow(level + 1)
            nodes[me][1] = grow(level + 1)
        return me

    for _ in range(trees):
        roots.append(grow(0))
    left, right, feature, cut, value = map(np.array, zip(*nodes))
    whole = lambda a: a.astype(np.int64)
    same = np.ones(len(nodes))
    found = Forest(np.array(roots), rng.normal(size=trees), whole(left), whole(right), whole(feature), cut.astype(float), value, same, same)
    x = rng.normal(size=(rows, 4))
    x[::7, 1], x[3::11, 2], x[5, 0] = np.nan, np.append(found.threshold[found.feature >= 0], 0.0)[0], np.inf
    return found, x


def test_complete_trees_give_what_single_steps_give(monkeypatch):
    for depth in (0, 1, 5):
        f, x = random_forest(depth, 9, trees.BLOCK_ROWS + 300, depth)
        want = np.zeros(len(x))
        for t, w in enumerate(f.weights):
            want += w * f.value[f.leaf_of(t, x)]
        assert (f.predict(x) == want).all() and len(f.predict(x[:0])) == 0
        monkeypatch.setattr(trees, "MAX_LEVELS", 2)         # deeper ones are walked
        assert (f.predict(x) == want).all()
        monkeypatch.undo()
        walked = [f.complete(t)[0] for t in range(9)]
        assert max(walked) <= depth


def test_sets_of_leaves_give_what_single_steps_give():
    for depth in (0, 1, 5, 9):          # up to several words of leaves
        f, x = random_forest(depth, 9, trees.MASK_ROWS + 300, depth)
        want = np.zeros(len(x))
        for t, w in enumerate(f.weights):
            want += w * f.value[f.leaf_of(t, x)]
        masks = trees.LeafMasks.of(f, x.shape[1])
        assert (masks.predict(x) == want).all() and len(masks.predict(x[:0])) == 0
    assert max(len(tables[0][1]) for tables, _ in masks.tables if tables) > 2


def test_the_cut_of_a_forest_scores_each_row_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame(rng.normal(size=(n, len(ANOMALY_FEATURES))), columns=ANOMALY_FEATURES)
    pdf["building_id"], pdf["meter"], pdf["timestamp"] = 1, 0, pd.date_range("2024-01-01", periods=n, freq="h")
    seen = {}

    def looked(df, groups, value, *rest):
        seen["plan"] = plan_text(df)
        return exact_quantile(df, groups, value, *rest, refine=True)

    monkeypatch.setattr(forest, "exact_quantile", looked)
    found = forest.fit(rows_of(spark, pdf), trees=5, sample_rows=64)
    assert "ArrowEvalPython" not in seen["plan"]            # the scores are read, not made again by each look
    scores = np.round(found.score_array(pdf[ANOMALY_FEATURES].to_numpy()), forest.SCORE_DIGITS)
    assert abs(found.offset - np.quantile(scores, forest.CONTAMINATION)) < 1e-9


def test_order_lines_are_summed_once(spark):
    """Limits, medians and windows read written readings, and the wide stage is code the JVM compiles."""
    for build in (catalog.model_rows, catalog.built_features, catalog.dense_features):
        assert "lineitem" not in plan_text(build(spark, "/root/testdata/sf0.001"))
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_the_forest_reads_tables_of_its_own_columns(spark, monkeypatch):
    """Without the whole tables at hand only the forest's columns are stored; the order lines are summed once for both tables."""
    monkeypatch.setattr(catalog, "_ONCE", {})
    sf = "/root/testdata/sf0.001"
    narrow, trained = (make(spark, sf, ANOMALY_FEATURES) for make in (catalog.featured, catalog.model_table_once))
    for table in (narrow, trained):
        assert table.columns == [*IDENTIFIERS, *ANOMALY_FEATURES, YEAR_MONTH]
    assert sum("source readings" in key for key in catalog._ONCE) == 1
    rows = lambda df: sorted(map(str, df.select(*IDENTIFIERS, *ANOMALY_FEATURES).collect()))
    for got, make in ((narrow, catalog.featured), (trained, catalog.model_table_once)):
        whole = make(spark, sf)
        assert "lag_168hr" in whole.columns and rows(got) == rows(whole)
        assert make(spark, sf, ANOMALY_FEATURES).columns == whole.columns      # once there, it is read


def test_the_cut_of_a_forest_is_narrowed_where_scores_outgrow_a_map(spark, monkeypatch):
    """Saving, describing and applying a forest all wait for its cut, which is no task's map of all scores."""
    rng = np.random.default_rng(4)
    n = 500
    pdf = pd.DataFrame(rng.normal(size=(n, len(ANOMALY_FEATURES))), columns=ANOMALY_FEATURES)
    pdf["building_id"], pdf["meter"], pdf["timestamp"] = 1, 0, pd.date_range("2024-01-01", periods=n, freq="h")
    rows, seen = rows_of(spark, pdf), []

    def looked(*args):
        seen.append(exact_quantile(*args))
        return seen[-1]

    monkeypatch.setattr(forest, "exact_quantile", looked)
    small = forest.fit(rows, trees=5, sample_rows=64)
    monkeypatch.setattr(quantiles, "MAP_BYTES", 100)
    large = forest.fit(rows, trees=5, sample_rows=64)
    assert ["percentile" in plan_text(q) for q in seen] == [True, False]
    assert abs(small.offset - large.offset) < 1e-12
