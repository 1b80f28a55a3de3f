"""Nearest neighbours against brute force: recall, exact scores, ties, hot copies and awkward rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattfleet.llm import neighbours

SF = "/root/testdata/sf0.1"


def brute(ids, x, queries, k=5):
    """Exact answer: {query: [(id, score)]}, ties to the smaller id."""
    x = np.asarray(x, float)
    size = np.sqrt((x * x).sum(1))
    out = {}
    for i in queries:
        at = ids.index(i)
        score = (x * x[at]).sum(1) / (size * size[at])
        order = sorted((j for j in range(len(ids)) if j != at), key=lambda j: (-score[j], ids[j]))[:k]
        out[i] = [(ids[j], score[j]) for j in order]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_quantile():
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.5073) < 1e-3 and abs(neighbours.chi_square_quantile(0.5, 2) - 2 * np.log(2)) < 1e-9


@pytest.mark.parametrize("block_rows", [150, 4096])
def test_recall_and_scores(spark, block_rows):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    pdf = rows.toPandas()
    ids = pdf["vec_id"].tolist()
    want = brute(ids, np.stack(pdf["embedding"]), [i for i in ids if i % 50 == 0])
    got = answers(neighbours.nearest(rows, F.col("vec_id") % 50 == 0, block_rows=block_rows, query_rows=7))
    assert set(got) == set(want) and all(len(g) == 5 for g in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    x = {i: np.asarray(v, float) for i, v in zip(ids, pdf["embedding"], strict=True)}
    for q, found in got.items():
        for i, s in found:
            assert abs(s - x[i] @ x[q] / np.sqrt((x[i] @ x[i]) * (x[q] @ x[q]))) < 1e-12
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_stopping_skips_far_cells():
    """Two far groups: the test leaves the other group's leaves unread."""
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 0.01, (2000, 32)) + np.eye(32)[0], r.normal(0, 0.01, (2000, 32)) + np.eye(32)[1]])
    z = neighbours.projected(x)
    block, seen = neighbours.Block(np.arange(4000), x, z), []
    inner = block.tree.leaves
    block.tree.leaves = lambda q: (seen.append(e - s) or (g, s, e) for g, s, e in inner(q))
    ids, _ = block.nearest(x[0], z[0], 6, float("inf"), neighbours.chi_square_quantile(neighbours.CONFIDENCE, neighbours.PROJECTIONS))
    assert 0 in ids and max(ids) < 2000 and sum(seen) < 2500


def test_copies_of_one_vector(spark):
    """A third of all rows hold one vector: ties go to the least ids, and nothing grows with the copies but the queries among them."""
    r = np.random.default_rng(1)
    x = [([1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else r.normal(size=4).tolist()) for i in range(1500)]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>").repartition(5)
    got = answers(neighbours.nearest(df, F.col("vec_id") % 50 == 0, block_rows=100, query_rows=20))
    assert len(got) == 30
    for q in got:
        if q % 3 == 0:
            assert [i for i, _ in got[q]] == [i for i in range(0, 21, 3) if i != q][:5]


def test_vectors_of_one_direction_are_ties(spark):
    x = [[2.0 ** (i % 7), 2.0 ** (i % 7 + 1)] for i in range(60)] + [[1.0, -1.0]] * 3
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>")
    got = answers(neighbours.nearest(df, F.col("vec_id") == 50, block_rows=8))
    assert [i for i, _ in got[50]] == [0, 1, 2, 3, 4]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [9.0, 9.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (50, [1e200, 1e200]), (3, None), (4, []),
            (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0, 1.0, 1.0]), (100, None)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, cell int, score string")
    got = answers(neighbours.report(df))
    assert set(got) == {0, 50} and [i for i, _ in got[0]] == [1, 50, 2] and {i for i, _ in got[50]} == {0, 1, 2}
    assert abs(got[0][1][1] - 0.5 ** 0.5) < 1e-12
    report = neighbours.report(df)
    assert dict(report.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    assert neighbours.report(df.limit(0)).count() == 0 and neighbours.report(df.where("vec_id = 0")).count() == 0
    assert neighbours.report(df.where("vec_id = 2")).count() == 0
