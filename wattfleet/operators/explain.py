"""Additive attribution of tree predictions: path-dependent Shapley values (Lundberg et al. 2020).

A leaf contributes through the distinct features on its path. For each of them the row
either passes all its splits or not, and the training cover gives the share that would pass
at random. Leaves have at most ``depth`` features, so the subset sums are short polynomials,
evaluated for all rows of an Arrow batch at once.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from wattfleet.functions.sampling import hash_sample
from wattfleet.operators.model import prepare_features, tree_inputs
from wattfleet.operators.trees import Forest
from wattfleet.schema import IDENTIFIERS, MODEL_FEATURES

_CONTRIBUTION = "struct<feature:string,value:double,shap_value:double,abs_shap:double>"


def leaf_paths(forest: Forest) -> list[tuple[float, np.ndarray, list[list[tuple[int, float, bool]]], np.ndarray]]:
    """Per leaf: weighted value, its features, the splits of each, and the cover share of each."""
    out = []
    for t, root in enumerate(forest.roots):
        todo = [(int(root), {}, {})]
        while todo:
            node, splits, share = todo.pop()
            f = int(forest.feature[node])
            if f < 0:
                feats = np.array(sorted(splits), dtype=np.int64)
                out.append((forest.weights[t] * forest.value[node], feats,
                            [splits[i] for i in feats], np.array([share[i] for i in feats])))
                continue
            for child, left in ((forest.left[node], True), (forest.right[node], False)):
                part = forest.cover[child] / forest.cover[node]
                todo.append((int(child), {**splits, f: splits.get(f, []) + [(node, forest.threshold[node], left)]},
                             {**share, f: share.get(f, 1.0) * part}))
    return out


def expected_value(forest: Forest) -> float:
    """The cover-weighted mean prediction: the base the attributions add to."""
    return float(sum(v * (z.prod() if len(z) else 1.0) for v, _, _, z in leaf_paths(forest)))


def shap_values(forest: Forest, x: np.ndarray, paths=None) -> np.ndarray:
    """Attribution of each feature for each row (rows × features)."""
    phi = np.zeros((len(x), x.shape[1]))
    for value, feats, splits, z in paths if paths is not None else leaf_paths(forest):
        m = len(feats)
        passes = np.ones((m, len(x)))
        for j, f in enumerate(feats):
            for _, cut, left in splits[j]:
                passes[j] *= (x[:, f] <= cut) if left else ~(x[:, f] <= cut)
        for j, f in enumerate(feats):
            poly = np.zeros((m, len(x)))        # coefficient k: subsets of size k without feature j
            poly[0] = 1.0
            for i in range(m):
                if i != j:
                    shifted = np.vstack([np.zeros((1, len(x))), poly[:-1]])
                    poly = poly * z[i] + shifted * passes[i]
            weight = np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)])
            phi[:, f] += value * (passes[j] - z[j]) * (weight @ poly)
    return phi


def explain(rows: DataFrame, forest: Forest) -> DataFrame:
    """Per row: base value, contributions by size, both predictions, and the top five each way.

    Base value plus the contributions equals predicted_log.
    """
    ready = prepare_features(rows)
    names = list(MODEL_FEATURES)

    @F.pandas_udf("array<double>")
    def attribute(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        return pd.Series(list(shap_values(forest, x)))

    phi = attribute(*tree_inputs(ready).values())
    base = expected_value(forest)
    entry = lambda i, c: F.struct(
        F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), F.col("__phi")[i].alias("shap_value"),
        F.abs(F.col("__phi")[i]).alias("abs_shap"))
    by_size = lambda a, b: F.when(a["abs_shap"] > b["abs_shap"], -1).when(a["abs_shap"] < b["abs_shap"], 1).otherwise(0)
    total = F.aggregate("__phi", F.lit(base), lambda acc, v: acc + v)
    out = ready.withColumn("__phi", phi).withColumns({
        "base_value": F.lit(base), "predicted_log": total,
        "contributions": F.array_sort(F.array(*[entry(i, c) for i, c in enumerate(names)]), by_size)})
    top = lambda keep: F.slice(F.filter("contributions", keep), 1, 5)
    return out.select(
        *[c for c in IDENTIFIERS if c in out.columns], "base_value", "predicted_log",
        F.expm1("predicted_log").alias("predicted_kwh"), "contributions",
        top(lambda c: c["shap_value"] > 0).alias("top_positive_drivers"),
        top(lambda c: c["shap_value"] < 0).alias("top_negative_drivers"))


def explain_sample(rows: DataFrame, forest: Forest, max_samples: int = 100, seed: int = 42) -> DataFrame:
    """Explanations of a seeded sample of at most ``max_samples`` rows."""
    return explain(hash_sample(rows, max_samples, seed), forest)


def mean_attribution(explained: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    return (explained.select(F.explode("contributions").alias("c"))
            .groupBy("c.feature").agg(F.avg("c.abs_shap").alias("mean_abs_shap"))
            .orderBy(F.desc("mean_abs_shap"), "feature"))


def linear_attribution(rows: DataFrame, weights: dict[str, float], means: dict[str, Column]) -> Column:
    """Attributions of a linear scorer, w·(x − mean x): a closed form to check against."""
    return F.array(*[
        (F.col(c) - means[c]) * float(weights.get(c, 0.0)) for c in MODEL_FEATURES])
