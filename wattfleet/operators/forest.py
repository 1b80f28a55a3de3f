"""Isolation forest (Liu, Ting, Zhou 2008) as the secondary anomaly signal.

Every draw, of rows, of split features and of cuts, is a digest of names (row key, tree, node), so a fit can be repeated
anywhere, in SQL too, and does not depend on partitions or on a generator's state.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wattfleet.functions.quantiles import exact_quantile
from wattfleet.functions.sampling import SEED
from wattfleet.operators.model import described
from wattfleet.operators.trees import NODE_COLUMNS, Forest, LeafMasks, collect_forest
from wattfleet.schema import ANOMALY_FEATURES, IDENTIFIERS, SERIES_KEYS, require_columns
from wattfleet.session import materialize

# fixed values
TREES = 100
SAMPLE_ROWS = 256
CONTAMINATION = 0.05
SCORE_DIGITS = 9        # scores are equal beyond these, whatever the order in which depths are added

_NODE_SCHEMA = (
    "tree_id int, node_id int, left int, right int, feature int, threshold double, value double, "
    "cover double, gain double, weight double"
)


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    full = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, full, np.where(n == 2, 1.0, 0.0))


def _draws(*names) -> tuple[int, int]:
    """Two numbers below 2^32 from a digest of names."""
    digest = hashlib.md5("|".join(map(str, names)).encode()).hexdigest()
    return int(digest[:8], 16), int(digest[8:16], 16)


def _grow(tree_id: int, x: np.ndarray, seed: int) -> pd.DataFrame:
    """One isolation tree; the value of a leaf is its depth plus the expected rest. Node n has the children 2n + 1 and 2n + 2."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list] = []
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        me, rows, depth = todo.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.nonzero(high > low)[0]
        node = [tree_id, me, -1, -1, -1, 0.0, depth + float(average_path(len(rows))), float(len(rows)), 0.0, 1.0]
        nodes.append(node)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            continue
        which, where = _draws(seed, tree_id, me)
        f = int(usable[which % len(usable)])
        cut = float(low[f] + where / 4294967296.0 * (high[f] - low[f]))
        goes_left = part[:, f] <= cut
        if goes_left.all():         # the draw hit the maximum
            continue
        node[2:6] = [2 * me + 1, 2 * me + 2, f, cut]
        todo += [(2 * me + 2, rows[~goes_left], depth + 1), (2 * me + 1, rows[goes_left], depth + 1)]
    return pd.DataFrame(nodes, columns=NODE_COLUMNS)


def _pool(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """The ``n`` rows of least digest with their ``place`` in that order, from zero.

    Only a share of the digests that holds about twice as many rows is ordered, so the single ordering task is bounded by ``n``.
    """
    name = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in SERIES_KEYS], F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    share = F.least(F.lit(1.0), (2 * n + 1000) / F.greatest(rows.agg(F.count(F.lit(1)).alias("n")).scalar(), F.lit(1)))
    named = rows.withColumn("__d", F.md5(name))
    few = named.where(F.conv(F.substring("__d", 1, 8), 16, 10).cast("long") < share * 4294967296.0).orderBy("__d", *IDENTIFIERS).limit(n)
    return few.withColumn("place", F.row_number().over(Window.orderBy("__d", *IDENTIFIERS)) - 1).drop("__d")


@dataclass
class IsolationForest:
    forest: Forest
    sample_rows: int
    offset: float
    contamination: float
    _masks: LeafMasks | None = field(default=None, repr=False, compare=False)

    def masks(self) -> LeafMasks:
        """The trees as tables of leaves, made once; a few MB that travel with the forest to the tasks."""
        if self._masks is None:
            self._masks = LeafMasks.of(self.forest, len(ANOMALY_FEATURES))
        return self._masks

    def score_array(self, x: np.ndarray) -> np.ndarray:
        """−2^(−mean depth / expected depth): the lower, the more isolated."""
        depth = self.masks().predict(x) / max(len(self.forest.roots), 1)
        return -np.power(2.0, -depth / max(float(average_path(self.sample_rows)), 1e-9))


def fit(
    df: DataFrame, trees: int = TREES, sample_rows: int = SAMPLE_ROWS, contamination: float = CONTAMINATION,
    seed: int = SEED, scope: Column | None = None,
) -> IsolationForest:
    """Fit on the complete rows of the chosen scope (the whole table by default).

    Trees take consecutive stretches of one sample of trees × sample_rows rows, around its end if it is shorter, so growing them moves a fixed
    amount of data, each row once. The cut is the exact contamination quantile of the scores of all rows.
    """
    require_columns(df.columns, ANOMALY_FEATURES, "anomaly table")
    rows = (df if scope is None else df.where(scope)).dropna(subset=ANOMALY_FEATURES)
    rows = rows.select(*dict.fromkeys([*IDENTIFIERS, *ANOMALY_FEATURES]))
    spark = df.sparkSession
    pool = materialize(_pool(rows, trees * sample_rows, seed), "forest-pool")
    size = pool.count()
    each = min(sample_rows, size)
    turns = spark.range(trees * each).select(
        F.expr(f"id DIV {max(each, 1)}").cast("int").alias("tree_id"), (F.col("id") % max(size, 1)).cast("int").alias("place"))
    drawn = turns.join(pool, "place")

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _grow(int(key[0]), pdf[ANOMALY_FEATURES].to_numpy(dtype=float), seed)

    nodes = materialize(drawn.groupBy("tree_id").applyInPandas(grow, _NODE_SCHEMA), "forest-nodes")
    forest = collect_forest(nodes)
    used = int(forest.cover[forest.roots].max()) if len(forest.roots) else 0
    model = IsolationForest(forest, used, 0.0, contamination)
    # written once: the quantile looks at the scores several times, and each look would run all trees again
    scored = materialize(score(rows, model).select("isoforest_score"), "forest-scores")
    found =exact_quantile(scored, [], "isoforest_score", contamination, "cut").first()
    model.offset = float(found["cut"]) if found and found["cut"] is not None else -0.5
    return model


def score(df: DataFrame, model: IsolationForest) -> DataFrame:
    """Add isoforest_score, anomaly_score (−1 or 1) and isoforest_anomaly (1 or 0).

    Rows with a missing feature keep NULL score and count as nominal. Only the eight features and the score
    cross into Python.
    """
    names = list(ANOMALY_FEATURES)
    model.masks()       # made here, not by each task

    @F.pandas_udf("double")
    def forest_score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        known = ~np.isnan(x).any(axis=1)
        out = np.full(len(x), np.nan)
        if known.any():
            out[known] = model.score_array(x[known])
        return pd.Series(out)

    value = forest_score(*[F.col(c).cast("double") for c in names])
    out = df.withColumn("isoforest_score", value)
    out = out.withColumn("isoforest_score", F.when(~F.isnan("isoforest_score"), F.round("isoforest_score", SCORE_DIGITS)))
    hit = F.coalesce(F.col("isoforest_score") < model.offset, F.lit(False))
    return out.withColumns({
        "anomaly_score": F.when(hit, F.lit(-1)).otherwise(F.lit(1)).cast("long"),
        "isoforest_anomaly": hit.cast("long")})


def forest_summary(scored: DataFrame, keys=("building_id", "meter")) -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.sum("isoforest_anomaly").alias("flags"), F.avg("isoforest_score").alias("mean_score"))


def save_forest(spark: SparkSession, model: IsolationForest, path: str) -> None:
    """The node table with the cut as Parquet."""
    f = model.forest
    tree = np.searchsorted(f.roots, np.arange(len(f.left)), side="right") - 1
    local = lambda child: np.where(child >= 0, child - f.roots[tree], -1)
    pdf = pd.DataFrame({
        "tree_id": tree, "node_id": np.arange(len(f.left)) - f.roots[tree], "left": local(f.left),
        "right": local(f.right), "feature": f.feature, "threshold": f.threshold, "value": f.value,
        "cover": f.cover, "gain": f.gain, "weight": np.ones(len(tree)),
    })
    nodes = spark.createDataFrame(pdf, _NODE_SCHEMA)
    nodes.withColumns({
        "sample_rows": F.lit(model.sample_rows), "offset": F.lit(model.offset),
        "contamination": F.lit(model.contamination)}).write.mode("overwrite").parquet(path)


def load_forest(spark: SparkSession, path: str) -> IsolationForest:
    nodes = spark.read.parquet(path)
    head = nodes.select("sample_rows", "offset", "contamination").first()
    return IsolationForest(collect_forest(nodes), int(head[0]), float(head[1]), float(head[2]))


def forest_metadata(spark: SparkSession, path: str, scope: str = "fleet") -> DataFrame:
    """What a saved forest is, read from its node table."""
    nodes = spark.read.parquet(path)
    return described(nodes, "IsolationForest", list(ANOMALY_FEATURES)).withColumns({
        "contamination": nodes.agg(F.max("contamination").alias("c")).scalar(), "training_scope": F.lit(scope)})
