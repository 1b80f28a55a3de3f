"""Node tables of fitted tree models, as flat numpy arrays small enough to ship to every task.

A model's size is set by its tree count and depth, not by the data: 500 trees of depth 6
are at most 63,500 nodes. ``MAX_NODES`` checks that before anything is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

MAX_NODES = 2_000_000
MAX_LEVELS = 12         # deeper trees are walked node by node
BLOCK_ROWS = 4096
MASK_ROWS = 1 << 14     # look-ups in small tables need no block that fits the cache, but few calls
NODE_COLUMNS = ["tree_id", "node_id", "left", "right", "feature", "threshold", "value", "cover", "gain", "weight"]


@dataclass
class Forest:
    """Trees as parallel arrays; children are array positions, leaves have feature -1."""

    roots: np.ndarray
    weights: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    def leaf_of(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The leaf each row of x ends in: all rows go down one level per pass."""
        at = np.full(len(x), self.roots[tree])
        while True:
            inner = np.nonzero(self.feature[at] >= 0)[0]
            if not len(inner):
                return at
            node = at[inner]
            goes_left = x[inner, self.feature[node]] <= self.threshold[node]
            at[inner] = np.where(goes_left, self.left[node], self.right[node])

    def complete(self, tree: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray] | None:
        """A tree filled up to one depth: (levels, features and cuts in heap order, values of the bottom row).

        A leaf above the bottom stands in all places below it. None for a tree too deep to be filled up.
        """
        at, features, cuts = self.roots[tree:tree + 1], [], []
        while (inner := self.feature[at] >= 0).any():
            if len(features) == MAX_LEVELS:
                return None
            features.append(np.where(inner, self.feature[at], 0))
            cuts.append(np.where(inner, self.threshold[at], 0.0))
            at = np.column_stack([np.where(inner, self.left[at], at), np.where(inner, self.right[at], at)]).ravel()
        none = np.zeros(0)
        return len(features), np.concatenate([none.astype(np.int64), *features]), np.concatenate([none, *cuts]), self.value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Weighted sum of the trees' values, in blocks of rows that stay in the processor's cache.

        In a complete tree the next place follows from the last one and one comparison, without looking up children.
        """
        trees = [self.complete(t) for t in range(len(self.roots))]
        out = np.zeros(len(x))
        for start in range(0, len(x), BLOCK_ROWS):
            rows = x[start:start + BLOCK_ROWS]
            n, mine = len(rows), np.arange(len(rows))
            flat = np.ascontiguousarray(rows.T, dtype=float).ravel()        # one feature after the other
            total = out[start:start + n]
            for t, w in enumerate(self.weights):
                if trees[t] is None:
                    total += w * self.value[self.leaf_of(t, rows)]
                    continue
                levels, features, cuts, values = trees[t]
                first, at = features * n, np.zeros(n, dtype=np.int64)
                for _ in range(levels):
                    goes_left = flat.take(first.take(at) + mine) <= cuts.take(at)
                    at += at
                    at += 2
                    at -= goes_left
                total += w * values.take(at - ((1 << levels) - 1))
        return out


@dataclass
class LeafMasks:
    """Many rows through many trees by looking up sets of leaves instead of walking.

    The leaves of a tree are bits, from left to right. A cut that a value is above rules out the leaves to its left, so per tree, feature and number
    of the feature's cuts below the value (counted over all trees) a table holds what is left; the first leaf that all features leave is
    the one the row ends in. Costs a few look-ups per tree and feature, whatever the depth.
    """

    cuts: list[np.ndarray]      # of each feature, over all trees
    tables: list[tuple[list[tuple[int, np.ndarray]], np.ndarray]]      # per tree: (feature, words x places) of its features, and the values of its leaves, weighted

    @classmethod
    def of(cls, forest: Forest, features: int) -> LeafMasks:
        inner = forest.feature >= 0
        cuts = [np.unique(forest.threshold[inner & (forest.feature == f)]) for f in range(features)]
        return cls(cuts, [cls._table(forest, t, cuts) for t in range(len(forest.roots))])

    @staticmethod
    def _table(forest: Forest, tree: int, cuts: list[np.ndarray]) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        leaves, ruled, todo = [], [], [(int(forest.roots[tree]), None)]
        while todo:         # left before right; a node comes up again once its left leaves are known
            node, since = todo.pop()
            if since is not None:
                ruled.append((int(forest.feature[node]), forest.threshold[node], since, len(leaves)))
            elif forest.feature[node] < 0:
                leaves.append(node)
            else:
                todo += [(int(forest.right[node]), None), (node, len(leaves)), (int(forest.left[node]), None)]
        words, whole, every = -(-len(leaves) // 64), (1 << len(leaves)) - 1, (1 << 64) - 1
        tables = []
        for f in sorted({r[0] for r in ruled}):
            mine = sorted((r[1:] for r in ruled if r[0] == f), key=lambda r: r[0])
            left, steps = whole, [whole]
            for _, since, until in mine:
                left &= ~((1 << until) - (1 << since))
                steps.append(left)
            held = np.array([[(s >> (64 * w)) & every for s in steps] for w in range(words)], np.uint64)
            places = np.searchsorted(cuts[f], [r[0] for r in mine], side="right")      # from this count of all cuts on, its own is below
            tables.append((f, held.take(np.searchsorted(places, np.arange(len(cuts[f]) + 1), side="right"), axis=1)))
        return tables, forest.weights[tree] * forest.value[leaves]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """What ``Forest.predict`` gives; a value that is not a number lies above all cuts, as in every comparison."""
        out = np.zeros(len(x))
        for start in range(0, len(x), MASK_ROWS):
            rows = x[start:start + MASK_ROWS]
            places = [np.searchsorted(c, rows[:, f]) for f, c in enumerate(self.cuts)]
            total = out[start:start + len(rows)]
            got = np.empty(len(rows), np.uint64)
            for tables, values in self.tables:
                if not tables:
                    total += values[0]
                    continue
                leaf = None
                for w in reversed(range(len(tables[0][1]))):
                    left = tables[0][1][w].take(places[tables[0][0]])
                    for f, table in tables[1:]:
                        left &= table[w].take(places[f], out=got, mode="clip")
                    here = _first_bit(left)
                    here += 64 * w
                    leaf = here if leaf is None else np.where(left != 0, here, leaf)
                total += values.take(leaf, mode="clip")
        return out


def _first_bit(words: np.ndarray) -> np.ndarray:
    """The place of the lowest bit that is set, by the exponent of that power of two."""
    first = (words & (~words + np.uint64(1))).astype(float).view(np.int64)
    first >>= 52
    first -= 1023
    return first


def collect_forest(nodes: DataFrame) -> Forest:
    """Node table (``NODE_COLUMNS``) to arrays, refusing tables too large to ship."""
    n = nodes.count()
    if n > MAX_NODES:
        raise ValueError(f"{n} nodes exceed the limit of {MAX_NODES} for a shipped model")
    pdf = nodes.select(*NODE_COLUMNS).toPandas().sort_values(["tree_id", "node_id"], ignore_index=True)
    place = {key: i for i, key in enumerate(zip(pdf["tree_id"], pdf["node_id"]))}
    inner = (pdf["left"] >= 0).to_numpy()
    child = lambda side: np.array([
        place[(t, c)] if c >= 0 else -1 for t, c in zip(pdf["tree_id"], pdf[side])], dtype=np.int64)
    roots = pdf.index[pdf["node_id"] == 0].to_numpy()
    return Forest(
        roots=roots, weights=pdf["weight"].to_numpy(float)[roots], left=child("left"), right=child("right"),
        feature=np.where(inner, pdf["feature"], -1).astype(np.int64), threshold=pdf["threshold"].to_numpy(float),
        value=pdf["value"].to_numpy(float), cover=pdf["cover"].to_numpy(float), gain=pdf["gain"].to_numpy(float))


def boosted_nodes(spark, path: str) -> DataFrame:
    """The node table of a saved boosted-tree model."""
    # Spark 4 stores (tree, metadata, weight) without names
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree_id", "about", "weight").drop("about")
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree_id"), n["id"].alias("node_id"), n["leftChild"].alias("left"),
        n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
        F.coalesce(F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0)).alias("threshold"),
        n["prediction"].alias("value"), n["rawCount"].cast("double").alias("cover"), n["gain"].alias("gain"),
    ).join(weights, "tree_id")
