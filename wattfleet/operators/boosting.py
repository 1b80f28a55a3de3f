"""Boosted regression trees over binned rows: one pass a level, sums of bins instead of rows.

Every feature is cut once into at most ``max_bins`` bins, and the rows go into blocks of byte-sized bins with what the
trees so far leave of their targets. A level of a tree is one Spark job: each task walks its blocks down the tree and sums counts and
remainders per node, feature and bin; these tables, whose size is set by depth and bins and not by rows, meet on the driver,
which picks the splits. Of two sister nodes only the smaller one is summed, the other is what the parent has more.

The rounds follow Spark ML's boosting for squared loss: the first tree is fitted to the target and has weight 1, each
later one to twice the remainder, weighted by the step size; every tree sees a random share of the rows and every node of
the features. Hold-out rows are scored as the trees come, so a fit stops where the hold-out error does, and no round is fitted twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from wattfleet.session import materialize, scratch_root

BLOCK_ROWS = 1 << 15        # rows of one block
TASK_ROWS = 4_000_000       # rows of one task, above one task for each core
EVERY = 10                  # rounds between two looks at the hold-out
LINEAGE = 40                # changes of the remainders until they are written
STAY = 255                  # a cut no bin lies above: all rows go left
ACCURACY = 2000             # of the quantiles that cut the bins


@dataclass
class Settings:
    max_iter: int
    step_size: float
    max_depth: int
    min_rows: int
    sampling: float
    seed: int
    max_bins: int


@dataclass
class Tree:
    """Features and cuts of each level, in heap order, and of every node its rows, sum and sum of squares; leaves stand left at the bottom."""

    features: list[np.ndarray]
    cuts: list[np.ndarray]
    stats: list[np.ndarray]
    gains: list[np.ndarray]
    weight: float
    scale: float

    def values(self) -> np.ndarray:
        """What a row at each place of the bottom adds to a prediction."""
        n, s = self.stats[-1][:, 0], self.stats[-1][:, 1]
        return self.weight * self.scale * np.divide(s, n, out=np.zeros(len(n)), where=n > 0)


def quantile_cuts(rows: DataFrame, names: list[str], max_bins: int) -> list[np.ndarray]:
    """Cuts of each feature: a row lies in the bin of the first cut that it is not above."""
    if not 2 <= max_bins < STAY:
        raise ValueError(f"features are cut into 2 to {STAY - 1} bins")
    shares = F.array(*[F.lit(i / (max_bins - 1)) for i in range(max_bins - 1)])      # the least value, which may stand for a missing one, is a cut
    got = rows.agg(*[F.percentile_approx(c, shares, ACCURACY).alias(c) for c in names]).first()
    if got[0] is None:
        raise ValueError("no rows with a target to fit the trees to")
    return [np.unique(np.array(got[c], float)) for c in names]


def binned(rows: DataFrame, names: list[str], target: str, cuts: list[np.ndarray]) -> DataFrame:
    """``bins, rest, n``: blocks of at most ``BLOCK_ROWS`` rows, one feature's bins after the other."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held)
        bins = np.stack([np.searchsorted(c, whole[i].to_numpy()).astype(np.uint8) for i, c in enumerate(cuts)])
        return pa.RecordBatch.from_pydict({
            "bins": pa.array([bins.tobytes()], pa.binary()),
            "rest": pa.array([whole[len(cuts)].to_numpy().astype(float).tobytes()], pa.binary()),
            "n": pa.array([whole.num_rows], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK_ROWS - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == BLOCK_ROWS:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return rows.select(*names, F.col(target).cast("double")).mapInArrow(run, "bins binary, rest binary, n long")


class Blocks:
    """Blocks ``(number, bins, rest, errors)`` kept by Spark, whose remainders follow the trees and are written every ``LINEAGE`` changes.

    ``errors`` holds the sum of squared remainders after each of the trees last followed.
    """

    def __init__(self, stored: DataFrame, features: int):
        context = stored.sparkSession.sparkContext
        self.rows, many = stored.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        tasks = max(1, min(many, max(context.defaultParallelism, -(-self.rows // TASK_ROWS))))
        numbered = stored.withColumn("number", F.monotonically_increasing_id())

        def arrays(row):
            return row["number"], np.frombuffer(row["bins"], np.uint8).reshape(features, -1), np.frombuffer(row["rest"]), []

        self.first = numbered.repartition(tasks).rdd.map(arrays).persist(StorageLevel.MEMORY_AND_DISK)
        self.now, self.changes, self.old = self.first, 0, []

    def follow(self, trees: list[Tree]) -> None:
        """Take what the trees say off the remainders; a job that uses the blocks does it."""

        def run(blocks):
            for number, bins, rest, _ in blocks:
                errors = []
                for tree in trees:
                    rest = rest - tree.values().take(walk(bins, np.arange(len(rest)), tree.features, tree.cuts))
                    errors.append(float(rest @ rest))
                yield number, bins, rest, errors

        self.old.append(self.now)
        self.now = self.now.mapPartitions(run, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        self.changes += 1

    def settled(self) -> None:
        """Let go of older remainders, once a job has made the new ones."""
        if self.changes >= LINEAGE:
            rests = self.now.map(lambda b: b[2])
            rests.checkpoint()
            rests.count()
            self.old.append(self.now)
            self.now = self.first.zip(rests).map(lambda b: (b[0][0], b[0][1], b[1], [])).persist(StorageLevel.MEMORY_AND_DISK)
            self.now.count()
            self.changes = 0
        for rdd in self.old:
            if rdd is not self.first:
                rdd.unpersist()
        self.old = []

    def close(self) -> None:
        for rdd in (*self.old, self.now, self.first):
            rdd.unpersist()


def walk(bins: np.ndarray, rows: np.ndarray, features: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """The place in the next level, from the left, that each of the rows comes to."""
    at, flat = np.zeros(len(rows), np.int64), bins.ravel()
    for feature, cut in zip(features, cuts, strict=True):
        if len(feature) == 1:
            at += bins[feature[0]].take(rows) > cut[0]
            continue
        place = (feature * bins.shape[1]).take(at)
        place += rows
        right = flat.take(place) > cut.take(at)
        at += at
        at += right
    return at


def bin_sums(blocks, tree: int, features, cuts, slots: np.ndarray, width: int, settings: Settings) -> np.ndarray:
    """Rows and remainders per slot, feature and bin, then rows' squares per slot in a last feature: of the rows the tree sees."""
    out, size = None, int(slots.max() + 1) * width
    for number, bins, rest, _ in blocks:
        if out is None:
            out = np.zeros((2, len(bins) + 1, size))
        seen = np.random.default_rng((settings.seed, tree, number)).random(len(rest), np.float32) < settings.sampling
        rows = np.flatnonzero(seen)
        slot = slots.take(walk(bins, rows, features, cuts))
        if len(slots) > 1:
            inside = np.flatnonzero(slot >= 0)
            rows, slot = rows[inside], slot[inside]
        slot *= width
        value = rest[rows]
        for f, column in enumerate(bins):
            cell = slot + column.take(rows)
            out[0, f] += np.bincount(cell, minlength=size)
            out[1, f] += np.bincount(cell, value, size)
        out[1, -1] += np.bincount(slot, value * value, size)
    return out


def _summed(blocks: RDD, tree: int, features, cuts, slots: np.ndarray, width: int, settings: Settings) -> np.ndarray:
    def run(part):
        sums = bin_sums(part, tree, features, cuts, slots, width, settings)
        if sums is not None:
            yield sums

    total = None
    for part in blocks.mapPartitions(run).collect():        # as large as the nodes of a level, whatever the rows
        total = part if total is None else np.add(total, part, out=total)
    return total.reshape(2, total.shape[1], -1, width).transpose(2, 0, 1, 3)


def best_splits(sums: np.ndarray, cuts: list[np.ndarray], tree: int, level: int, settings: Settings):
    """Per node the feature and cut with the greatest gain among its share of features, and that gain (0: none)."""
    many = len(cuts)
    left = np.cumsum(sums[:, :, :many], axis=3)[..., :-1]
    whole = sums[:, :, :1].sum(axis=3, keepdims=True)
    right = whole - left
    allowed = np.zeros((len(sums), many, left.shape[3]), bool)
    share = min(many, ceil(settings.sampling * many))
    for node in range(len(sums)):
        allowed[node, np.random.default_rng((settings.seed, tree, level, node)).permutation(many)[:share]] = True
    for f, c in enumerate(cuts):
        allowed[:, f, len(c):] = False
    least = max(1, settings.min_rows)
    allowed &= (left[:, 0] >= least) & (right[:, 0] >= least)
    square = lambda part: part[:, 1] ** 2 / np.maximum(part[:, 0], 1)
    gain = np.where(allowed, square(left) + square(right) - square(whole), 0.0).reshape(len(sums), -1)
    best = gain.argmax(1)
    return best // left.shape[3], best % left.shape[3], gain[np.arange(len(sums)), best] / np.maximum(whole[:, 0, 0, 0], 1)


def grow(blocks: RDD, root: np.ndarray, cuts: list[np.ndarray], tree: int, width: int, settings: Settings) -> Tree:
    """A tree, level by level, from the sums of its root."""
    many, scale = len(cuts), 1.0 if tree == 0 else 2.0
    grown = Tree([], [], [], [], 1.0 if tree == 0 else settings.step_size, scale)
    stats = lambda s: np.stack([s[:, 0, 0].sum(1), s[:, 1, 0].sum(1), s[:, 1, many].sum(1)], axis=1)
    sums, alive = root, np.ones(1, bool)
    grown.stats.append(stats(root))
    for level in range(settings.max_depth):
        feature, cut, gain = best_splits(sums, cuts, tree, level, settings)
        split = alive & (gain > 0)
        if not split.any():
            break
        grown.features.append(np.where(split, feature, 0))
        grown.cuts.append(np.where(split, cut, STAY))
        grown.gains.append(np.where(split, gain, 0.0))
        # rows of the left children are known from the parents' sums
        nodes = np.arange(len(sums))
        lower = np.cumsum(sums[nodes, 0, feature], axis=1)[nodes, cut]
        small_left = lower * 2 <= grown.stats[-1][:, 0]
        parents = np.flatnonzero(split)
        small = 2 * parents + ~small_left[parents]
        slots = np.full(2 * len(sums), -1)
        slots[small] = np.arange(len(small))
        got = _summed(blocks, tree, grown.features, grown.cuts, slots, width, settings)
        below = np.zeros((2 * len(sums), *sums.shape[1:]))
        below[small] = got
        below[small ^ 1] = sums[parents] - got
        still = np.flatnonzero(~split)
        below[2 * still] = sums[still]
        sums, alive = below, np.repeat(split, 2)
        grown.stats.append(stats(sums))
    return grown


def errors_of(held: Blocks, trees: list[Tree]) -> list[float]:
    """Mean squared hold-out error after each of the trees, which the remainders follow."""
    if not held.rows:
        return [float("nan")] * len(trees)
    held.follow(trees)
    total = np.sum(held.now.map(lambda b: b[3]).collect(), axis=0)
    held.settled()
    return (total / held.rows).tolist()


def fit(rows: DataFrame, names: list[str], target: str, held: DataFrame | None, settings: Settings, best_prefix=None) -> tuple[list[Tree], list[np.ndarray]]:
    """The trees and the cuts their bins stand for. ``best_prefix`` tells from the hold-out errors (trees to keep, whether to stop)."""
    spark = rows.sparkSession
    cuts = quantile_cuts(rows, names, settings.max_bins)
    width = max(map(len, cuts)) + 1
    stored = lambda df, name: Blocks(materialize(binned(df, names, target, cuts), name), len(names))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    now, out = stored(rows, "boosting-blocks"), None if held is None else stored(held, "boosting-hold-out")
    trees, errors, keep, stop = [], [], 0, False
    try:
        while len(trees) < settings.max_iter and not stop:
            tree = len(trees)
            root = _summed(now.now, tree, [], [], np.zeros(1, np.int64), width, settings)
            now.settled()
            trees.append(grow(now.now, root, cuts, tree, width, settings))
            now.follow(trees[-1:])
            if out is not None and (len(trees) % EVERY == 0 or len(trees) == settings.max_iter):
                errors += errors_of(out, trees[len(errors):])
                keep, stop = best_prefix(errors)
    finally:
        for blocks in filter(None, (now, out)):
            blocks.close()
    return (trees if out is None else trees[:keep]), cuts


def node_rows(trees: list[Tree], cuts: list[np.ndarray]) -> Iterator[tuple]:
    """The nodes as Spark ML stores them: (tree, node), numbered so that a left child follows its parent."""

    def walk_down(tree: Tree, level: int, place: int, out: list) -> int:
        me = len(out)
        n, s, squares = tree.stats[level][place] * (1.0, tree.scale, tree.scale ** 2)
        mean = s / n if n else 0.0
        about = (float(mean), float(max(squares / n - mean * mean, 0.0) if n else 0.0), [float(n), float(s), float(squares)], int(n))
        out.append(None)
        if level < len(tree.features) and tree.cuts[level][place] != STAY:
            f = int(tree.features[level][place])
            left = walk_down(tree, level + 1, 2 * place, out)
            right = walk_down(tree, level + 1, 2 * place + 1, out)
            gain = float(tree.gains[level][place] * tree.scale ** 2)
            out[me] = (me, *about, gain, left, right, (f, [float(cuts[f][tree.cuts[level][place]])], -1))
        else:
            out[me] = (me, *about, -1.0, -1, -1, (-1, [], -1))
        return me

    for t, tree in enumerate(trees):
        out: list = []
        walk_down(tree, 0, 0, out)
        yield from ((t, node) for node in out)
