"""Approximate nearest neighbours by low-dimensional stable projections indexed by kd-trees.

Unit vectors are projected on ``PROJECTIONS`` random normal directions. The squared projected distance of two vectors is their squared
distance times a chi-square variable, whatever the vectors. Candidates are verified in the order of their projected
distance, leaf by leaf of a kd-tree, until a candidate as near as the worst one held would have been met with ``CONFIDENCE``:
when the next projected distance squared reaches that chi-square quantile of the held distance squared. Each true neighbour
is missed with one minus that probability at most.

The upper levels of the tree are placed by a bounded sample and cut the projected space into cells, at most ``MAX_CELLS``; a cell of many
rows is dealt over several blocks by a hash of the id, so each task holds ``BLOCK_ROWS`` rows or so, and at most ``QUERY_ROWS`` or so queries. Every row is in
the index. A query first searches one block of its own cell. With the distances found it goes on to the blocks whose cells the same
stopping test does not rule out, and only there; the rows themselves are never paired.

Of equal vectors the ones with the smaller ids win all ties, so only the ``k + 1`` least ids of each vector are indexed (``k`` and perhaps the query itself): copies,
however many, cannot change a result, and they are cut down before the shuffle.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id, nor vectors
whose length is not the most frequent one (the longer, of equally frequent ones). An id that repeats counts once, with its least vector.
Without candidates a query has no rows. An empty table gives no rows. Other columns are not read, so none can clash.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wattfleet.session import materialize

PROJECTIONS = 8         # even, for the closed form of the quantile
CONFIDENCE = 0.98
BLOCK_ROWS = 4096
QUERY_ROWS = 4096
SAMPLE_ROWS = 16_384    # rows that place the cells
MAX_CELLS = 1024
LEAF = 96
#: Squared distance of vectors of one direction, given rounding; nearer ones are ties and always looked at.
SAME = 1e-12
SEED = 11


def chi_square_quantile(p: float, freedom: int) -> float:
    """Quantile for an even number of degrees of freedom."""
    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def stacked(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of equally long lists as one table of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, which loses no bit, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def projected(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / lengths(x)[:, None]) @ np.random.default_rng(SEED).standard_normal((x.shape[1], PROJECTIONS))


# ---- kd-trees -----------------------------------------------------------------

class Cells:
    """The upper levels: a cut of the widest dimension at the sample's median per node."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.dim, self.cut = np.zeros(1 << levels, int), np.zeros(1 << levels)
        groups = {1: sample}
        for node in range(1, 1 << levels):
            rows = groups.pop(node)
            if len(rows):
                self.dim[node] = d = int(np.argmax(rows.max(0) - rows.min(0)))
                self.cut[node] = np.median(rows[:, d])
            right = rows[:, self.dim[node]] >= self.cut[node]
            groups |= {2 * node: rows[~right], 2 * node + 1: rows[right]}

    def of(self, z: np.ndarray) -> np.ndarray:
        node = np.ones(len(z), int)
        for _ in range(self.levels):
            node = 2 * node + (z[np.arange(len(z)), self.dim[node]] >= self.cut[node])
        return node - (1 << self.levels)


class KdTree:
    """The lower levels, inside one block: boxes of nodes, and rows in the order of leaves."""

    def __init__(self, z: np.ndarray):
        self.order = np.arange(len(z))
        self.nodes: list[tuple[np.ndarray, np.ndarray, int, int, int, int]] = []     # low, high, first, end, left, right
        if len(z):
            self._grow(z, 0, len(z))

    def _grow(self, z: np.ndarray, s: int, e: int) -> int:
        own = z[self.order[s:e]]
        low, high = own.min(0), own.max(0)
        at = len(self.nodes)
        self.nodes.append((low, high, s, e, -1, -1))
        if e - s > LEAF:
            mid = (e - s) // 2
            self.order[s:e] = self.order[s:e][np.argpartition(own[:, int(np.argmax(high - low))], mid)]
            self.nodes[at] = (low, high, s, e, self._grow(z, s, s + mid), self._grow(z, s + mid, e))
        return at

    def gap(self, node: int, q: np.ndarray) -> float:
        """Squared projected distance from ``q`` to the node's box."""
        low, high = self.nodes[node][:2]
        d = np.maximum(np.maximum(low - q, q - high), 0)
        return float(d @ d)

    def leaves(self, q: np.ndarray):
        """Leaves in the order of their distance from ``q``: the distance, first and last row."""
        heap = [(self.gap(0, q), 0)] if self.nodes else []
        while heap:
            gap, node = heapq.heappop(heap)
            _, _, s, e, left, right = self.nodes[node]
            if left < 0:
                yield gap, s, e
            else:
                heapq.heappush(heap, (self.gap(left, q), left))
                heapq.heappush(heap, (self.gap(right, q), right))


class Block:
    """Rows of one block with their tree."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, z: np.ndarray):
        self.tree = KdTree(z)
        self.ids, x = ids[self.tree.order], scaled(x[self.tree.order])
        self.x, self.size = x, lengths(x)

    def nearest(self, q: np.ndarray, z: np.ndarray, k: int, bound: float, stop: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the ``k`` best found. ``bound``: a squared distance that ``k`` rows elsewhere reach."""
        q = scaled(q[None])[0]
        size = math.sqrt(float((q * q).sum()))
        ids, best = np.zeros(0, np.int64), np.zeros(0)
        for gap, s, e in self.tree.leaves(z):
            held = min(bound, 2 - 2 * best[-1]) if len(best) == k else bound
            if gap >= stop * max(held, SAME):
                break
            score = (self.x[s:e] * q).sum(axis=1) / (self.size[s:e] * size)
            near = score >= best[-1] if len(best) == k else np.ones(e - s, bool)
            if near.any():
                ids, best = np.concatenate([ids, self.ids[s:e][near]]), np.concatenate([best, score[near]])
                first = np.lexsort((ids, -best))[:k]
                ids, best = ids[first], best[first]
        return ids, best


# ---- jobs ---------------------------------------------------------------------

def valid(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v`` of the rows that take part but for their length."""
    v = F.col(vector)
    known = lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return rows.where(F.col(id_col).isNotNull() & F.forall(v, known) & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _placed(rows: DataFrame, cells: Cells, dims: int) -> DataFrame:
    """``rows`` of one vector per id with their projection and cell."""
    sent = rows.sparkSession.sparkContext.broadcast(cells)      # at most MAX_CELLS cuts

    def run(batches):
        for batch in batches:
            z = projected(stacked(batch["v"], dims))
            ends = pa.array(np.arange(len(z) + 1, dtype=np.int32) * PROJECTIONS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(ends, pa.array(z.ravel())), pa.array(sent.value.of(z), pa.int64())],
                [*batch.schema.names, "z", "cell"])

    kind = rows.schema["v"].dataType.simpleString()
    return rows.select("vec_id", "v").mapInArrow(run, f"vec_id long, v {kind}, z array<double>, cell long")


def _search(blocks: DataFrame, targets: DataFrame, dims: int, k: int, stop: float) -> DataFrame:
    """``query_id, vec_id, score``: the ``k`` best of each block for each query sent to it.

    A block is repeated once for each chunk of queries that it gets any of.
    """
    wanted = targets.select(F.col("block").alias("at"), F.col("chunk").alias("part")).distinct()
    data = blocks.select("block", "vec_id", "v", "z").join(wanted, F.col("block") == F.col("at"))

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        queries = right["query_id"].to_numpy()
        if left.num_rows and right.num_rows:
            block = Block(left["vec_id"].to_numpy(), stacked(left["v"], dims), stacked(left["z"], PROJECTIONS))
            for q, z, bound in zip(stacked(right["v"], dims), stacked(right["z"], PROJECTIONS), right["bound"].to_numpy(), strict=True):
                found.append(block.nearest(q, z, k, float(bound), stop))
        counts = [len(i) for i, _ in found]
        flat = lambda c, kind: np.concatenate([f[c] for f in found]) if found else np.zeros(0, kind)
        return pa.table({"query_id": np.repeat(queries[:len(counts)], counts).astype(np.int64), "vec_id": flat(0, np.int64), "score": flat(1, float)})

    return data.groupBy("at", "part").cogroup(targets.groupBy("block", "chunk")).applyInArrow(run, "query_id long, vec_id long, score double")


def nearest(
    rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", confidence: float = CONFIDENCE,
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found for each row that is a query, by cosine.

    ``is_query`` reads the column ``vec_id``.
    """
    spark, every = rows.sparkSession, valid(rows, id_col, vector)
    shape = every.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, count = shape["dims"], shape["n"]
    every = every.where(F.size("v") == dims)
    picked = every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toPandas()["v"]       # SAMPLE_ROWS rows
    levels = min(max(math.ceil(math.log2(count / block_rows)), 0), int(math.log2(MAX_CELLS)))
    cells = Cells(projected(np.stack(picked.to_numpy()).astype(float)), levels)

    one = every.groupBy("vec_id").agg(F.min("v").alias("v"))
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    index = materialize(_placed(one.withColumn("__n", F.row_number().over(same)).where(F.col("__n") <= k + 1), cells, dims), "vectors")
    asked = materialize(_placed(one.where(is_query), cells, dims).withColumnRenamed("vec_id", "query_id"), "queries")

    edge = lambda f, j: f(F.get("z", F.lit(j)))
    boxes = index.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), *[edge(f, j).alias(f"{m}{j}") for m, f in (("low", F.min), ("high", F.max)) for j in range(PROJECTIONS)]
    ).orderBy("cell").toPandas()                                       # MAX_CELLS rows at most
    boxes["blocks"] = np.maximum(1, -(-boxes["n"] // block_rows)).astype("int64")
    boxes["first"] = np.cumsum(boxes["blocks"]) - boxes["blocks"]
    per_cell = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}
    parts = {c: -(-n // query_rows) for c, n in per_cell.items()}
    chunks, fill, chunk = [], 0, 0
    for c in sorted(per_cell):                                          # neighbouring cells share a chunk
        if fill and fill + per_cell[c] > query_rows:
            chunk, fill = chunk + 1, 0
        chunks.append((int(c), chunk, parts[c]))
        chunk, fill = (chunk, fill + per_cell[c]) if parts[c] == 1 else (chunk + parts[c], 0)
    place = spark.createDataFrame([(int(r.cell), int(r.first), int(r.blocks)) for r in boxes[["cell", "first", "blocks"]].itertuples(index=False)],
                                  "cell long, first long, blocks long")
    dealt = lambda c, n: F.pmod(F.xxhash64(F.lit(SEED), c), n)
    blocks = index.join(F.broadcast(place), "cell").withColumn("block", F.col("first") + dealt(F.col("vec_id"), F.col("blocks")))
    share = spark.createDataFrame(chunks, "cell long, chunk long, parts long")
    asked = asked.join(F.broadcast(share), "cell").join(F.broadcast(place), "cell", "left").select(
        "query_id", "v", "z", (F.col("chunk") + dealt(F.col("query_id"), F.col("parts"))).alias("chunk"),
        (F.coalesce("first", F.lit(0)) + dealt(F.col("query_id"), F.coalesce("blocks", F.lit(1)))).alias("home"))

    stop = chi_square_quantile(confidence, PROJECTIONS)
    home = materialize(_search(blocks, asked.withColumns({"block": F.col("home"), "bound": F.lit(float("inf"))}), dims, k + 1, stop), "home")
    held = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) > k, 2 - 2 * F.min("score")).alias("bound"))
    targets = _reached(asked.join(held, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), boxes, stop)
    found = home.unionByName(_search(blocks, materialize(targets, "targets"), dims, k + 1, stop))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.where("vec_id <> query_id").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _reached(asked: DataFrame, boxes, stop: float) -> DataFrame:
    """Queries once for each block, but their home, in whose cell the stopping test leaves anything to find."""
    edges = [boxes[[f"{m}{j}" for j in range(PROJECTIONS)]].to_numpy(float) for m in ("low", "high")]
    sent = asked.sparkSession.sparkContext.broadcast((*edges, boxes["first"].to_numpy(), boxes["blocks"].to_numpy()))     # MAX_CELLS rows
    names = [c for c in asked.columns]

    def run(batches):
        low, high, first, blocks = sent.value
        for batch in batches:
            z, bound = stacked(batch["z"], PROJECTIONS), batch["bound"].to_numpy()
            lists = []
            for q, b in zip(z, bound, strict=True):
                gap = np.maximum(np.maximum(low - q, q - high), 0)
                open_ = np.flatnonzero((gap * gap).sum(axis=1) < stop * max(b, SAME))
                lists.append(np.concatenate([np.arange(first[c], first[c] + blocks[c]) for c in open_]) if len(open_) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(lists, pa.list_(pa.int64()))], [*names, "__blocks"])

    kinds = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in names)
    out = asked.mapInArrow(run, f"{kinds}, __blocks array<long>")
    return out.withColumn("block", F.explode("__blocks")).where("block <> home").drop("__blocks")


def report(rows: DataFrame) -> DataFrame:
    """Every row whose id is divisible by 50 against all other rows."""
    return nearest(rows, F.col("vec_id") % 50 == 0).withColumn("rank", F.col("rank").cast("int"))
