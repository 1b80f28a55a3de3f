"""Near-duplicate groups by MinHash with tensored banding, links confirmed on full shingle sets.

A document's set holds its distinct runs of five lower-cased words (all words as one where there are fewer), as 64-bit hashes.
Two collections of ``GROUPS`` small hashes, ``ROWS`` minhashes each, are computed per set; a table key combines
one hash of either collection, so 2 x 20 x 4 = 160 minhashes serve 20 x 20 = 400 tables of eight. A pair of
similarity s meets in some table with probability (1 - (1 - s^4)^20)^2: 0.999 at 0.75, 0.99999 at 0.85. A candidate pair meets in
a table and shares ``SHARED`` of all 40 small hashes (of which it shares 12.7 on average at 0.75, fewer than four in 3 of 10,000 cases).

Equal sets are one class before anything is compared. Only small hashes that two classes share are combined,
which loses no key that two classes share. Pairs are never listed within a bucket: every member is confirmed
against the first member of ``TRIES`` of its buckets (a common key is likeliest between close copies), and again
against other members where components still meet. What then still meets unconnected is
compared in full, minority against all, unless ``BITS`` parity bits rule it out: every hash flips one bit of its
set, so two sets differ in at least as many hashes as bits, and this test loses no link. So no candidate pair
across components stays untested, and components are those of all confirmed candidate links.
Components come from alternating star contraction over stored edge tables.

Defined results: documents without words or text, and rows without an id, are linked with nothing and kept;
rows of one id are one document, whose texts are linked with each other; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from wattfleet.session import materialize

SHINGLE = 5
GROUPS = 20
ROWS = 4
SHARED = 4
BITS = 1024
TRIES = 12
PERCENT = 75
SEED = 7
#: Shingles hashed at once, and words one task remembers.
BLOCK = 200_000
WORDS = 500_000

_RNG = np.random.default_rng(SEED)
_PLACE = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _RNG.integers(1, 1 << 63, 2 * GROUPS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, 2 * GROUPS * ROWS, dtype=np.uint64)
_JOIN = _RNG.integers(1, 1 << 63, (2 * GROUPS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sets of texts, with the hashes of words seen before."""

    def __init__(self):
        self.words: dict[bytes, int] = {}

    def set_of(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "replace").lower().split()
        if not found:
            return np.zeros(0, np.uint64)
        if len(found) < SHINGLE:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), len(found))], np.uint64)
        words = self.words
        for w in set(found):
            if w not in words:
                words[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
        if len(words) > WORDS:
            self.words = {}
        n = len(h) - SHINGLE + 1
        total = h[:n] * _PLACE[0]
        for j in range(1, SHINGLE):
            total += h[j:n + j] * _PLACE[j]
        return np.unique(_mixed(total))


def parity(sets: list[np.ndarray]) -> np.ndarray:
    """``BITS`` bits of each set, as longs: whether an odd number of its hashes falls on the bit."""
    at = np.concatenate([(s & np.uint64(BITS - 1)).astype(np.int64) + i * BITS for i, s in enumerate(sets)])
    odd = (np.bincount(at, minlength=len(sets) * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sets), BITS), axis=1).view(np.int64)


def small_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """The 2 x ``GROUPS`` small hashes of each non-empty set."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    least = np.empty((2 * GROUPS * ROWS, len(sets)), np.uint64)
    for f in range(len(least)):
        v = flat * _MULTIPLY[f]
        v += _ADD[f]
        v ^= v >> np.uint64(32)
        least[f] = np.minimum.reduceat(v, starts)
    grouped = (least.reshape(2 * GROUPS, ROWS, -1) * _JOIN[:, :, None]).sum(1, dtype=np.uint64)
    return _mixed(grouped + np.arange(2 * GROUPS, dtype=np.uint64)[:, None]).T.astype(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()

    def flush(ids, sets):
        filled = [s for s in sets if len(s)]
        hashes = iter(zip(small_hashes(filled), parity(filled), strict=True) if filled else ())
        made = [next(hashes) if len(s) else (None, None) for s in sets]
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids, pa.int64()), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "set_key": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
            "small": pa.array([m[0] for m in made], pa.list_(pa.int64())),
            "bits": pa.array([m[1] for m in made], pa.list_(pa.int64()))})

    ids, sets, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            s = shingler.set_of(text)
            ids.append(doc_id)
            sets.append(s)
            held += len(s)
            if held > BLOCK or len(ids) >= 5000:
                yield flush(ids, sets)
                ids, sets, held = [], [], 0
    if ids:
        yield flush(ids, sets)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            sets = [shingler.set_of(t).astype(np.int64) for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": part["doc_id"], "shingles": pa.array(sets, pa.list_(pa.int64()))})


def _contracted(edges: DataFrame) -> DataFrame:
    """Stars (``a`` under the least node ``b``) of the components of edges with ``a > b``; two joins a step."""
    edges = materialize(edges.distinct(), "edges")
    before = None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return edges
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        up = joined.where(F.col("b") != F.col("m")).select("a", F.col("m").alias("b"))
        edges = materialize(small.unionByName(up).distinct(), "edges")


def _similar_size(a: str, b: str):
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``x, y`` those whose sets are similar enough, as edges from the larger id to the smaller."""
    left = sets.select(F.col("id").alias("x"), F.col("shingles").alias("sx"))
    right = sets.select(F.col("id").alias("y"), F.col("shingles").alias("sy"))
    both = F.size(F.array_intersect("sx", "sy"))
    rows = pairs.join(left, "x").join(right, "y").where(100 * both >= PERCENT * (F.size("sx") + F.size("sy") - both))
    return rows.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def _labelled(rows: DataFrame, stars: DataFrame) -> DataFrame:
    """``rows`` with ``comp``, the least id of the component of ``id``."""
    return (rows.join(stars.select(F.col("a").alias("id"), F.col("b").alias("comp")), "id", "left")
            .withColumn("comp", F.coalesce("comp", "id")))


def _against(keys: DataFrame, salt: int) -> DataFrame:
    """Distinct pairs of each member with the first members of ``TRIES`` of its buckets, across components; ``salt`` orders both."""
    order = F.xxhash64(F.lit(salt), "id") if salt else F.col("id")
    pivot = keys.groupBy("key").agg(F.min_by(F.struct("id", "n", "comp"), order).alias("p"), F.count(F.lit(1)).alias("many")).where("many > 1")
    rows = keys.join(pivot, "key").where((F.col("comp") != F.col("p.comp")) & _similar_size("n", "p.n"))
    picks = rows.groupBy("id").agg(*[F.min_by("p.id", F.xxhash64("key", F.lit(salt * TRIES + i))).alias(f"p{i}") for i in range(TRIES)])
    picks = picks.select("id", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(TRIES)]))).alias("p"))
    return picks.select(F.greatest("id", "p").alias("x"), F.least("id", "p").alias("y")).distinct()


def _may_link(x: str, y: str) -> Column:
    """Whether the parity bits leave room for a link: sets that differ in d hashes have (n - d) / 2 of their n in common."""
    flips = [F.bit_count(F.get(f"{x}_bits", F.lit(i)).bitwiseXOR(F.get(f"{y}_bits", F.lit(i)))) for i in range(BITS // 64)]
    room = (100 + PERCENT) * sum(flips[1:], flips[0]) <= (100 - PERCENT) * (F.col(f"{x}_n") + F.col(f"{y}_n"))
    return F.coalesce(room, F.lit(True))


def _unmet(docs: DataFrame) -> DataFrame:
    """Candidate pairs across components that still share a table: in each bucket of the first collection
    the members outside its largest component against all, each pair in the least bucket that it shares."""
    spread = docs.select("*", F.explode("first").alias("g"))
    sizes = spread.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("g").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    open_ = spread.join(main, "g")
    few = open_.where(F.col("comp") != F.col("main")).select(*[F.col(c).alias(f"x_{c}") for c in ("id", "n", "comp", "first", "second", "bits")], "g")
    all_ = open_.select(*[F.col(c).alias(f"y_{c}") for c in ("id", "n", "comp", "first", "second", "bits", "main")], "g")
    once = (F.col("y_comp") == F.col("y_main")) | (F.col("x_id") < F.col("y_id"))
    least = F.array_min(F.array_intersect("x_first", "y_first")) == F.col("g")
    shared = F.size(F.array_intersect("x_first", "y_first")) + F.size(F.array_intersect("x_second", "y_second"))
    rows = few.join(all_, "g").where((F.col("x_comp") != F.col("y_comp")) & once & _similar_size("x_n", "y_n") & _may_link("x", "y")
                                     & F.arrays_overlap("x_second", "y_second") & (shared >= SHARED) & least)
    return rows.select(F.greatest("x_id", "y_id").alias("x"), F.least("x_id", "y_id").alias("y"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, set_key binary, small array<long>, bits array<long>"), "minhash")
    linked = rows.where("n_shingles > 0 and doc_id is not null")
    classes = linked.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("small").alias("small"), F.first("bits").alias("bits"), F.first("n_shingles").alias("n"))
    classes = materialize(classes, "classes")

    place = classes.select("id", "n", F.posexplode("small").alias("at", "g"))
    shared = place.groupBy("g").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("g")
    first = F.col("at") < GROUPS
    members = (place.join(shared, "g").groupBy("id", "n")
               .agg(F.collect_list(F.when(first, F.col("g"))).alias("first"), F.collect_list(F.when(~first, F.col("g"))).alias("second"))
               .where(f"size(first) > 0 and size(second) > 0 and size(first) + size(second) >= {SHARED}"))
    # an id of several texts has no bits of its own
    bits = classes.groupBy("id").agg(F.when(F.count(F.lit(1)) == 1, F.first("bits")).alias("bits"))
    members = materialize(members.join(bits, "id"), "members")
    keys = (members.select("id", "n", "second", F.explode("first").alias("g1")).select("id", "n", "g1", F.explode("second").alias("g2"))
            .select("id", "n", F.xxhash64("g1", "g2").alias("key")))
    keys = materialize(keys, "keys")

    pairs = _against(keys.withColumn("comp", F.col("id")), 0)
    sets = materialize(docs.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id").mapInArrow(_sets, "id long, shingles array<long>"), "sets")
    # texts that carry one id are one document
    same_id = linked.groupBy("doc_id").agg(F.min("set_key").alias("k"), F.max("set_key").alias("m")).where("k <> m").select("doc_id")
    by_id = linked.join(same_id, "doc_id").join(classes.select("set_key", "id"), "set_key").select("doc_id", "id").where("doc_id <> id")
    edges = _confirmed(pairs, sets).unionByName(by_id.select(F.greatest("doc_id", "id").alias("a"), F.least("doc_id", "id").alias("b")))
    stars = _contracted(edges)

    for more in (lambda: _against(_labelled(keys, stars), 1), lambda: _unmet(_labelled(members, stars))):
        found = materialize(_confirmed(materialize(more(), "pairs"), sets), "links")
        if not found.isEmpty():
            stars = _contracted(stars.unionByName(found))
    named = _labelled(classes.select("set_key", "id"), stars).select("set_key", "comp")
    component = F.coalesce("comp", F.col("doc_id")).alias("component_id")
    out = rows.join(named, "set_key", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, all columns kept."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
