"""Brown class-based bigrams: word classes by exchange clustering, smoothed log-probabilities of texts.

P(w | v) = P(class of w | class of v) x P(w | class of w). Every word counted at least ``LEAST`` times is a unit of
its own, so the units grow with the vocabulary; the tail, seen or not, is the unit of its ending (``ENDINGS`` hashed
endings), so that every word has a class. Exchange clustering moves units between ``CLASSES`` classes while that raises the
likelihood of the unit bigrams of the whole training corpus: one by one on the driver for the ``WORDS`` most frequent
words and the endings, which gives the first classes, then all units at once in tasks, each against the table of
class bigrams, until a sweep adds less than ``RISE`` of the information between neighbouring classes.

Inside a class words are discounted by ``DISCOUNT``; what that frees is the one unseen word of the class, as
the base model gives its one unseen word a share. Class transitions are smoothed by a half count.

Words are counted over the whole corpus. The ``FREQUENT`` most frequent ones travel to the tasks with their counts, up to ``KNOWN``
units as a table of hashes with classes; counts of the others, and classes of units beyond ``KNOWN``, are joined,
so no unbounded table is broadcast and no frequent word makes a hot key.

Defined results: null and empty texts hold the end token alone; rows without an id teach nothing and are not held out;
with nothing to learn from every count is 0; repeated rows are each scored; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from wattfleet.llm.common import TEXT_BYTES, crc_fold
from wattfleet.session import materialize, scratch_path

FOLDS, HELD_OUT = 7, 2
LEAST = 10
WORDS = 1024
ENDINGS = 512
#: Units whose hashes and classes travel to the tasks, at most; those beyond are joined.
KNOWN = 1 << 20
RISE = 0.005
CLASSES = 64
SWEEPS = 8
FREQUENT = 1 << 16
#: Words longer than this are never in the frequent table, which bounds its size.
LONGEST = 64
DISCOUNT = 0.75
#: Bytes of distinct words with their counts that one task merges before it hands them on.
TABLE = 12 << 20
#: Bytes of texts whose words a task numbers at once, and characters of words, and a share for each, that it remembers the units of.
MEMO = 3 << 20
#: Tokens whose bigrams a task sums at once, and bigrams that it holds.
PAIRS = 2_000_000
#: Tokens that one cell of bigrams stands for; a cell is summed by one task.
CELL_TOKENS = 1_500_000
#: Words of more bytes are hashed one by one.
LONG = 1024
#: Neighbours in one partition of the sides of units, at most; each is written as one row group, so no unit is split on reading.
SIDE_ROWS = 2_000_000
#: The end token, which no word equals.
END = ""


def byte_words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, without the end, in UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().split()


def tokens(text: str | None) -> list[str]:
    """``byte_words`` as text."""
    return [w.decode("utf-8") for w in byte_words(text)]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``tokens`` of many texts one after the other, an end after each; the number of each text's."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    # what follows the last blank is empty, as the end is
    blank = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ")
    words = pc.ascii_split_whitespace(pc.binary_join_element_wise(texts, blank, ""))
    return words.flatten(), words.value_lengths().to_numpy()


def release() -> None:
    """Gives back what Arrow keeps for later: a worker may wait long for its next task."""
    pa.default_memory_pool().release_unused()


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of some ``MEMO`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > MEMO:
            batch, held, size = pa.concat_batches(held), [], 0      # nothing is kept twice meanwhile
            yield batch
    if held:
        batch, held = pa.concat_batches(held), []
        yield batch
        del batch
    release()


def ending(word: str) -> int:
    """The unit of a word that has none of its own."""
    return zlib.crc32(word[-2:].encode()) % ENDINGS


def endings(words: pa.Array) -> np.ndarray:
    """``ending`` of many words."""
    last = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
    return np.array([ending(w) for w in last.dictionary.to_pylist()], np.int64)[last.indices.to_numpy()]


def hashes(words: pa.Array, seed: int) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time; of the ``LONG`` ones by the library."""
    starts = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[starts[0]:starts[-1]]
    data, starts = np.concatenate((data, np.zeros(8, np.uint8))), starts - starts[0]
    blocks, sizes = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)), np.diff(starts)
    inside = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    h = (sizes.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    rows, at = np.flatnonzero((sizes > 0) & (sizes <= LONG)), 0
    while len(rows):
        left = sizes[rows] - at
        x = (h[rows] ^ (blocks[starts[rows] + at] & inside[np.minimum(left, 8)])) * np.uint64(0xBF58476D1CE4E5B9)
        h[rows] = x ^ (x >> np.uint64(29))
        rows, at = rows[left > 8], at + 8
    for i in np.flatnonzero(sizes > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i]:starts[i + 1]].tobytes(), seed)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def codes(words: pa.Array) -> np.ndarray:
    """A negative number for each word: 53 bits of a hash, then its ending."""
    return -1 - ((hashes(words, 1) & np.uint64((1 << 53) - 1)).astype(np.int64) * ENDINGS + endings(words))


def checks(words: pa.Array) -> np.ndarray:
    """A second hash of each word, which tells words of one code apart."""
    return hashes(words, 1 << 32).view(np.int64)


def _ending_of(codes):
    return (-1 - codes) % ENDINGS


class Units:
    """Units of words: endings first, then the known words by code; codes stand for words that may be units beyond ``KNOWN``."""

    def __init__(self, codes: np.ndarray, whole: bool):
        self.codes, self.whole = np.sort(codes), whole
        self.forget()

    def forget(self) -> None:
        """Start the memory anew."""
        self.memo, self.held = {}, 0

    def __getstate__(self):
        return {"codes": self.codes, "whole": self.whole}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def named(self, words: pa.Array) -> np.ndarray:
        return self.coded(codes(words))

    def of(self, words: list[str]) -> np.ndarray:
        if self.held > MEMO:
            self.memo, self.held = {}, 0
        memo = self.memo
        new = [w for w in set(words) if w not in memo]
        if new:
            self.held += sum(map(len, new)) + 140 * len(new)
            memo.update(zip(new, self.named(pa.array(new, pa.string())).tolist(), strict=True))
        return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))

    def coded(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, codes)
        hit = np.zeros(len(codes), bool)
        inside = at < len(self.codes)
        hit[inside] = self.codes[at[inside]] == codes[inside]
        return np.where(hit, ENDINGS + at, _ending_of(codes) if self.whole else codes)

    def get(self, word: str, default: int) -> int:
        unit = int(self.of([word])[0])
        return unit if unit >= ENDINGS else default


def numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts; their numbers, text after text, an end after each; the texts' lengths."""
    words, long = split(texts)
    words = words.dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), long


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[pa.Array, np.ndarray]] = []

    def merged():
        if len(held) == 1:
            return held[0]
        words = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
        return words.dictionary, np.bincount(words.indices.to_numpy(), np.concatenate([c for _, c in held])).astype(np.int64)

    size = lambda: sum(w.nbytes + c.nbytes for w, c in held)
    out = lambda words, c: pa.RecordBatch.from_arrays([words, pa.array(c)], ["word", "c"])
    for batch in gathered(batches):
        words, at, _ = numbered(batch["text"])
        held.append((words, np.bincount(at, minlength=len(words))))
        if size() > TABLE:
            held[:] = [merged()]
            if size() > TABLE // 2:
                yield out(*held.pop())
    if held:
        yield out(*merged())


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: exchange clustering of a units x units count matrix.

    Units start in classes by frequency rank. In each sweep every unit, the most frequent first, leaves its class and
    enters the one where the likelihood is greatest, its own at a tie; the end comes with a sweep without a move.
    """
    b = np.asarray(bigrams, float)
    weight = b.sum(0) + b.sum(1)
    order = np.argsort(-weight, kind="stable")
    of = np.empty(len(b), np.int64)
    of[order] = np.arange(len(b)) % classes
    hot = np.eye(classes)[of]
    after, before = b @ hot, b.T @ hot
    n = hot.T @ after
    own = np.diag(b)
    d = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not weight[w]:
                break
            a, self_ = of[w], own[w]
            s, p = after[w].copy(), before[w].copy()
            s[a] -= self_
            p[a] -= self_
            n[a] -= s
            n[:, a] -= p
            n[a, a] -= self_
            # totals with the unit's neighbours in place, which they are whatever class it enters
            rows, cols = n.sum(1) + p, n.sum(0) + s
            f = _plogp(n)
            down, across = _plogp(n + s) - f, _plogp(n + p[:, None]) - f
            gain = down.sum(1) - down[d, d] + across.sum(0) - across[d, d]
            gain += _plogp(n[d, d] + s + p + self_) - f[d, d]
            gain -= _plogp(rows + s.sum() + self_) - _plogp(rows) + _plogp(cols + p.sum() + self_) - _plogp(cols)
            best = int(np.argmax(gain))
            if gain[best] <= gain[a] + 1e-9:
                best = a
            n[best] += s
            n[:, best] += p
            n[best, best] += self_
            if best != a:
                moved += 1
                of[w] = best
                for table, column in ((after, b[:, w]), (before, b[w])):
                    table[:, a] -= column
                    table[:, best] += column
        if not moved:
            break
    return of


def best_class(n: np.ndarray, a: int, s: np.ndarray, p: np.ndarray, self_: float) -> int:
    """Where the likelihood is greatest for one unit of class ``a``, which has counts ``s`` after and ``p`` before it by class."""
    s, p = s.astype(float), p.astype(float)
    s[a] -= self_
    p[a] -= self_
    rows, cols, d = n.sum(1), n.sum(0), np.arange(len(n))
    rows[a] -= s.sum() + self_
    cols[a] -= p.sum() + self_
    rows, cols = rows.clip(0), cols.clip(0)
    gain = np.zeros(len(n))
    diag = n[d, d].copy()
    diag[a] -= s[a] + p[a] + self_
    for table, k, other in ((n, s, p), (n.T, p, s)):
        at = np.flatnonzero(k)
        if len(at):
            f = table[:, at].copy()
            f[a] -= k[at]
            hit = np.flatnonzero(at == a)
            if len(hit):
                f[:, hit[0]] -= other
                f[a, hit[0]] -= self_
            f = f.clip(0)
            grown = _plogp(f + k[at]) - _plogp(f)
            gain += grown.sum(1)
            gain[at] -= grown[at, np.arange(len(at))]
    diag = diag.clip(0)
    gain += _plogp(diag + s + p + self_) - _plogp(diag)
    gain -= _plogp(rows + s.sum() + self_) - _plogp(rows) + _plogp(cols + p.sum() + self_) - _plogp(cols)
    best = int(np.argmax(gain))
    return best if gain[best] > gain[a] + 1e-9 else a


def _likelihood(n: np.ndarray) -> float:
    return _plogp(n).sum() - _plogp(n.sum(0)).sum() - _plogp(n.sum(1)).sum()


def _summed(keys: list[np.ndarray], k: np.ndarray) -> list[np.ndarray]:
    """Distinct rows of ``keys`` with their summed ``k``."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    keys = [x[order] for x in keys]
    new = np.ones(len(k), bool)
    if len(k):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
    at = np.flatnonzero(new)
    return [*(x[at] for x in keys), np.add.reduceat(k[order], at) if len(at) else k[:0]]


def _merged(runs: Iterator[list[np.ndarray]], most: int) -> Iterator[list[np.ndarray]]:
    """Runs of distinct keys with their numbers, added up; what stays distinct beyond ``most`` rows is handed on."""
    held, size = [], 0

    def closed():
        *keys, k = (np.concatenate(c) for c in zip(*held, strict=True))
        return _summed(keys, k) if len(held) > 1 else [*keys, k]

    for run in runs:
        held.append(run)
        size += len(run[0])
        if size > 2 * most:
            held[:] = [closed()]
            size = len(held[0][0])
            if size > most:
                yield held.pop()
                size = 0
    if held:
        yield closed()


def _tallied(keys: np.ndarray) -> list[np.ndarray]:
    """Distinct ``keys``, which are put in order, with their numbers."""
    keys.sort()
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return [keys[at], np.diff(at, append=len(keys))]


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 500_000) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            held, n = [], 0
    if n:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in columns.items()})


def best_classes(n: np.ndarray, own: np.ndarray, s: np.ndarray, p: np.ndarray, self_: np.ndarray) -> np.ndarray:
    """``best_class`` of many units: row i of ``s`` and ``p`` has the counts after and before unit i by class."""
    units, d = np.arange(len(own)), np.arange(len(n))
    s, p = s.astype(float), p.astype(float)
    s[units, own] -= self_
    p[units, own] -= self_
    out, into = s.sum(1), p.sum(1)
    rows, cols, diag = (np.repeat(x[None], len(own), 0) for x in (n.sum(1), n.sum(0), n[d, d]))
    rows[units, own] -= out + self_
    cols[units, own] -= into + self_
    diag[units, own] -= s[units, own] + p[units, own] + self_
    rows, cols, diag = rows.clip(0), cols.clip(0), diag.clip(0)
    gain = _plogp(diag + s + p + self_[:, None]) - _plogp(diag)
    gain -= _plogp(rows + (out + self_)[:, None]) - _plogp(rows) + _plogp(cols + (into + self_)[:, None]) - _plogp(cols)
    for table, k, other in ((n.T, s, p), (n, p, s)):
        i, c = np.nonzero(k)
        if not len(i):
            continue
        k, a, t = k[i, c], own[i], np.arange(len(i))
        # most units have the same few counts next to a class: what those add is worked out once
        alike, same = np.unique(c * (k.max() + 1) + k, return_inverse=True)
        of, by = np.divmod(alike, k.max() + 1)
        of = of.astype(np.int64)
        grown = (_plogp(table[of] + by[:, None]) - _plogp(table)[of])[same]
        f = (table[c, a] - k).clip(0)               # the class a unit is in has lost it
        grown[t, a] = _plogp(f + k) - _plogp(f)
        inside = np.flatnonzero(c == a)             # next to its own class it loses its other side as well
        f = table[c[inside]] - other[i[inside]]
        f[np.arange(len(inside)), a[inside]] -= k[inside] + self_[i[inside]]
        f = f.clip(0)
        grown[inside] = _plogp(f + k[inside, None]) - _plogp(f)
        grown[t, c] = 0
        starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
        gain[i[starts]] += np.add.reduceat(grown, starts, axis=0)
    best = gain.argmax(1)
    return np.where(gain[units, best] > gain[units, own] + 1e-9, best, own)


def _chosen(batches: Iterator[pa.RecordBatch], of: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Better classes of the units of ``stored_sides``, all rows of a unit next to each other."""
    width = 2 * CLASSES + 1
    last, left = -1, np.zeros(width)

    def judged(unit: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        own = of[unit]
        to = np.concatenate([best_classes(n, own[i:i + 2000], *(counts[i:i + 2000, x] for x in (slice(CLASSES), slice(CLASSES, -1), -1)))
                             for i in range(0, len(unit), 2000)]) if len(unit) else own
        return _batch(unit=unit[to != own], cls=to[to != own])

    for unit, side, other, k in _unfolded(batches):
        new = np.concatenate(([unit[0] != last], unit[1:] != unit[:-1]))
        at = np.cumsum(new)                                     # 0: the unit that the rows before ended with
        names = np.concatenate(([last], unit[new]))
        cell = np.where(side == 2, 2 * CLASSES, side * CLASSES + of[other])
        counts = np.bincount(at * width + cell, k, len(names) * width).reshape(-1, width)
        counts[0] += left
        last, left = int(names[-1]), counts[-1].copy()
        yield judged(names[:-1][names[:-1] >= 0], counts[:-1][names[:-1] >= 0])
    if last >= 0:
        yield judged(np.array([last]), left[None])


def _folded(unit: np.ndarray, side: int, other: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(unit << 32 | other)
    unit = unit[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(unit)), bool), unit[1:] != unit[:-1])))
    ends = pa.array(np.append(starts, len(unit)).astype(np.int32))
    lists = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (other[order].astype(np.int32), k[order]))
    return pa.RecordBatch.from_arrays([pa.array(unit[starts]), pa.array(np.full(len(starts), side, np.int32)), *lists], ["unit", "side", "other", "k"])


def _sides(a: np.ndarray, b: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
    me = a == b
    yield from (_folded(a, 0, b, k), _folded(b, 1, a, k), _folded(a[me], 2, a[me], k[me]))


def _unfolded(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[list[np.ndarray]]:
    """Columns of ``stored_sides``, one place for each neighbour."""
    held, n = [], 0
    for batch in batches:
        long = batch["other"].value_lengths().to_numpy()
        held.append([*(np.repeat(batch[c].to_numpy(), long) for c in ("unit", "side")), *(batch[c].flatten().to_numpy() for c in ("other", "k"))])
        n += len(held[-1][0])
        if n >= rows:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]
    release()


SIDES = "unit long, side int, other array<int>, k array<long>"


class Cells:
    """Bigrams on their way to the sum: a grid of ``side`` by ``side`` cells, by first and second unit, so that no frequent unit fills one
    cell and the bigrams of a unit meet in few. A bigram is one number: cell, first and second unit."""

    def __init__(self, units: int, n: int):
        """``n`` tokens, of so many units."""
        self.bits = units.bit_length()
        self.side = min(math.isqrt(n // CELL_TOKENS) + 1, 1 << (63 - 2 * self.bits) // 2)

    def keys(self, texts: pa.Array, units: Units) -> np.ndarray:
        words, at, _ = numbered(texts)
        unit = units.named(words)
        first, second = (unit % self.side * self.side << 2 * self.bits) + (unit << self.bits), (unit % self.side << 2 * self.bits) + unit
        return first[np.concatenate((at[-1:], at[:-1]))] + second[at]       # every text ends with the end, which the next one follows

    def packed(self, keys: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``cell, a, b, k`` of ordered keys, one row for each cell, a part of them in one batch."""
        cell, unit = keys >> 2 * self.bits, (1 << self.bits) - 1
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), cell[1:] != cell[:-1])))
        ends = pa.array(np.append(starts, len(keys)).astype(np.int32))
        lists = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((keys >> self.bits & unit).astype(np.int32), (keys & unit).astype(np.int32), k))
        rows = pa.RecordBatch.from_arrays([pa.array(cell[starts].astype(np.int32)), *lists], ["cell", "a", "b", "k"])
        for i in range(0, len(starts), step := 1 + len(starts) * PAIRS // (8 * len(keys) + 1)):
            yield rows.slice(i, step)

    def summed(self, bigrams: DataFrame) -> DataFrame:
        """Sides of the ``packed`` bigrams of many tasks."""
        bits = self.bits

        def run(batches):
            for a, b, k in ((batch[c].flatten().to_numpy().astype(np.int64) for c in "abk") for batch in batches):
                yield [a << bits | b, k]
            release()

        def sides(batches):
            for ab, k in _merged(run(batches), PAIRS // 2):
                for i in range(0, len(ab), part := PAIRS // 4):
                    yield from _sides(ab[i:i + part] >> bits, ab[i:i + part] & (1 << bits) - 1, k[i:i + part])

        return bigrams.repartitionById(self.side * self.side, "cell").mapInArrow(sides, SIDES)


def stored_sides(bigrams: DataFrame, rows: int) -> DataFrame:
    """``unit, side, other, k``, ordered by unit: arrays of what follows each unit (side 0), what precedes it (1), and itself (2), with counts.

    ``rows`` is a bound of the bigrams. A unit has one row of each side for each run of bigrams it occurs in, so that few bytes of a neighbour are moved.
    """
    def sides(batches):
        for a, b, k in _chunks(batches):
            yield from _sides(a, b, k)

    bigrams.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))
    return _stored(bigrams.mapInArrow(sides, SIDES), rows)


def _stored(sides: DataFrame, rows: int) -> DataFrame:
    spark, dealt = sides.sparkSession, sides.repartition(-(-2 * rows // SIDE_ROWS) or 1, "unit")
    path = scratch_path(spark, "sides")
    dealt.sortWithinPartitions("unit").write.option("parquet.block.size", 512 << 20).parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def following(sides: DataFrame) -> DataFrame:
    """The bigrams ``a, b, k`` that the sides were stored from."""
    rows = sides.where("side = 0").select(F.col("unit").alias("a"), F.inline(F.arrays_zip("other", "k")))
    return rows.select("a", F.col("other").cast("long").alias("b"), "k")


class Clusters:
    """Bigrams ``a, b, k`` of units and the class of each: ``of`` for endings and known units, ``beyond`` (code, cls) for the others, if any."""

    def __init__(self, bigrams: DataFrame, of: np.ndarray, beyond: DataFrame | None, sides: DataFrame | None = None):
        self.bigrams, self.of, self.beyond, self.sides = bigrams, of, beyond, sides
        self.sent = bigrams.sparkSession.sparkContext.broadcast(of.astype(np.int16))      # bounded by KNOWN

    def classed(self) -> DataFrame:
        """``a, b, k, ca, cb``; classes of known units are -1 and looked up in the tasks."""
        rows = self.bigrams
        for unit, cls in (("a", "ca"), ("b", "cb")):
            none = rows if self.beyond is None else rows.where(F.col(unit) >= 0)
            none = none.withColumn(cls, F.lit(-1).cast("long"))
            if self.beyond is not None:
                named = self.beyond.select(F.col("code").alias(unit), F.col("cls").alias(cls))
                none = none.unionByName(rows.where(F.col(unit) < 0).join(named, unit))
            rows = none
        return rows.select("a", "b", "k", "ca", "cb")

    def table(self) -> np.ndarray:
        """Class x class counts."""
        sent = self.sent

        def folded(batches):
            n = np.zeros(CLASSES * CLASSES)
            for a, _, b, k in _unfolded(batches):
                n += np.bincount(sent.value[a].astype(np.int64) * CLASSES + sent.value[b], k, len(n))
            at = np.flatnonzero(n)
            yield _batch(cell=at, k=n[at].astype(np.int64))

        def run(batches):
            n = np.zeros(CLASSES * CLASSES, np.int64)
            for a, b, k, ca, cb in _chunks(batches):
                ca, cb = (np.where(u >= 0, sent.value[np.maximum(u, 0)], c) for u, c in ((a, ca), (b, cb)))
                n += np.bincount(ca.astype(np.int64) * CLASSES + cb, k, len(n)).astype(np.int64)
            at = np.flatnonzero(n)
            yield _batch(cell=at, k=n[at])

        if self.sides is not None:
            sums = self.sides.where("side = 0").mapInArrow(folded, "cell long, k long")
        else:
            sums = self.classed().mapInArrow(run, "cell long, k long")
        got = sums.groupBy("cell").agg(F.sum("k").alias("k")).toArrow()
        n = np.zeros(CLASSES * CLASSES)
        n[got["cell"].to_numpy()] = got["k"].to_numpy()
        return n.reshape(CLASSES, CLASSES)

    def moves(self, n: np.ndarray) -> DataFrame:
        """``unit, cls`` of the units that would be better off in another class, with all others where they are."""
        sent = self.sent
        if self.sides is not None:
            return self.sides.mapInArrow(lambda batches: _chosen(batches, sent.value.astype(np.int64), n), "unit long, cls long")

        def sides(batches):
            for a, b, k, ca, cb in _chunks(batches):
                ca, cb = (np.where(u >= 0, sent.value[np.maximum(u, 0)], c).astype(np.int64) for u, c in ((a, ca), (b, cb)))
                me = a == b
                unit, own, cell, k = _summed([np.concatenate(x) for x in (
                    (a, b, a[me]), (ca, cb, ca[me]), (cb, CLASSES + ca, np.full(me.sum(), 2 * CLASSES)))], np.concatenate((k, k, k[me])))
                yield _batch(unit=unit, own=own, cell=cell, k=k)

        def choose(batches):
            left = [np.zeros(0, np.int64)] * 4

            def best(rows):
                unit, own, cell, k = rows
                starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1]))) if len(unit) else np.zeros(0, np.int64)
                out = []
                for i, j in zip(starts, [*starts[1:], len(unit)], strict=True):
                    c = np.bincount(cell[i:j], k[i:j], 2 * CLASSES + 1)
                    to = best_class(n, int(own[i]), c[:CLASSES], c[CLASSES:-1], c[-1])
                    if to != own[i]:
                        out.append((unit[i], to))
                return _batch(unit=[u for u, _ in out], cls=[c for _, c in out])

            for rows in _chunks(batches, 100_000):
                rows = [np.concatenate(x) for x in zip(left, rows, strict=True)]
                # the last unit may go on in the next rows; what it has so far is summed
                cut = int(np.searchsorted(rows[0], rows[0][-1]))
                yield best([x[:cut] for x in rows])
                left = _summed([x[cut:] for x in rows[:3]], rows[3][cut:])
            yield best(left)

        rows = self.classed().mapInArrow(sides, "unit long, own long, cell long, k long")
        return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(choose, "unit long, cls long")

    def moved(self, moves: DataFrame) -> Clusters:
        got = moves.where("unit >= 0").toArrow()
        of, beyond = self.of.copy(), self.beyond
        of[got["unit"].to_numpy()] = got["cls"].to_numpy()
        if beyond is not None:
            new = moves.where("unit < 0").select(F.col("unit").alias("code"), F.col("cls").alias("new"))
            beyond = materialize(beyond.join(new, "code", "left").select("code", F.coalesce("new", "cls").alias("cls")), "classes")
        return Clusters(self.bigrams, of, beyond, self.sides)

    def settled(self) -> tuple[Clusters, np.ndarray]:
        """Classes after sweeps over all units, with their table. A sweep that does not pay moves half, a quarter, an eighth of its units."""
        now, n = self, self.table()
        while True:
            moves = materialize(now.moves(n), "moves")
            for share in (1, 2, 4, 8):
                new = now.moved(moves.where(F.pmod(F.xxhash64("unit"), F.lit(share)) == 0))
                after = new.table()
                rise = _likelihood(after) - _likelihood(n)
                if rise > 0:
                    break
            else:
                return now, n
            now, n = new, after
            if rise < RISE * (_likelihood(n) + _plogp(n.sum())):
                return now, n


class Model:
    """What tasks need to score: frequent words with counts, classes of units, log tables."""

    def __init__(
        self, n: int, v: int, frequent: dict[str, int], units: Units, of: np.ndarray, joint: np.ndarray, kinds: np.ndarray,
        counts: np.ndarray, checks: np.ndarray,
    ):
        """``counts`` and ``checks`` belong to ``units.codes``."""
        self.n, self.v, self.units, self.of = n, v, units, of
        self.counts, self.checks = counts, checks
        self.mass, self.kinds = joint.sum(0), kinds
        joint = joint + 0.5
        self.step = np.log10(joint / joint.sum(1, keepdims=True))
        self.index = {w: i for i, w in enumerate(frequent)}
        unit = units.of(list(frequent)) if frequent else np.zeros(0, np.int64)
        count = np.array(list(frequent.values()), float)
        self.base = np.log10(count + 1)
        self.emit = self.emission(count, of[np.maximum(unit, 0)]) if len(count) else count

    def emission(self, count, cls):
        """log10 P(word | class) of words seen in training."""
        return np.log10((count - DISCOUNT) / self.mass[cls])

    def unseen(self) -> list[float]:
        """log10 P(unseen word | class) for each class."""
        return [math.log10(DISCOUNT * k / m) if k else -math.log10(self.n + self.v + 1) for k, m in zip(self.kinds, self.mass, strict=True)]

    def local(self, text: str | None):
        """Of a text: tokens, then over frequent words known tokens, base and model sums with all class steps, the rare words left with their
        classes, and those whose class is not known here: place, word, class of its ending, classes before and after (-1: not known either)."""
        words = [*tokens(text), END]
        get = self.index.get
        at = np.array([get(w, -1) for w in words], np.int64)
        unit = self.units.of(words)
        named = unit >= 0
        seen = (at >= 0) & named
        cls = np.where(named, self.of[np.maximum(unit, 0)], -1)
        before, after = np.concatenate((cls[-1:], cls[:-1])), np.concatenate((cls[1:], cls[:1]))
        both = named & (before >= 0)
        total = self.step[before[both], cls[both]].sum()
        known = at[seen]
        rare = np.flatnonzero(~seen & named)
        open_ = [(int(i), words[i], int(self.of[_ending_of(unit[i])]), int(before[i]), int(after[i])) for i in np.flatnonzero(~named)]
        return (len(words), len(known), float(self.base[known].sum()), float(total + self.emit[known].sum()),
                Counter(zip([words[i] for i in rare], cls[rare].tolist(), strict=True)), open_)

    def looked_up(self, words: pa.Array) -> tuple[np.ndarray, ...]:
        """Of words: class, whether the count is known here, and then what the word adds to the base and the model."""
        unit = self.units.named(words)
        cls, place = self.of[unit].astype(np.int64), np.maximum(unit - ENDINGS, 0)
        count = np.zeros(len(words))
        if len(self.counts):
            count = np.where((unit >= ENDINGS) & (self.checks[place] == checks(words)), self.counts[place], 0).astype(float)
        known, emit = count > 0, np.zeros(len(words))
        emit[known] = self.emission(count[known], cls[known])
        return cls, known, np.log10(count + 1), emit

    def summed(self, texts: pa.Array | list[str | None]):
        """``local`` of many texts, where every unit is known: tokens, known tokens, base and model sums by text, then text, word, class and number of
        the words whose counts are not known here."""
        words, at, long = numbered(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        cls, known, base, emit = self.looked_up(words)
        step, starts = cls[at], np.cumsum(long) - long
        step = self.step[np.concatenate((step[-1:], step[:-1])), step]      # the end stands before every text
        step += emit[at]
        sums = [np.add.reduceat(known[at], starts, dtype=np.int64), np.add.reduceat(base[at], starts), np.add.reduceat(step, starts)]
        rare = np.flatnonzero(~known[at])
        pairs, k = _tallied(np.repeat(np.arange(len(long)), long)[rare] << 32 | at[rare])
        word = pairs & 0xFFFFFFFF
        return (long, *sums, pairs >> 32, words.take(pa.array(word)).to_pylist(), cls[word], k)

    def steps(self, open_: list[dict]) -> float:
        """Sum of the class steps into and out of the places that ``local`` left, in order."""
        total, last = 0.0, -1
        for r in open_:
            total += self.step[r["before"] if r["before"] >= 0 else last, r["cls"]]
            if r["after"] >= 0:
                total += self.step[r["cls"], r["after"]]
            last = r["cls"]
        return float(total)


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the stored ``word, c`` counts over all training documents, with the class ``own`` of units beyond ``KNOWN``."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))
    train = docs.where(crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT).select("text")
    counts = materialize(train.mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    frequent = {r["word"]: r["c"] for r in top}

    def coded(batches):
        for batch in batches:
            words = batch["word"].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch["word"], batch["c"], pa.array(codes(words)), pa.array(checks(words))], ["word", "c", "code", "check"])

    named = counts.mapInArrow(coded, "word string, c long, code long, check long")
    # the least count of a known unit: as many as there is room for
    cut, room = LEAST, KNOWN - 1
    many = sorted(counts.where(F.col("c") >= LEAST).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    for r in many:
        room -= r["n"]
        if room < 0:
            cut = r["c"] + 1
            break
    whole = cut == LEAST
    # two words of one code have no count here and are joined
    table = named.where((F.col("c") >= cut) | (F.col("word") == END)).groupBy("code").agg(
        F.when(F.count(F.lit(1)) == 1, F.max("c")).otherwise(0).alias("c"), F.max("check").alias("check")).orderBy("code").toArrow()
    units = Units(table["code"].to_numpy(), whole)
    sent = spark.sparkContext.broadcast(units)      # bounded by KNOWN
    others = None if whole else materialize(named.where((F.col("c") >= LEAST) & (F.col("c") < cut) & (F.col("word") != END)).select("code").distinct(), "others")

    cells = Cells(ENDINGS + len(units.codes), n)

    def pairs(batches):
        held, size = [], 0
        for batch in gathered(batches):
            held.append(cells.keys(batch["text"], sent.value))
            size += len(held[-1])
            if size > PAIRS:
                keys, held, size = np.concatenate(held), [], 0
                yield from cells.packed(*_tallied(keys))
        if held:
            yield from cells.packed(*_tallied(np.concatenate(held)))

    def pairs_coded(batches):
        def runs():
            for batch in gathered(batches):
                words, at, _ = numbered(batch["text"])
                u = sent.value.named(words)[at]
                a = np.concatenate((u[-1:], u[:-1]))
                yield _summed([a, u], np.ones(len(u), np.int64))

        yield from (_batch(a=a, b=b, k=k) for a, b, k in _merged(runs(), PAIRS // 4))

    sides = None
    if whole:
        # every token makes one bigram, so there are at most n
        sides = _stored(cells.summed(train.mapInArrow(pairs, "cell int, a array<int>, b array<int>, k array<long>")), n)
        bigrams = following(sides)
    else:
        bigrams = materialize(train.mapInArrow(pairs_coded, "a long, b long, k long").groupBy("a", "b").agg(F.sum("k").alias("k")), "pairs")
        for unit in ("a", "b"):
            left = bigrams.where(F.col(unit) < 0).join(others.select(F.col("code").alias(unit), F.lit(True).alias("__own")), unit, "left")
            left = left.withColumn(unit, F.when(F.col("__own"), F.col(unit)).otherwise(F.expr(f"pmod(-1 - {unit}, {ENDINGS})"))).drop("__own")
            bigrams = bigrams.where(F.col(unit) >= 0).unionByName(left)
        bigrams = materialize(bigrams.groupBy("a", "b").agg(F.sum("k").alias("k")), "bigrams")

    # first classes: the most frequent words and the endings, one by one
    coarse = np.concatenate((np.arange(ENDINGS), _ending_of(units.codes))).astype(np.int64)
    own = units.of([END, *[w for w in list(frequent)[:WORDS] if w != END][:WORDS - 1]])
    own = own[own >= ENDINGS]
    coarse[own] = ENDINGS + np.arange(len(own))
    side = ENDINGS + WORDS
    first = spark.sparkContext.broadcast(coarse)

    def rough(batches):
        for a, b, k in _chunks(batches):
            a, b = (np.where(u >= 0, first.value[np.maximum(u, 0)], _ending_of(u)) for u in (a, b))
            cell, k = _summed([a * side + b], k)
            yield _batch(cell=cell, k=k)

    def rough_folded(batches):
        n = np.zeros(side * side)
        for a, _, b, k in _unfolded(batches):
            n += np.bincount(first.value[a] * side + first.value[b], k, len(n))
        at = np.flatnonzero(n)
        yield _batch(cell=at, k=n[at].astype(np.int64))

    rows = bigrams.mapInArrow(rough, "cell long, k long") if sides is None else sides.where("side = 0").mapInArrow(rough_folded, "cell long, k long")
    got = rows.groupBy("cell").agg(F.sum("k").alias("k")).toArrow()
    matrix = np.zeros(side * side)
    matrix[got["cell"].to_numpy()] = got["k"].to_numpy()
    of = exchange(matrix.reshape(side, side))
    start = of[:ENDINGS]

    def inherited(batches):
        for batch in batches:
            c = batch["code"].to_numpy()
            yield _batch(code=c, cls=start[_ending_of(c)])

    beyond = None if whole else materialize(others.mapInArrow(inherited, "code long, cls long"), "classes")
    clusters, joint = Clusters(bigrams, of[coarse], beyond, sides).settled()

    placed = named.withColumn("own", F.lit(None).cast("long")) if whole else named.join(clusters.beyond.withColumnRenamed("cls", "own"), "code", "left")
    classes = clusters.sent

    def kinds_of(batches):
        for batch in batches:
            unit = sent.value.coded(batch["code"].to_numpy())
            cls = classes.value[np.where(unit >= 0, unit, _ending_of(unit))].astype(np.int64)
            own = batch["own"].fill_null(-1).to_numpy()
            k = np.bincount(np.where(own >= 0, own, cls), minlength=CLASSES)
            yield _batch(cls=np.arange(CLASSES), k=k)

    kinds = np.zeros(CLASSES)
    for r in placed.select("code", "own").mapInArrow(kinds_of, "cls long, k long").groupBy("cls").agg(F.sum("k").alias("k")).collect():
        kinds[r["cls"]] = r["k"]
    counts = counts.withColumn("own", F.lit(None).cast("long")) if whole else materialize(placed.select("word", "c", "own"), "words")
    return Model(n, v, frequent, units, clusters.of, joint, kinds, table["c"].to_numpy(), table["check"].to_numpy()), counts


def scored(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every document row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)      # bounded by FREQUENT and KNOWN
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"row long, doc_id {kind}, word string, cls int, k long, pos long, before long, after long, n_tokens long, n_known long, base double, model double"

    def run(batches):
        own = sent.value
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                out: list[list] = [[] for _ in range(12)]
                for row, doc_id, text in zip(*(part[c].to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                    n, known, base, total, rare, open_ = own.local(text)
                    # the row of the text itself meets no word: it has a blank
                    values = [(row, doc_id, f" {row}", 0, 0, None, None, None, n, known, base, total)]
                    values += [(row, None, w, c, k, *[None] * 7) for (w, c), k in rare.items()]
                    values += [(row, None, w, c, 1, i, x, y, None, None, None, None) for i, w, c, x, y in open_]
                    for column, new in zip(out, zip(*values, strict=True), strict=True):
                        column.extend(new)
                types = (pa.int64(), part.schema.field("doc_id").type, pa.string(), pa.int32(), *[pa.int64()] * 6, pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)],
                                                 ["row", "doc_id", "word", "cls", "k", "pos", "before", "after", "n_tokens", "n_known", "base", "model"])

    def run_whole(batches):
        own = sent.value
        for part in gathered(batches):
            if part.num_rows:
                n, known, base, total, text, word, cls, k = own.summed(part["text"])
                row, many = part["row"].to_numpy(), len(word)
                none = lambda t: pa.nulls(many, t)
                both = lambda x, y, t: pa.concat_arrays([pa.array(x, t), pa.array(y, t)])
                kind_ = part.schema.field("doc_id").type
                yield pa.RecordBatch.from_arrays([
                    both(row, row[text], pa.int64()), pa.concat_arrays([part["doc_id"], none(kind_)]),
                    both([f" {r}" for r in row.tolist()], word, pa.string()),
                    both(np.zeros(len(row), np.int32), cls.astype(np.int32), pa.int32()), both(np.zeros(len(row), np.int64), k, pa.int64()),
                    *(pa.concat_arrays([pa.array(x, t), none(t)]) for x, t in (
                        (n, pa.int64()), (known, pa.int64()), (base, pa.float64()), (total, pa.float64())))], slim)

    slim = ["row", "doc_id", "word", "cls", "k", "n_tokens", "n_known", "base", "model"]
    whole = model.units.whole
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        run_whole if whole else run, f"row long, doc_id {kind}, word string, cls int, k long, n_tokens long, n_known long, base double, model double" if whole else fields)
    rows = rows.join(counts.hint("shuffle_hash"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    if not whole:
        rows = rows.withColumn("cls", F.when(F.col("pos").isNotNull(), F.coalesce(F.col("own").cast("int"), "cls")).otherwise(F.col("cls")))
    floor = math.log10(model.n + model.v + 1)
    at = F.col("cls") + 1
    mass = F.element_at(F.array(*[F.lit(float(m)) for m in model.mass]), at)
    unseen = F.element_at(F.array(*[F.lit(float(u)) for u in model.unseen()]), at)
    emit = F.when(F.col("c") > 0, F.log10((F.col("c") - DISCOUNT) / mass)).otherwise(unseen)
    sums = rows.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0))).alias("n_known"),
        (F.max("base") + F.sum(F.col("k") * F.log10(F.col("c") + 1.0))).alias("base"),
        (F.max("model") + F.sum(F.col("k") * emit)).alias("score"),
        *([] if model.units.whole else [F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "cls", "before", "after")))).alias("open")]))
    if not model.units.whole:

        def finished(batches):
            for batch in batches:
                add = np.array([sent.value.steps(x) for x in batch["open"].to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(batch["score"].to_numpy() + add)], batch.schema.names[:-1])

        sums = sums.mapInArrow(finished, f"row long, doc_id {kind}, n_tokens long, n_known long, base double, score double")
    return sums.select("doc_id", "n_tokens", "n_known", (F.col("base") - floor * F.col("n_tokens")).alias("base_score"), "score")


def report(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    model, counts = fit(docs)
    held_out = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored(docs, model, counts).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
