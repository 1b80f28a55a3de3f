"""Alignment of two tokenizers' splits of the same texts, and how strongly their tokens are tied over the corpus.

Side A is a byte-level vocabulary (``tokenizers`` JSON), side B a piece model that spells unknown characters in bytes.
Both splits cover the same bytes, a blank and the text. Per batch of documents, ``pandas.merge_asof``, keyed by document,
finds for each token start the other side's token that covers it. Two tokens overlap if and only if the later
of their starts lies in the other token, so both directions together are all overlaps, and a pair with equal starts, which
both find, is kept once. Bytes where tokens of both sides end cut the splits into groups.

The first pass writes, per document, its distinct linked id pairs with how often each occurs. Their sums over the corpus are
pre-aggregated before the shuffle. The second pass reads the most frequent ``KNOWN`` pairs from a table in the tasks, and
joins the others by pair, each of which is rare then; so neither the driver nor a task holds all pairs, and no document is encoded twice.

Defined results: texts that are null, empty, or whose joined tokens differ from a blank and the text on either side have no
tokens: zeros and empty groups. Texts of any length are processed whole; repeated rows, and rows without an id, are rows of their
own and count each time; other columns are not read, so none can clash. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wattfleet.llm.token_counts import PATTERN, _byte_letters
from wattfleet.session import materialize

#: Pairs in the tasks' table (24 MB); those beyond are joined.
KNOWN = 1 << 20
#: Code points aligned at once; a longer text is a batch of its own.
BATCH_CHARS = 1 << 20


class ByteLevel:
    """Side A: merges by rank over the bytes of pre-tokens; special strings are plain text."""

    def __init__(self, text: str):
        data = json.loads(text)
        vocab, letters = data["model"]["vocab"], _byte_letters()
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in data["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("ids must follow the order of merges, as they serve as ranks")
        special = {t["content"] for t in data.get("added_tokens", [])}
        self.ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.size = max(vocab.values()) + 1 + len(special)
        by_id = {i: t for t, i in self.ranks.items()}
        self.spelled = [by_id.get(i, b"") for i in range(self.size)]
        self._own = None

    def __getstate__(self):
        return self.__dict__ | {"_own": None}

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self._own is None:
            import tiktoken

            self._own = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        return [self._own.encode_ordinary(" " + t) for t in texts]


class PieceModel:
    """Side B: the model puts the blank in front itself."""

    def __init__(self, model: bytes):
        self.model = model
        own = self._load()
        self.size = own.vocab_size()
        raw = lambda i: (bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i)
                         else own.id_to_piece(i).replace("▁", " ").encode())
        self.spelled = [raw(i) for i in range(self.size)]

    def __getstate__(self):
        return self.__dict__ | {"_own": None}

    def _load(self):
        import sentencepiece

        self._own = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return self._own

    def encode(self, texts: list[str]) -> list[list[int]]:
        return (self._own or self._load()).encode(texts, num_threads=1)


def load(path_a: str, path_b: str) -> tuple[ByteLevel, PieceModel]:
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:
        return ByteLevel(f.read()), PieceModel(g.read())


class Side:
    """Tokens of one side of a batch: id, document, and the bytes before and after in the batch."""

    def __init__(self, tokens: list[list[int]], sizes: np.ndarray):
        counts = [len(t) for t in tokens]
        self.id = np.fromiter(chain.from_iterable(tokens), np.int64, sum(counts))
        self.doc = np.repeat(np.arange(len(tokens)), counts)
        size = sizes[self.id]
        self.end = np.cumsum(size)
        self.start = self.end - size

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"start": self.start, "doc": self.doc})

    def covering(self, other: Side) -> np.ndarray:
        """For each token the place of the other side's token that covers its start."""
        right = other.frame().assign(at=np.arange(len(other.id)))
        return pd.merge_asof(self.frame(), right, on="start", by="doc")["at"].to_numpy(np.int64)


class Aligner:
    def __init__(self, a: ByteLevel, b: PieceModel):
        self.a, self.b = a, b
        self.sizes = [np.array([len(t) for t in s.spelled]) for s in (a, b)]
        self.named = [[np.array([f"{i}{mark}" for i in range(s.size)], object) for mark in (",", end)] for s, end in ((a, "|"), (b, ";"))]

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides, none for a text whose bytes either side does not give back."""
        texts = [t or "" for t in texts]
        sides = [s.encode(texts) for s in (self.a, self.b)]
        spell_a, spell_b = self.a.spelled, self.b.spelled
        for k, t in enumerate(texts):
            raw = b" " + t.encode("utf-8", "surrogatepass")
            if not t or b"".join([spell_a[i] for i in sides[0][k]]) != raw or b"".join([spell_b[i] for i in sides[1][k]]) != raw:
                sides[0][k], sides[1][k] = [], []
        return sides[0], sides[1]

    def align(self, texts: list[str | None]) -> dict[str, object]:
        """Columns of one batch."""
        n = len(texts)
        ids_a, ids_b = self.tokens(texts)
        x, y = Side(ids_a, self.sizes[0]), Side(ids_b, self.sizes[1])
        over_x, over_y = x.covering(y), y.covering(x)
        later = x.start[over_y] != y.start               # equal starts are links of the first direction already
        link_x = np.concatenate([np.arange(len(x.id)), over_y[later]])
        link_y = np.concatenate([over_x, np.flatnonzero(later)])
        doc = x.doc[link_x]
        per = lambda d: np.bincount(d, minlength=n)
        last_x, last_y = np.isin(x.end, y.end, assume_unique=True), np.isin(y.end, x.end, assume_unique=True)
        pairs, times = np.unique(doc * (self.a.size * self.b.size) + x.id[link_x] * self.b.size + y.id[link_y], return_counts=True)
        owner, pairs = np.divmod(pairs, self.a.size * self.b.size)
        return {"n_a": per(x.doc), "n_b": per(y.doc), "n_groups": per(x.doc[last_x]), "n_links": per(doc),
                "groups": self.groups(n, x, y, last_x, last_y), "pairs": (per(owner), pairs), "times": (per(owner), times),
                "links": (doc, link_x, link_y)}

    def groups(self, n: int, x: Side, y: Side, last_x: np.ndarray, last_y: np.ndarray) -> list[str]:
        """Per document its groups as text: ``a1,a2|b1;a3|b2,b3``."""
        of_x, of_y = np.cumsum(last_x) - last_x, np.cumsum(last_y) - last_y
        out = np.empty(len(x.id) + len(y.id), object)
        out[np.arange(len(x.id)) + np.searchsorted(of_y, of_x)] = np.where(last_x, self.named[0][1][x.id], self.named[0][0][x.id])
        out[np.arange(len(y.id)) + np.searchsorted(of_x, of_y, "right")] = np.where(last_y, self.named[1][1][y.id], self.named[1][0][y.id])
        ends = np.cumsum(np.bincount(x.doc, minlength=n) + np.bincount(y.doc, minlength=n))
        out = out.tolist()
        return ["".join(out[s:e])[:-1] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= BATCH_CHARS:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def aligned(docs: DataFrame, a: ByteLevel, b: PieceModel, links: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times`` of every document row.

    ``pairs`` are the distinct linked ids, ``a_id * b.size + b_id``, ``times`` how many links have them. With ``links`` the places
    of the linked tokens follow as ``link_a, link_b``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Aligner(a, b))      # bounded by the vocabularies
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times", *(["link_a", "link_b"] if links else [])]

    def run(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            for s, e in _slices(texts):
                got = sent.value.align(texts[s:e])
                cols = [batch["doc_id"][s:e], *[pa.array(got[c], pa.int64()) for c in names[1:5]], pa.array(got["groups"], pa.string()),
                        _lists(*got["pairs"], pa.int64()), _lists(*got["times"], pa.int32())]
                if links:
                    doc, x, y = got["links"]
                    order = np.lexsort((y, x, doc))
                    before = [np.concatenate([[0], np.cumsum(got[c])])[:-1] for c in ("n_a", "n_b")]
                    cols += [_lists(got["n_links"], (p - b0[doc])[order], pa.int32()) for p, b0 in zip((x, y), before, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "text").mapInArrow(run, ddl + (", link_a array<int>, link_b array<int>" if links else ""))


def pair_counts(stored: DataFrame, size_b: int) -> DataFrame:
    """``pair, n, best``: links of each id pair over the corpus, and whether no other pair of its B id has more."""
    each = stored.select("times", F.posexplode("pairs").alias("at", "pair")).select("pair", F.get("times", F.col("at")).alias("t"))
    counts = each.groupBy("pair").agg(F.sum("t").alias("n"))
    same_b = Window.partitionBy(F.col("pair") % size_b)         # at most the A vocabulary
    return counts.withColumn("best", F.col("n") == F.max("n").over(same_b))


def with_ties(stored: DataFrame, counts: DataFrame, known: int) -> DataFrame:
    """``stored`` with ``n_best`` and ``count_sum`` in place of its pairs; ``row`` tells rows apart."""
    size = counts.count()
    top = counts if size <= known else counts.orderBy(F.desc("n"), "pair").limit(known)
    table = top.toPandas().sort_values("pair")
    sent = stored.sparkSession.sparkContext.broadcast(              # at most ``known`` rows
        (table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64), table["best"].to_numpy(bool)))
    keep = [c for c in stored.columns if c not in ("pairs", "times")]
    names = [*keep, "n_best", "count_sum", "rest", "rest_times"]

    def run(batches):
        pair, count, best = sent.value
        for batch in batches:
            pairs, lists = batch["pairs"].flatten().to_numpy(), batch["pairs"]
            times = batch["times"].flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(pair, pairs), max(len(pair) - 1, 0))
            hit = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in "xx"]
            for out, value in zip(sums, ((best[at] & hit) * times, np.where(hit, count[at], 0) * times) if len(pair) else (), strict=False):
                np.add.at(out, row, value)
            left = np.bincount(row[~hit], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], *map(pa.array, sums), _lists(left, pairs[~hit], pa.int64()),
                                              _lists(left, times[~hit], pa.int64())], names)

    kept = ", ".join(f"{c} {stored.schema[c].dataType.simpleString()}" for c in keep)
    got = stored.select(*keep, "pairs", "times").mapInArrow(run, f"{kept}, n_best long, count_sum long, rest array<long>, rest_times array<long>")
    if size <= known:
        return got.drop("rest", "rest_times")
    got = materialize(got, "alignment-known")
    rest = got.select("row", "rest_times", F.posexplode("rest").alias("at", "pair")).select("row", "pair", F.get("rest_times", F.col("at")).alias("t"))
    more = rest.join(counts, "pair").groupBy("row").agg(
        F.sum(F.col("best").cast("long") * F.col("t")).alias("__b"), F.sum(F.col("n") * F.col("t")).alias("__c"))
    plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return got.join(more, "row", "left").select(*keep, plus("n_best", "__b"), plus("count_sum", "__c"))


def digest(groups: Column) -> Column:
    return F.when(groups == "", "").otherwise(F.sha2(groups.cast("binary"), 256))


def report(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, known: int | None = None) -> DataFrame:
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    a, b = load(path_a, path_b)
    rows = aligned(docs, a, b).withColumn("groups_sha256", digest(F.col("groups"))).drop("groups")
    stored = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "alignment")
    counts = materialize(pair_counts(stored, b.size), "pair-counts")
    return with_ties(stored, counts, KNOWN if known is None else known).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
