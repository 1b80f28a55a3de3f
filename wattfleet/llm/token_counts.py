"""Exact byte-pair token counts of every prefix by dynamic programming.

A merge-based encoding is the only split of a string into tokens in which every two neighbours are what
merging the two of them alone gives. So the last token of a prefix is the one that ends there and
fits the last token of what is left of it, and the count of the prefix is one more than that of
the rest. Counts of all prefixes follow left to right; a question about a truncation or a budget
reads them instead of encoding again. Words share beginnings, so prefix states are kept in one table.

The vocabulary file (``tokenizers`` JSON, byte-level) is read as bytes by Spark's driver and sent with the code.

Defined results: null counts as empty, 0 tokens; texts of any length are processed whole; special strings in texts
are their one token, as the library does by default; repeated rows count alike; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

LIMIT = 1024
#: Entries of the prefix and word tables of one task, beyond which they start anew (about 60 MB each).
TABLE = 300_000

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts of all prefixes for one vocabulary."""

    def __init__(self, text: str):
        data = json.loads(text)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.tokens = {raw(t): i for t, i in data["model"]["vocab"].items()}
        self.longest = max(map(len, self.tokens))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        special = [t["content"] for t in data.get("added_tokens", [])]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces = regex.compile(PATTERN)
        self._reset()

    def _reset(self) -> None:
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._state: dict[bytes, tuple[int, bytes]] = {}
        self._count: dict[str, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"_fits": {}, "_state": {}, "_count": {}}

    def _merged(self, raw: bytes) -> list[bytes]:
        """Merges applied one by one; only ever run on one or two tokens."""
        parts = [raw[i:i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            pair = (parts[at], parts[at + 1])
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _neighbours(self, a: bytes, b: bytes) -> bool:
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) > TABLE:
                self._fits = {}
            got = self._fits[(a, b)] = self._merged(a + b) == ([a, b] if a else [b])
        return got

    def _prefix(self, raw: bytes) -> tuple[int, bytes]:
        """Count and last token of ``raw``, from the states of its prefixes, which it leaves behind."""
        state, n = self._state, len(raw)
        known = n
        while known and raw[:known] not in state:
            known -= 1
        for end in range(known + 1, n + 1):
            for start in range(max(0, end - self.longest), end):
                token = raw[start:end]
                if token in self.tokens:
                    before = state[raw[:start]] if start else (0, b"")
                    if self._neighbours(before[1], token):
                        state[raw[:end]] = (before[0] + 1, token)
                        break
        return state[raw] if n else (0, b"")

    def piece(self, piece: str) -> int:
        """Tokens of one pre-token."""
        got = self._count.get(piece)
        if got is None:
            if len(self._count) > TABLE:
                self._count = {}
            if len(self._state) > TABLE:
                self._state = {}
            got = self._count[piece] = self._long(piece.encode("utf-8", "replace"))
        return got

    def _long(self, raw: bytes) -> int:
        if len(raw) <= 64:
            return self._prefix(raw)[0]
        # Long runs keep states by place, as their prefixes would fill the table with copies of themselves.
        states: list[tuple[int, bytes]] = [(0, b"")]
        for end in range(1, len(raw) + 1):
            for start in range(max(0, end - self.longest), end):
                token = raw[start:end]
                if token in self.tokens and self._neighbours(states[start][1], token):
                    states.append((states[start][0] + 1, token))
                    break
        return states[-1][0]

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if part:
                yield part, bool(i % 2)

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        piece = self.piece
        known = self._count
        total = 0
        for part, special in self._parts(text):
            if special:
                total += 1
            else:
                for p in self.pieces.findall(part):
                    n = known.get(p)
                    total += piece(p) if n is None else n
                    known = self._count
        return total

    def prefixes(self, text: str | None) -> np.ndarray:
        """Tokens of each prefix of 0, 1, ... code points, every one as if it were the whole text."""
        text = text or ""
        out, begin, base = np.zeros(len(text) + 1, np.int64), 0, 0
        # A prefix may end inside a run of blanks, a contraction or a special string, where its own last pieces
        # differ: those are split again from ``again``, a start that no later character changes, ``fixed`` tokens in.
        again, fixed = 0, 0
        for part, special in self._parts(text):
            for a, b in [(0, len(part))] if special else [m.span() for m in self.pieces.finditer(part)]:
                a, b = begin + a, begin + b
                inside = a > 0 and text[a].isspace() and text[a - 1].isspace()
                if not special and not inside:
                    again, fixed = a, base
                for end in range(a + 1, b + 1):
                    out[end] = fixed + sum(map(self.piece, self.pieces.findall(text[again:end])))
                base += 1 if special else self.piece(text[a:b])
                if special:
                    out[b] = base
                    again, fixed = b, base
            begin += len(part)
        return out

    def truncated(self, text: str | None, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens."""
        counts = self.prefixes(text)
        return (text or "")[: int(np.flatnonzero(counts <= budget)[-1])] if budget >= 0 else ""


def load(path: str) -> PrefixCounter:
    with open(path, encoding="utf-8") as f:
        return PrefixCounter(f.read())


def counted(docs: DataFrame, counter: PrefixCounter) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every document row."""
    sent = docs.sparkSession.sparkContext.broadcast(counter)     # bounded by the vocabulary

    def run(batches):
        count = sent.value.count
        for batch in batches:
            n = [count(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", size).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")


def with_prefix_counts(docs: DataFrame, counter: PrefixCounter) -> DataFrame:
    """``doc_id, prefix_tokens``: the count at every prefix, for truncation and budget questions."""
    sent = docs.sparkSession.sparkContext.broadcast(counter)

    def run(batches):
        for batch in batches:
            got = [sent.value.prefixes(t).tolist() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(got, pa.list_(pa.int64()))], ["doc_id", "prefix_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, prefix_tokens array<long>")


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return counted(docs, load(path)).withColumn("over_limit", F.col("n_tokens") > LIMIT)
