"""SentencePiece encoding by a Viterbi pass over an Aho-Corasick automaton, and decoding.

The automaton holds all pieces. One pass over a text yields at each position the pieces that end there, longest
first along the output links, and each relaxes the best score of that position: the sum of piece scores is maximal
over all segmentations, of equal sums the one with the longer last piece. A character
that no piece covers costs ten below the least score and is spelled in byte pieces.

No piece crosses the start of a run of blanks or a line break, so texts are cut there and equal
chunks are solved once per task. Chunks that were met lately stay: when a generation of them is full, the one before it goes.
A chunk is decoded when it is solved, so texts need no second pass to know that they come back.

Decoding returns the text exactly. A U+2581 of the text itself, which the model's own mapping takes for a
blank, is spelled in bytes here and so survives.

Defined results: null and empty texts have no pieces, and no pieces decode to the empty text; texts of any length
are processed whole; repeated rows give equal rows; other columns are kept.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattfleet.llm.common import extended

#: Bytes of solved chunks in each of the two generations that one task remembers.
TABLE = 32 << 20
#: Bytes of an entry besides its characters and ids.
ENTRY = 180
UNKNOWN_COST = 10.0


class Pieces:
    """Pieces with ids and scores; blanks stand as blanks."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int]):
        self.pieces, self.bytes = pieces, np.array(byte_ids, np.int32)
        self.unknown = min(s for _, s in pieces.values()) - UNKNOWN_COST
        self.spelled = {i: p.encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        if any(" " in p.lstrip(" ") for p in pieces):
            raise ValueError("a piece has a blank behind other characters; chunks could not be solved apart")
        breaks = "" if any("\n" in p for p in pieces) else "\n"
        self.chunks = re.compile(rf" +[^ {breaks}]*|[^ {breaks}]+" + (f"|{breaks}" if breaks else ""))
        self._reset()

    def __getstate__(self):
        return self.__dict__ | {"_scan": None, "_new": {}, "_old": {}, "_held": 0, "_lossy": set()}

    def _reset(self) -> None:
        self._scan = None
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._held = 0
        self._lossy: set[str] = set()           # chunks that do not come back

    def solve(self, chunk: str) -> list[int]:
        """Ids of one chunk's best segmentation."""
        if self._scan is None:
            import ahocorasick

            self._scan = ahocorasick.Automaton()
            for p, (i, s) in self.pieces.items():
                self._scan.add_word(p, (len(p), i, s))
            self._scan.make_automaton()
        n = len(chunk)
        best, back = [0.0] + [None] * n, [(0, -1)] * (n + 1)
        done = 0

        def spell(upto: int) -> None:
            # positions that no piece reaches with its last character: spell that character
            nonlocal done
            while done < upto:
                done += 1
                cost = best[done - 1] + self.unknown
                if best[done] is None or (cost > best[done] and chunk[done - 1] not in self.pieces):
                    best[done], back[done] = cost, (done - 1, -1)

        for end, (size, i, score) in self._scan.iter(chunk):
            spell(end)
            start, here = end + 1 - size, end + 1
            total = best[start] + score
            if best[here] is None or total > best[here]:
                best[here], back[here] = total, (start, i)
        spell(n)
        out, at = [], n
        while at:
            start, i = back[at]
            out.append([i] if i >= 0 else self.bytes[list(chunk[start:at].encode("utf-8", "replace"))].tolist())
            at = start
        return list(chain.from_iterable(reversed(out)))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text, with the model's blank in front."""
        return self.encode_checked(text)[0]

    def encode_checked(self, text: str | None) -> tuple[np.ndarray, bool]:
        """Ids of a whole text, and whether they decode to it."""
        if not text:
            return np.zeros(0, np.int32), True
        found, new = self.chunks.findall(" " + text), self._new
        kinds = set(found)
        for chunk in kinds.difference(new):
            ids = self._old.get(chunk)
            if ids is None:
                solved = self.solve(chunk)
                ids = np.array(solved, np.int32).tobytes()
                if b"".join([self.spelled[i] for i in solved]) != chunk.encode("utf-8", "replace"):
                    self._lossy.add(chunk)
            new[chunk] = ids
            self._held += len(chunk) + len(ids) + ENTRY
        out = np.frombuffer(b"".join([new[c] for c in found]), np.int32)
        if self._held > TABLE:
            self._old, self._new, self._held = new, {}, 0
        good = not self._lossy or self._lossy.isdisjoint(kinds) or self.decode(out.tolist()) == text
        return out, good

    def decode(self, ids) -> str:
        """The text of ``encode``."""
        spelled = self.spelled
        return b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")[1:]


def load(path: str) -> Pieces:
    """Pieces of a model file that spells unknown characters in bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = {}, {}
    for i in range(model.vocab_size()):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[name.replace("▁", " ")] = (i, model.get_score(i))
    if len(byte_ids) != 256:
        raise ValueError("the model has no byte pieces")
    return Pieces(pieces, [byte_ids[b] for b in range(256)])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """All columns of ``docs`` with ``piece_ids`` and ``round_trip``, whether they decode to the text.

    Columns of these two names in ``docs`` are replaced.
    """
    docs = docs.drop("piece_ids", "round_trip")
    sent = docs.sparkSession.sparkContext.broadcast(pieces)      # bounded by the vocabulary

    def run(batches):
        own = sent.value
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = part["text"].to_pylist()
                ids, same = zip(*map(own.encode_checked, texts), strict=True)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(same)], [*part.schema.names, "piece_ids", "round_trip"])

    return docs.mapInArrow(run, extended(docs, "piece_ids array<int>, round_trip boolean"))


def decoded(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """All columns of ``rows`` with ``decoded`` (replaced if it is there), the text of ``piece_ids``; null ids decode to the empty text."""
    rows = rows.drop("decoded")
    sent = rows.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        for batch in batches:
            new = pa.array([sent.value.decode(i or []) for i in batch["piece_ids"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, extended(rows, "decoded string"))


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    rows = encoded(docs.select("doc_id", "text"), load(path or default_path()))
    return rows.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "round_trip")
