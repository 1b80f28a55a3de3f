"""Fill-in-middle transformation over an indexable skip list of text units.

A text is cut into units (``[A-Za-z]+|[^A-Za-z]``). The boundaries between them are the nodes of a skip list: each
lane links every node of its height or more to the next, and every link carries how many units and how many code points
it passes over. A rank is reached from the top lane down, adding up widths, and the sum of the code-point widths is the
place of the cut; no search over the text is needed, and both cuts are exact.

Heights of nodes do not depend on the text, so one table of heights serves all texts of a task. Everything happens per
row: nothing is shuffled, and a lost executor costs its own partitions.

Defined results: null and empty texts have no units and the form ``plain`` with an empty output; texts that hold a
sentinel stay ``plain``; a null id takes its cuts from the hash of ``1:`` alone; texts of any length are processed
whole; repeated rows give equal rows; no other column is read, so none can clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Percent of texts that are rearranged, and of those that put the suffix first.
FIM_PERCENT, SPM_PERCENT = 90, 20
#: One node in ``BRANCH`` of a lane is in the next lane up.
BRANCH = 4


class Lanes:
    """Node heights, and for each lane its nodes and their places in the lane below; grown by doubling."""

    def __init__(self) -> None:
        self.size = 0
        self.nodes: list[np.ndarray] = []
        self.below: list[np.ndarray] = []

    def upto(self, n: int) -> None:
        """Make room for nodes 0 to ``n``. Drawn from one seed, so that every task has the same heights."""
        if n < self.size:
            return
        self.size = max(4096, 1 << (n + 1).bit_length())
        heights = np.random.default_rng(SEED).geometric(1 - 1 / BRANCH, self.size) - 1
        heights[0] = heights.max()                    # the head is in every lane
        self.nodes = [np.flatnonzero(heights >= k) for k in range(int(heights[0]) + 1)]
        self.below = [np.zeros(0, np.int64)] + [np.searchsorted(a, b) for a, b in zip(self.nodes, self.nodes[1:], strict=False)]


class SkipList:
    """Boundaries 0 to n of one text's units with the code points before each."""

    def __init__(self, places: np.ndarray, lanes: Lanes):
        self.n = len(places) - 1
        lanes.upto(self.n)
        self.lanes = []
        for nodes, below in zip(lanes.nodes, lanes.below, strict=True):
            k = int(np.searchsorted(nodes, self.n, side="right"))
            self.lanes.append((np.diff(nodes[:k]), np.diff(places[nodes[:k]]), below[:k]))
            if k == 1:
                break

    def place(self, rank: int) -> int:
        """Code points before boundary ``rank``."""
        at, units, points = 0, 0, 0
        for k in range(len(self.lanes) - 1, -1, -1):
            unit_width, point_width, below = self.lanes[k]
            while at < len(unit_width) and units + unit_width[at] <= rank:
                units += int(unit_width[at])
                points += int(point_width[at])
                at += 1
            if k:
                at = int(below[at])
        return points


def boundaries(text: str) -> np.ndarray:
    """Code points before each unit, and the length of the text after the last."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (points | 32) - np.uint32(97) < 26       # other code points wrap around or lie above
    starts = ~letter
    starts[1:] |= ~letter[:-1]
    starts[:1] = True
    return np.append(np.flatnonzero(starts), len(points))


def draws(doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits from the id."""
    digest = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12)]


def transform(text: str | None, doc_id: int | None, lanes: Lanes) -> tuple[int, str, int | None, int | None, str]:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    text = text or ""
    skip = SkipList(boundaries(text), lanes) if text else None
    n = skip.n if skip else 0
    h1, h2, h3, h4 = draws(doc_id)
    if skip is None or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= FIM_PERCENT:
        return n, "plain", None, None, text
    a, b = (skip.place(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    before, middle, after = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_PERCENT:
        return n, "spm", a, b - a, SUFFIX + after + PREFIX + before + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + before + SUFFIX + after + MIDDLE + middle


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every document row."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches):
        lanes = Lanes()
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows = [transform(t, i, lanes) for i, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True)]
                n, form, before, middle, output = zip(*rows, strict=True)
                long = [pa.array(c, pa.int64()) for c in (n, before, middle)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], long[0], pa.array(form), *long[1:], pa.array(output)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form alone.

    A rearranged text holds no sentinel of its own and none can arise across a cut, as no sentinel
    begins with the end of another; so each occurs once.
    """
    def between(start: str, end: str | None) -> Column:
        rest = F.substring_index(output, start, -1)
        return F.substring_index(rest, end, 1) if end else rest

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
