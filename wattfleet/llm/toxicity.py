"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses. Four transducers read a clause's words and label them: insults (a trie of word
beginnings, learnt from labels), threats, targets, and the operators negation and reported speech (fixed word lists). Their composition
is one automaton per clause: a target raises the insults and threats of its clause, a negation weakens
those within the next words, a reporting verb those of the rest of the clause. What the automaton emits is summed by
channel (plain, targeted, negated or reported insult; targeted threat) over the clauses of a text, and a logistic model weighs the channels.

Insults are word beginnings of 3 to 10 letters. From a sample of ``SAMPLE_ROWS`` labelled learning rows at
most, those with a high lower bound of their toxic share stand, if they follow many different words: what a
family of copies of one toxic text shares always follows the same one. Channel weights
start from fixed priors and move with the same sample.

Defined results: null and empty texts score as texts without any match; labels that are null or belong to no row
teach nothing, of repeated ids the greatest label counts; without labels the fixed priors and no insults
are used; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattfleet.llm.common import crc_fold, extended, text_batches

FOLDS = 5
SAMPLE_ROWS = 40_000
SHORTEST, LONGEST = 3, 10
#: A beginning is a candidate with so many toxic rows and this lower bound of its toxic share.
LEAST_ROWS = 5
LEAST_SHARE = 0.6
#: It has to follow so many different words, and one in five of its toxic rows (up to 50).
LEAST_CONTEXTS = 4
#: Distinct beginnings that one task counts before it hands the counts on.
TABLE = 200_000
#: Words a negation reaches.
SCOPE = 3

#: Operator words in English, German, French and Spanish.
THREATS = "kill murder hurt destroy umbringen töten vernichten tuer frapper matar destruir".split()
TARGETS = "you your yourself they them du dich euch ihr tu toi vous vosotros usted ustedes".split()
NEGATIONS = "not never no nor neither without isn't aren't nicht kein keine nie niemals ne pas jamais nunca jamás".split()
REPORTS = "said says told wrote claimed quoted reported sagte schrieb meinte dit écrit dijo escribió".split()

CHANNELS = ("plain", "targeted", "negated", "reported", "threat")
#: Prior weights of the channels and of the constant.
PRIOR = np.array([4.0, 6.0, 1.0, 1.5, 6.0, -3.0])

_CLAUSE = re.compile(r"[.,;:!?|\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def _beginnings(text: str) -> set[str]:
    return {w[:k] for w in set(_WORD.findall(text.lower())) for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}


def _lower_bound(hits: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Wilson bound of a share, one-sided 95 %."""
    p, z = hits / rows, 1.64
    return (p + z * z / (2 * rows) - z * np.sqrt(p * (1 - p) / rows + z * z / (4 * rows * rows))) / (1 + z * z / rows)


class Grammar:
    """The composed automaton with its channel weights; ``insults`` are word beginnings with a weight."""

    def __init__(self, insults: dict[str, float], weights: np.ndarray = PRIOR):
        self.insults, self.weights = insults, np.asarray(weights, float)
        starts = sorted({*insults, *THREATS}, key=len, reverse=True)
        # An Aho-Corasick pass finds the few texts that hold any start; built where it is used, as it does not pickle.
        self._starts, self._scan = starts, None

    def __getstate__(self):
        return self.__dict__ | {"_scan": None}

    def _any(self, low: str) -> bool:
        if self._scan is None:
            import ahocorasick

            self._scan = ahocorasick.Automaton()
            for s in self._starts:
                self._scan.add_word(s, len(s))
            self._scan.make_automaton()
        return any(end - n < 0 or not low[end - n].isalpha() for end, n in self._scan.iter(low))

    def _insult(self, word: str) -> float:
        return max((self.insults[word[:k]] for k in range(SHORTEST, min(LONGEST, len(word)) + 1) if word[:k] in self.insults), default=0.0)

    def clause(self, words: list[str]) -> np.ndarray:
        """One run of the automaton: emitted weight by channel."""
        out, negated, reported = np.zeros(len(CHANNELS)), 0, False
        target = any(w in _TARGETS for w in words)
        for word in words:
            if word in _REPORTS:
                reported = True
            if word in _NEGATIONS:
                negated = SCOPE + 1
            w = self._insult(word)
            if w:
                out[2 if negated else 3 if reported else 1 if target else 0] += w
            elif word in _THREATS and target and not negated and not reported:
                out[4] += 1.0
            negated = max(0, negated - 1)
        return out

    def channels(self, text: str | None) -> np.ndarray:
        total, low = np.zeros(len(CHANNELS)), (text or "").lower()
        if low and self._any(low):
            for part in _CLAUSE.split(low):
                total += self.clause(_WORD.findall(part))
        return np.log1p(total)

    def score(self, text: str | None) -> float:
        return _logistic(float(self.channels(text) @ self.weights[:-1] + self.weights[-1]))


_THREATS, _TARGETS, _NEGATIONS, _REPORTS = map(frozenset, (THREATS, TARGETS, NEGATIONS, REPORTS))


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic`` of the learning rows, ``SAMPLE_ROWS`` at most by a hash of the id."""
    fold = crc_fold(F.col("doc_id"), FOLDS)
    chosen = (labels.where((fold != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS))
    # bounded by SAMPLE_ROWS rows of two numbers
    return text_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()

    def out():
        keys = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_pydict({"b": pa.array(keys, pa.string()), "t": pa.array([toxic[k] for k in keys], pa.int64()), "c": pa.array([clean[k] for k in keys], pa.int64())})

    for batch in batches:
        for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            (toxic if label else clean).update(_beginnings(text))
            if len(toxic) + len(clean) > TABLE:
                yield out()
                toxic.clear()
                clean.clear()
    if toxic or clean:
        yield out()


def _closed(found: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Of ``beginning: (toxic rows, bound)``: longer ones in place of shorter that say the same, then none that a shorter one covers."""
    same = {b[:-1] for b, (t, _) in found.items() if b[:-1] in found and t >= 0.97 * found[b[:-1]][0]}
    kept: dict[str, float] = {}
    for b in sorted(found.keys() - same, key=lambda b: (len(b), b)):
        if all(kept.get(b[:k], -1.0) < found[b][1] - 0.05 for k in range(SHORTEST, len(b))):
            kept[b] = float(found[b][1])
    return kept


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    """Insults and channel weights from the bounded sample."""
    sample = _sample(docs, labels)
    tally = (sample.mapInArrow(_tally, "b string, t long, c long").groupBy("b").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
             .where(F.col("t") >= LEAST_ROWS).where(F.col("t") >= LEAST_SHARE * (F.col("t") + F.col("c"))).toPandas())
    hits, rows = tally["t"].to_numpy(float), (tally["t"] + tally["c"]).to_numpy(float)
    tally = tally[_lower_bound(hits, rows) >= LEAST_SHARE] if len(tally) else tally
    if tally.empty:
        return Grammar({})
    tally = tally.assign(bound=_lower_bound(tally["t"].to_numpy(float), (tally["t"] + tally["c"]).to_numpy(float)))
    candidates = frozenset(tally["b"])

    def followed(batches):
        for batch in batches:
            pairs = {(w[:k], before) for text in batch["text"].to_pylist() for before, w in pairwise(["^", *_WORD.findall(text.lower())])
                     for k in range(SHORTEST, min(LONGEST, len(w)) + 1) if w[:k] in candidates}
            yield pa.RecordBatch.from_pydict({"b": pa.array([p[0] for p in pairs], pa.string()), "before": pa.array([p[1] for p in pairs], pa.string())})

    contexts = (sample.where("toxic = 1").mapInArrow(followed, "b string, before string").groupBy("b")
                .agg(F.countDistinct("before").alias("contexts")).toPandas())
    tally = tally.merge(contexts, on="b")
    tally = tally[tally["contexts"] >= np.maximum(LEAST_CONTEXTS, 0.2 * np.minimum(tally["t"], 50))]
    plain = Grammar(_closed({b: (t, s) for b, t, s in zip(tally["b"], tally["t"], tally["bound"], strict=True)}))

    def emitted(batches):
        for batch in batches:
            got = [plain.channels(t).tolist() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array(got, pa.list_(pa.float64())), "y": batch["toxic"].cast(pa.float64())})

    # equal rows weigh by their number: a few thousand distinct vectors at most stand for the sample
    seen = sample.mapInArrow(emitted, "x array<double>, y double").groupBy("x", "y").count().toPandas()
    return Grammar(plain.insults, _weighed(np.array(seen["x"].tolist()), seen["y"].to_numpy(), seen["count"].to_numpy(float)))


def _weighed(x: np.ndarray, y: np.ndarray, n: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton steps, drawn towards the priors where a channel was not seen."""
    x, w = np.hstack([x, np.ones((len(x), 1))]), PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + pull * np.eye(len(w)), x.T @ (n * (y - p)) - pull * (w - PRIOR))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def scored(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """All columns of ``docs`` and ``toxicity`` in 0..1; only the text decides."""
    schema = extended(docs, "toxicity double")

    def run(batches):
        for batch in batches:
            new = pa.array([grammar.score(t) for t in batch["text"].to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, "toxicity"])

    return text_batches(docs).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without texts that score 0.5 or more, all columns kept."""
    grammar = fit(docs, labels)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([grammar.score(t) < 0.5 for t in batch["text"].to_pylist()], pa.bool_()))

    return text_batches(docs).mapInArrow(run, docs.schema)
