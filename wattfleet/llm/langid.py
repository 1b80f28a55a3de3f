"""Language identification with error-correcting output codes.

Each language has a codeword; each bit of it is predicted by one binary classifier over hashed byte
trigrams of the lower-cased text (non-letters of ASCII count as blanks). A bit's weights are the log ratio of
trigram rates in the languages with that bit set to those in the others, from counts over all
learning rows. Decoding sums a logistic loss between the bits' margins and each codeword, weighted by how
reliable each bit was on a bounded sample of learning rows, and takes the codeword of least loss.

Up to ``EXHAUSTIVE`` languages every split of the languages is a bit; beyond that codewords are seeded random
bits, the draw with the largest least distance of ``DRAWS``.

Defined results: ``und`` with score 0 for texts that are null or hold no letter, and for all if nothing can be
learnt; rows without text, language or id teach nothing; ties go to the language first in the alphabet;
repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattfleet.llm.common import crc_fold, extended, text_batches

FOLDS = 5
UNDETERMINED = "und"
FEATURES = 1 << 16
#: Learning rows the reliability of bits is measured on, at most.
RELIABILITY_ROWS = 4_000
EXHAUSTIVE = 7
DRAWS = 64
#: The lead of the best language over the next, below which a text is flagged as ambiguous.
AMBIGUOUS = 0.05
#: The score from which a decoded language replaces the one that a document carries.
CONFIDENT = 0.9
_TO_BLANK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def trigrams(text: str) -> np.ndarray:
    """Feature indices of a text's byte trigrams, with a blank at either end."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_TO_BLANK) + b" ", np.uint8).astype(np.uint32)
    mixed = (raw[:-2] * 0x9E3779B1 + raw[1:-1] * 0x85EBCA6B + raw[2:] * 0xC2B2AE35).astype(np.uint32)
    return (mixed ^ (mixed >> 15)) & (FEATURES - 1)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """Bits (0/1) of ``n`` languages, one row each; all columns split the languages."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= EXHAUSTIVE:
        return np.array([[1 if i == 0 else (b >> (i - 1)) & 1 for b in range((1 << (n - 1)) - 1)] for i in range(n)], np.int8)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(DRAWS):
        m = rng.integers(0, 2, (n, math.ceil(10 * math.log2(n)))).astype(np.int8)
        m = m[:, (m.min(0) == 0) & (m.max(0) == 1)]
        d = (m[:, None, :] != m[None, :, :]).sum(2) + np.eye(n, dtype=int) * m.shape[1]
        if d.min() > far:
            best, far = m, d.min()
    return best


class Model:
    """Languages, their codewords, bit weights (features x bits) and bit reliabilities."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        rates = (counts + 0.1) / (counts + 0.1).sum(1, keepdims=True)
        self.weights = np.zeros((FEATURES, self.code.shape[1]), np.float32)
        for b in range(self.code.shape[1]):
            on = self.code[:, b] == 1
            if on.any() and not on.all():
                self.weights[:, b] = np.log(rates[on].mean(0)) - np.log(rates[~on].mean(0))
        self.trust = np.ones(self.code.shape[1])

    def margins(self, text: str) -> np.ndarray:
        """Mean log ratio per bit, less of it for very short texts."""
        at = trigrams(text)
        return self.weights[at].sum(0, dtype=np.float64) / (len(at) + 3)

    def calibrate(self, margins: np.ndarray, truth: np.ndarray) -> None:
        """Weigh each bit by its accuracy above chance."""
        if len(margins):
            right = ((margins > 0) == (self.code[truth] == 1)).mean(0)
            self.trust = np.maximum(2 * right - 1, 0.01)

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """Language, score in 0..1 and whether the next best is about as good."""
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        signs = 2.0 * self.code - 1
        loss = (np.logaddexp(0, -8 * signs * margins) * self.trust).sum(1) / self.trust.sum()
        odds = np.exp(-(loss - loss.min()) * 4)
        share = odds / odds.sum()
        best, second = np.argsort(-share, kind="stable")[:2]
        return self.languages[best], float(share[best]), bool(share[best] - share[second] < AMBIGUOUS)


def _learning(docs: DataFrame) -> DataFrame:
    fold = crc_fold(F.col("doc_id"), FOLDS)
    return docs.where((fold != 0) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
            own = total.setdefault(lang, np.zeros(FEATURES, np.int64))
            own += np.bincount(trigrams(text), minlength=FEATURES)
    for lang, own in total.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "feature": pa.array(at.astype(np.int32)), "n": pa.array(own[at])})


def fit(docs: DataFrame) -> Model | None:
    """Counts over all learning rows, reliabilities over a sample of ``RELIABILITY_ROWS`` by a hash of the id.

    Languages x 65,536 counts come to the driver, whatever the number of rows.
    """
    rows = _learning(docs)
    sums = (text_batches(rows).mapInArrow(_count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas())
    if sums.empty:
        return None
    languages = sorted(sums["lang"].unique())
    counts = np.zeros((len(languages), FEATURES))
    index = {x: i for i, x in enumerate(languages)}
    counts[sums["lang"].map(index).to_numpy(), sums["feature"].to_numpy()] = sums["n"].to_numpy()
    model = Model(languages, counts)

    def measure(batches):
        for batch in batches:
            at = [(index[lang], model.margins(text).tolist()) for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["h"], pa.array([x for x, _ in at], pa.int32()), pa.array([x for _, x in at], pa.list_(pa.float64()))],
                                             ["h", "lang", "margins"])

    share = min(1.0, 2 * RELIABILITY_ROWS / max(1, rows.count()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    thin = rows.where(place < int(share * (1 << 30))).select(place.alias("h"), "text", "lang")
    # in the order of the hash, whatever the order of the files; only margins are ordered, not texts
    got = text_batches(thin).mapInArrow(measure, "h long, lang int, margins array<double>").orderBy("h", "lang", "margins").limit(RELIABILITY_ROWS).toPandas()
    if len(got):
        model.calibrate(np.array(got["margins"].tolist()), got["lang"].to_numpy())
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``score`` and ``ambiguous``; only the text decides."""
    # The whole row passes through Arrow, so nothing has to be joined back by id.
    schema = extended(docs, "lang_pred string, score double, ambiguous boolean")

    def run(batches):
        for batch in batches:
            out = []
            for text in batch["text"].to_pylist():
                if model is None or text is None or not any(map(str.isalpha, text)):
                    out.append((UNDETERMINED, 0.0, False))
                else:
                    out.append(model.decode(model.margins(text)))
            new = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return text_batches(docs).mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return predict(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without texts that have no language (null, or no letter), and with ``lang`` as decoded.

    The model of the rows' own labels decodes every text. Its language fills a missing ``lang`` unless it is ambiguous, and replaces
    another one from the score ``CONFIDENT``. It rejects no text that has letters: every language stays, and an ambiguous one too.
    Where no row teaches a language, and where ``docs`` has no column of this name, ``lang`` is left as it is.
    """
    model = fit(docs) if dict(docs.dtypes).get("lang") == "string" else None
    sent = docs.sparkSession.sparkContext.broadcast(model)      # languages x FEATURES weights

    def run(batches):
        own = sent.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            keep = [t is not None and any(map(str.isalpha, t)) for t in texts]
            if own is not None:
                langs = batch["lang"].to_pylist()
                for i, t in enumerate(texts):
                    if keep[i]:
                        best, score, doubt = own.decode(own.margins(t))
                        if score >= CONFIDENT or (langs[i] is None and not doubt):
                            langs[i] = best
                at = batch.schema.get_field_index("lang")
                batch = batch.set_column(at, batch.schema.field(at), pa.array(langs, batch.schema.field(at).type))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return text_batches(docs).mapInArrow(run, docs.schema)
