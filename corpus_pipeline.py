"""Corpus clean-up as stages over ``documents``: language, toxicity, near copies, benchmark passages, pieces.

Each stage works on all that the one before kept and returns the columns of documents; the last
one adds the piece ids. Labels are read for what they teach, by id, as in the toxicity query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattfleet.llm import decontaminate, langid, neardup, pieces, toxicity
from wattfleet.llm.common import table
from wattfleet.session import materialize

#: No SQL states the language and toxicity models.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null, or no letter) go; the others carry the language that the model decodes, where it is sure."""
    return langid.keep_identified(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score 0.5 or more go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id."""
    return neardup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are a twentieth or more go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they decode to it."""
    return pieces.encoded(docs, pieces.load(pieces.default_path()))


STAGES = [
    ("language_id", language_id), ("toxicity", toxicity_filter), ("near_dedup", near_dedup),
    ("decontamination", decontamination), ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
