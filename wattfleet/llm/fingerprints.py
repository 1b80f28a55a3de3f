"""Document fingerprints as threshold-scaled sketches.

A document's shingles are its runs of five words, lower-cased (all words as one where there are fewer).
The sketch keeps every shingle hash below a fixed fraction of the hash range, whatever the document's
length, so sketches of unequal documents stay comparable, the sketch of a union is the union of the sketches, and
the share of one sketch found in another estimates how much of the one document the other contains.
A document with no hash below the threshold keeps its least hash alone; unions keep that property.

Defined results: null texts count as empty; an empty text has the empty fingerprint, two of
which are alike (1), while it is unlike any other (0); equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattfleet.llm.common import BLANKS, shingle_hashes, words_of
from wattfleet.session import materialize

SHINGLE = 5
#: Hashes are 48 bits wide; one in ``FRACTION`` is kept.
BITS = 48
FRACTION = 8


def with_sketch(rows: DataFrame, text: str, name: str, fraction: int = FRACTION) -> DataFrame:
    """``rows`` with the sorted kept hashes of the column ``text`` as column ``name``."""
    w, h, kept = F.col("__w"), F.col("__h"), F.col("__kept")
    whole = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    mask = (1 << BITS) - 1
    rows = rows.withColumn("__w", words_of(F.col(text), BLANKS))
    rows = rows.withColumn("__h", F.when(F.size(w) >= SHINGLE, shingle_hashes(w, SHINGLE)).otherwise(whole))
    rows = rows.withColumn("__kept", F.filter("__h", lambda x: x.bitwiseAND(mask) < (1 << BITS) // fraction))
    rows = rows.withColumn("__kept", F.when(F.size(kept) > 0, kept).otherwise(h))
    low = F.sort_array(F.array_distinct(F.transform(kept, lambda x: x.bitwiseAND(mask))))
    rows = rows.withColumn(name, low)
    least = F.when(F.get(name, F.lit(0)) >= (1 << BITS) // fraction, F.slice(name, 1, 1)).otherwise(F.col(name))
    return rows.withColumn(name, least).drop("__w", "__h", "__kept")


def merged(a: Column, b: Column, fraction: int = FRACTION) -> Column:
    """The sketch of two documents' shingles together."""
    both = F.array_union(a, b)
    kept = F.filter(both, lambda h: h < (1 << BITS) // fraction)
    return F.sort_array(F.when(F.size(kept) > 0, kept).otherwise(F.slice(F.sort_array(both), 1, 1)))


def contained(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; 0 for an empty ``a``."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0)), F.lit(0.0))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger, 1 for two empty ones."""
    small = F.least(F.size(a), F.size(b))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(small == 0, 0.0)
            .otherwise(F.size(F.array_intersect(a, b)) / small))


def as_text(kept: Column) -> Column:
    """Twelve hex digits per kept hash, in order."""
    return F.array_join(F.transform(kept, lambda h: F.lower(F.lpad(F.hex(h), 12, "0"))), "")


def with_next(ids: DataFrame) -> DataFrame:
    """Distinct ``doc_id`` with ``next_id``: the next lower id, for the lowest one the highest.

    Ids are dealt by range and stored with their range, so that each task orders one range only;
    the last id of a range takes the first of the next range that has rows.
    """
    dealt = ids.distinct().repartitionByRange(F.col("doc_id").desc()).withColumn("__part", F.spark_partition_id())
    stored = materialize(dealt, "id-order")
    inside = Window.partitionBy("__part").orderBy(F.col("doc_id").desc())
    edges = stored.groupBy("__part").agg(F.max("doc_id").alias("__first"))
    around = Window.orderBy("__part")       # one row per range
    edges = edges.withColumn("__follow", F.coalesce(F.lead("__first").over(around),
                                                    F.first("__first").over(around.rowsBetween(Window.unboundedPreceding, 0))))
    return (stored.withColumn("__lead", F.lead("doc_id").over(inside)).join(edges, "__part")
            .select("doc_id", F.coalesce("__lead", "__follow").alias("next_id")))


def fingerprints(docs: DataFrame, fraction: int = FRACTION) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch`` of every document row.

    The edited text has its last third replaced by the start of the next document. Ids that repeat stand
    for one document in that order, the one whose start is least; null ids come after all others (and the lowest long counts as null).
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    # Both joins read these two columns alone, so that the texts are dealt out once.
    full = docs.select(F.coalesce("doc_id", lowest).alias("__id"), F.coalesce("text", F.lit("")).alias("text"))
    order = with_next(full.select(F.col("__id").alias("doc_id"))).withColumnRenamed("doc_id", "__id")
    # A document sends the part that the one before it needs, and its sketch, instead of its text. The sketch is made
    # behind the join, so that the exchange in front of it is the one that the second join reads again.
    need = (full.groupBy("__id").agg(F.max(F.expr("char_length(text) div 3")).alias("take"))
            .join(order, "__id").select(F.col("next_id").alias("__at"), F.col("__id").alias("__to"), "take"))
    sent = with_sketch(full.join(need, F.col("__id") == F.col("__at")).select("__to", "take", "text"), "text", "next_sketch", fraction).select(
        F.col("__to").alias("__id"), F.expr("substring(text, 1, cast(take as int))").alias("piece"), "next_sketch")
    sent = sent.groupBy("__id").agg(F.min(F.struct("piece", "next_sketch")).alias("s")).select("__id", "s.*")
    rows = full.join(sent, "__id").withColumn("n_chars", F.char_length("text").cast("long"))
    take = F.expr("cast(n_chars div 3 as int)")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - take),
                                              F.substring("piece", F.lit(1), take)))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = with_sketch(with_sketch(rows, "text", "sketch", fraction), "edited", "edited_sketch", fraction)
    return rows.select(F.nullif("__id", lowest).alias("doc_id"), "n_chars", "edited_sha256", "sketch", "edited_sketch", "next_sketch")


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints as text, with their likeness."""
    return fingerprints(docs).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
