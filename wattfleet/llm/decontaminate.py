"""Benchmark decontamination as a prefix-filtered set join.

A window is 13 consecutive words of an item, or all words of a shorter item. Its tokens are its
five-word shingles, ordered by how rare they are in the corpus. All of a window must be contained, so
its necessary prefix is its one rarest shingle: only documents that hold that shingle are candidates.
A window whose rarest shingle is nowhere in the corpus is gone before the join. A candidate must have
room for the whole window around the shingle (length and positional bounds); the words themselves
are then compared.

The benchmark's windows are broadcast while they number ``BROADCAST_WINDOWS`` at most; beyond that the same
join runs as a shuffle on the shingle and candidates are joined to their documents again.

Defined results: null texts have no words; repeated document rows are each returned; repeated items
count once by id, items without an id or without words are no items; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattfleet.llm.common import NON_WORD, shingle_at, words_of

WINDOW = 13
SHINGLE = 5
BROADCAST_WINDOWS = 200_000
SHARE = 20
#: The token of the one row, at position -1, that every document contributes besides its shingles.
_SELF = 0


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, w_words, length`` for every window of every item."""
    words = items.where("item_id is not null").select("item_id", words_of(F.col("text"), NON_WORD).alias("w")).where("size(w) > 0")
    last = F.greatest(F.size("w") - window, F.lit(0))
    return (words.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
            .select("item_id", F.expr(f"slice(w, at + 1, {window})").alias("w_words"))
            .distinct().withColumn("length", F.size("w_words")))


def _shingle_sizes(windows: DataFrame) -> list[int]:
    """Shingle lengths in use: five words, or the whole of a window shorter than that (at most five values)."""
    return sorted(r[0] for r in windows.select(F.least("length", F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]


def _window_tokens(windows: DataFrame, sizes: list[int]) -> DataFrame:
    own = F.least(F.col("length"), F.lit(SHINGLE))
    rows = windows.select("*", F.explode(F.sequence(F.lit(0), F.col("length") - own)).alias("offset"))
    hashes = F.coalesce(*[F.when(own == k, shingle_at(F.col("w_words"), F.col("offset"), k)) for k in sizes])
    return rows.withColumn("h", hashes)


def _spread(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """One row per shingle of a document, with its word position, and one row for the document itself."""
    n = F.size("words")
    rows = docs.select(*docs.columns, F.explode(F.sequence(F.lit(-1), F.greatest(n - min(sizes), F.lit(-1)))).alias("pos"))
    at = F.col("pos")
    here = [F.when(at < 0, F.lit(_SELF).cast("long") if k == sizes[0] else None).when(at + k <= n, shingle_at(F.col("words"), at, k)) for k in sizes]
    if len(sizes) == 1:
        return rows.withColumn("h", here[0])
    return rows.select("*", F.explode(F.array(*here)).alias("h")).where("h is not null")


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``doc_id, text_key, n_words, copies`` of every document, with ``spans`` (start and length in words)
    and ``item_ids`` of all windows that occur in it. Rows equal in id and text are one row here."""
    windows = item_windows(items, window)
    sizes = _shingle_sizes(windows)
    tokens = _window_tokens(windows, sizes)
    small = windows.count() <= broadcast_windows
    hint = F.broadcast if small else (lambda df: df)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text"), NON_WORD).alias("words"))

    seen = _spread(texts.select("words"), sizes).select("h")
    rarity = seen.join(hint(tokens.select("h").distinct()), "h").groupBy("h").agg(F.count(F.lit(1)).alias("freq"))
    rarest = F.min_by(F.struct("h", "offset"), F.struct("freq", "h", "offset")).alias("t")
    prefix = (tokens.join(rarity, "h", "left")
              .groupBy("item_id", "w_words", "length")
              .agg(rarest, F.min(F.coalesce("freq", F.lit(0))).alias("least"))
              # a shingle that no document has: the window cannot occur
              .where("least > 0").select("item_id", "w_words", "length", "t.h", "t.offset"))
    myself = docs.sparkSession.range(1).select(
        F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(None).cast("array<string>").alias("w_words"),
        F.lit(0).alias("length"), F.lit(_SELF).cast("long").alias("h"), F.lit(0).alias("offset"))
    start = (F.col("pos") - F.col("offset")).alias("start")
    fits = (F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words"))
    equal = F.expr("slice(words, start + 1, length)") == F.col("w_words")
    texts = texts.withColumn("n_words", F.size("words"))
    if small:
        found = (_spread(texts, sizes).join(hint(prefix.unionByName(myself)), "h").withColumn("start", start)
                 .where(F.when(F.col("pos") < 0, F.col("item_id").isNull()).otherwise(fits & equal)))
    else:
        near = (_spread(texts, sizes).drop("words").join(prefix, "h").withColumn("start", start).where(fits)
                .drop("n_words", "pos", "h", "offset"))
        same = (near["doc_id"].eqNullSafe(texts["doc_id"])) & (near["text_key"] == texts["text_key"])
        hits = texts.join(near, same).where(equal).select(texts["*"], "item_id", "start", "length").drop("words")
        # copies of a row would each find each other's candidates: once is enough
        found = hits.distinct().unionByName(texts.drop("words").withColumns({
            "item_id": F.lit(None).cast(items.schema["item_id"].dataType), "start": F.lit(0), "length": F.lit(0)}))
    mine = F.col("item_id").isNull()
    return found.groupBy("doc_id", "text_key", "n_words").agg(
        F.sum(mine.cast("int")).alias("copies"),
        F.collect_set(F.when(~mine, F.struct("start", "length"))).alias("spans"),
        F.collect_set("item_id").alias("item_ids"))


def judged(found: DataFrame, share: int = SHARE) -> DataFrame:
    """``occurrences`` with ``n_hit`` (words inside any span) and ``contaminated`` (a 1/``share`` part at least)."""
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    n_hit = F.size(F.array_distinct(covered)).cast("long")
    return (found.withColumn("n_hit", n_hit)
            .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))))


def report(docs: DataFrame, items: DataFrame, **limits) -> DataFrame:
    """The digest per document row: words, hit words, items, verdict."""
    rows = judged(occurrences(docs, items, **limits))
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return (rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit",
                    F.size("item_ids").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"), "contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents, all columns kept."""
    bad = judged(occurrences(docs, items)).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__key"))
    return docs.join(bad, same, "left_anti")
