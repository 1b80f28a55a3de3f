"""Shards that all carry the corpus mixture, by proportional stratified interleaving.

Rows are shuffled by a seeded hash inside their stratum and ranked there; ``(rank - 1/2) / size of
the stratum`` orders all strata into one sequence in which every stretch holds each of them in
proportion, and equal cuts of it are the shards.

Both rankings are distributed: rows fall into cells of about ``cell_rows`` rows by a value that is
uniform by construction (the hash, then the fractional rank), cells are counted before anything is
sorted, and a row's rank is the count of earlier cells plus its place in its own. A stratum with a
third of all rows is as many cells as it needs.

Defined results: a null stratum is a stratum of its own; null texts have no bytes and the CRC of
none; repeated rows get a place each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wattfleet.llm.common import offsets

SEED = 20_24
CELL_ROWS = 4096


def interleaved(rows: DataFrame, stratum: str, keys: list[str], seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``rows`` with ``position``, a gapless 0-based place in the interleaved order, and ``n_rows``.

    ``keys`` identify a row; rows equal in all of them are interchangeable.
    """
    cells = max(1, -(-rows.count() // cell_rows))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))
    rows = rows.withColumns({"__s": F.xxhash64(stratum), "__u": unit})
    rows = rows.withColumn("__cell", F.floor(F.col("__u") * cells))
    counts = offsets(rows.groupBy("__s", "__cell").agg(F.count(F.lit(1)).alias("n")), ["__s"], "__cell")
    place = F.row_number().over(Window.partitionBy("__s", "__cell").orderBy("__u", *keys))
    ranked = rows.withColumn("__r", place).join(counts, ["__s", "__cell"])
    # Ranks are 1-based inside their stratum, so the fraction lies strictly between 0 and 1.
    ranked = ranked.withColumn("__f", (F.col("before") + F.col("__r") - 0.5) / F.col("total")).drop("before", "total", "__r", "__cell")
    ranked = ranked.withColumn("__g", F.floor(F.col("__f") * cells))
    at = offsets(ranked.groupBy("__g").agg(F.count(F.lit(1)).alias("n")), [], "__g")
    place = F.row_number().over(Window.partitionBy("__g").orderBy("__f", "__s", "__u", *keys))
    return (ranked.withColumn("__r", place).join(at, "__g")
            .withColumn("position", F.col("before") + F.col("__r") - 1)
            .withColumnRenamed("total", "n_rows").drop("__s", "__u", "__f", "__g", "__r", "before"))


def proportional_shards(docs: DataFrame, shards: int, stratum: str = "source", seed: int = SEED,
                        cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per document: ``doc_id, stratum, size, text_crc32, position, shard, slot``.

    Shards differ by one row at most, in all and in every stratum up to rounding. Slots count
    from 0 without a gap.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col(stratum).alias("stratum"), (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = interleaved(rows, "stratum", ["doc_id", "text_crc32", "size"], seed, cell_rows)
    shard = F.expr(f"position * {shards} div n_rows")
    return (placed.withColumn("shard", shard.cast("int"))
            .withColumn("slot", F.col("position") - F.expr(f"(shard * n_rows + {shards - 1}) div {shards}")).drop("n_rows"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Store the texts in one folder per shard, in slot order; ids must be unique here."""
    (docs.join(placed.select("doc_id", "shard", "slot"), "doc_id").repartition("shard")
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
