"""Column helpers the corpus operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

#: Separators of ``[^\x20\x09-\x0D]+`` words and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` words.
BLANKS = r"[\x20\x09-\x0D]+"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: Rows and bytes of one Arrow batch of texts: a task holds a few copies of it at once, in the JVM and in Python.
TEXT_ROWS = 1_000
TEXT_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, whose Arrow batches hold at most ``TEXT_ROWS`` rows and about ``TEXT_BYTES`` (settings of the session)."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))
    return df


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` and the columns of ``ddl`` after it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def ascii_lower(text: Column) -> Column:
    """``A-Z`` in lower case, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column, separators: str) -> Column:
    """Lower-cased words; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), separators), "")


def shingle_at(words: Column, at: Column, k: int) -> Column:
    """A 64-bit hash of the ``k`` words from position ``at``. Outside a lambda it compiles to plain code."""
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def shingle_hashes(words: Column, k: int) -> Column:
    """``shingle_at`` for every position, in order; empty where there are fewer words.

    ``words`` must be a stored column: an expression would be worked out again for every word.
    """
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - k), lambda i: shingle_at(words, i, k))
    return F.when(n >= k, each).otherwise(F.array().cast("array<bigint>"))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """``crc32(doc_id as text) mod folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def offsets(cells: DataFrame, keys: list[str], cell: str, width: int = 4096) -> DataFrame:
    """``keys, cell, before``: rows of earlier cells of the same keys, and ``total`` of all of them.

    Runs over blocks of ``width`` cells first, so that no task sorts all cells of one key.
    """
    high = cells.withColumn("__hi", F.floor(F.col(cell) / width))
    blocks = high.groupBy(*keys, "__hi").agg(F.sum("n").alias("__b"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    blocks = (blocks.withColumn("total", F.sum("__b").over(over))
              .withColumn("__base", F.sum("__b").over(over.orderBy("__hi")) - F.col("__b")).drop("__b"))
    inside = Window.partitionBy(*keys, "__hi").orderBy(cell)
    return (high.withColumn("__in", F.sum("n").over(inside) - F.col("n")).join(blocks, [*keys, "__hi"])
            .select(*keys, cell, (F.col("__base") + F.col("__in")).alias("before"), "total"))
