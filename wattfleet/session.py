"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


TASK_INPUT_BYTES = 4 << 20      # input bytes that one task of a large exchange stands for; rows grow many times over in memory
TASK_SHUFFLE_BYTES = 4 << 20    # small exchanges are merged up to this size
TASK_SCAN_BYTES = 16 << 20      # a scan's task sums its rows in memory before the exchange


def configure(spark: SparkSession, input_size: int = 0) -> SparkSession:
    """Apply the runtime settings every job relies on (all changeable at run time).

    With the bytes of its input, a job gets exchanges of so many tasks that the rows of one do not grow with the input: hourly rows compress to
    a few bytes, so sizes after compression alone would put millions of them into one task.
    """
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        # the JVM never compiles larger methods; rows of forty columns made one of them, run step by step
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }.items():
        spark.conf.set(key, value)
    if input_size:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_size // TASK_INPUT_BYTES))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(tasks))
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_SHUFFLE_BYTES))
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(TASK_SCAN_BYTES))
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="wattfleet-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and continue from the files, so that lost executors cost only a re-read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables the plan reads, from their statistics; no job and no optimizer run.

    Leaves without statistics count as very large, so callers fall to the path that scales.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
