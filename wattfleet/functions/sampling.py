"""Seeded samples by a hash of the row key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattfleet.schema import IDENTIFIERS

SEED = 42
_RANGE = 1 << 30


def hash_sample(df: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows chosen by a hash of their key; the same rows whatever the partitioning.

    Only rows whose hash falls in a share that holds about twice ``n`` rows are sorted, so
    the final top-n stays small however large the table is.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = F.least(F.lit(1.0), (2 * n + 1000) / F.greatest(total, F.lit(1)))
    place = F.pmod(F.xxhash64(*[F.col(c) for c in IDENTIFIERS], F.lit(seed)), F.lit(_RANGE))
    return (df.withColumn("__h", place).where(F.col("__h") < share * _RANGE)
            .orderBy("__h", *IDENTIFIERS).limit(int(n)).drop("__h"))
