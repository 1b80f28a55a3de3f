"""Exact, linearly interpolated quantiles that hold at any group size.

``percentile`` keeps a value-to-count map of the whole group in one task. That is the right
choice for small inputs. Above ``REFINE_BYTES``, or ``MAP_BYTES`` where one or a few groups hold all rows, the quantile is found by narrowing: each scan counts
values per cell on the map side, and only the cells that hold the wanted ranks, at most two per group, are looked
into by the next. Cells carry their least and greatest value, so it ends once these are equal: as
a rule after two scans, after four at most. What is shuffled are cell counts, never the values themselves, and they are hashed by (group, cell), so a
group with a third of all rows spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattfleet.session import input_bytes, materialize

REFINE_BYTES = 1 << 30
MAP_BYTES = 16 << 20    # values that hardly repeat take some 8 bytes each in a file and a hundred in the map of a task
_COARSE = 4096          # cells per unit of log1p: neighbours differ by 0.025 %
_FINE = 1 << 20         # linear cells inside one cell


def exact_quantile(
    df: DataFrame, groups: Sequence[str], value: str, prob: float, name: str, refine: bool | None = None, weight: str | None = None,
) -> DataFrame:
    """One row per group: the interpolated ``prob`` quantile of the values that are neither NULL nor NaN.

    With ``weight``, a column of whole numbers, a row counts that many times.
    """
    if refine is None:
        refine = input_bytes(df) > REFINE_BYTES if groups else one_map_is_too_small(df)
    times = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    rows = df.select(*groups, F.col(value).cast("double").alias("__v"), times.alias("__w"))
    rows = rows.where(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.col("__w") > 0))
    for g in groups:
        rows = rows.where(F.col(g).isNotNull())
    if not refine:
        return rows.groupBy(*groups).agg(F.percentile("__v", F.lit(prob), F.col("__w")).alias(name))
    return _refined(rows, list(groups), prob, name)


def one_map_is_too_small(df: DataFrame) -> bool:
    """Whether the values of the table may be too many for the map of one task: for one group, or groups as few as meters."""
    return input_bytes(df) > MAP_BYTES


def _refined(rows: DataFrame, groups: list[str], prob: float, name: str) -> DataFrame:
    keys = groups or ["__all"]
    if not groups:
        rows = rows.withColumn("__all", F.lit(0))
    v = F.col("__v")
    width = [F.sum("__w").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")]
    held = ["__lo", "__hi", "__n", "__rank", "__below"]
    by_key = Window.partitionBy(*keys)
    cells = (
        rows.groupBy(*keys, F.floor(F.signum(v) * F.log1p(F.abs(v)) * _COARSE).alias("__cell")).agg(*width)
        .withColumn("__below", F.sum("__n").over(by_key.orderBy("__cell")) - F.col("__n"))
        .withColumn("__rank", (F.sum("__n").over(by_key) - 1) * F.lit(float(prob)))
    )
    cells = materialize(_holding(cells).select(*keys, *held), "quantile-cells")
    while not cells.where("__lo < __hi").isEmpty():
        # Cells that are one value need no look; the others are cut again, and only their rows are counted.
        wide = cells.where("__lo < __hi").withColumnRenamed("__lo", "__from").withColumnRenamed("__hi", "__to").drop("__n")
        place = F.floor((v - F.col("__from")) / (F.col("__to") - F.col("__from")) * _FINE)
        inside = rows.join(wide, keys).where((v >= F.col("__from")) & (v <= F.col("__to")))
        finer = (
            inside.groupBy(*keys, "__from", "__rank", "__below", place.alias("__cell")).agg(*width)
            .withColumn("__below", F.col("__below") + F.sum("__n").over(
                Window.partitionBy(*keys, "__from").orderBy("__cell")) - F.col("__n"))
        )
        cells = materialize(cells.where("__lo = __hi").unionByName(_holding(finer).select(*keys, *held)), "quantile-cells")
    low, high = F.floor("__rank"), F.ceil("__rank")
    at = lambda r: F.max(F.when((F.col("__below") <= r) & (F.col("__below") + F.col("__n") > r), F.col("__lo")))
    found = cells.groupBy(*keys).agg(at(low).alias("__a"), at(high).alias("__b"), F.first("__rank").alias("__rank"))
    between = (high - F.col("__rank")) * F.col("__a") + (F.col("__rank") - low) * F.col("__b")
    return found.select(*groups, F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(between).alias(name))


def _holding(cells: DataFrame) -> DataFrame:
    """Cells whose rank range meets the two ranks the interpolation needs."""
    return cells.where((F.col("__below") <= F.ceil("__rank")) & (F.col("__below") + F.col("__n") > F.floor("__rank")))


def medians_row(df: DataFrame, columns: Sequence[str], refine: bool | None = None) -> DataFrame:
    """One row with the median of each column, all found in the same passes."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("m")).select("m.name", "m.value")
    table = exact_quantile(stacked, ["name"], "value", 0.5, "median", refine)
    return table.agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in columns])


def median_of(df: DataFrame, column: str, refine: bool | None = None, weight: str | None = None) -> Column:
    """The overall median of a column as a scalar subquery."""
    return exact_quantile(df, [], column, 0.5, "median", refine, weight).scalar()
