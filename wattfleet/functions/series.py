"""Row-ordered functions over meter series.

One plain window per series is the cheapest plan: one exchange, one sort. It holds as long as
every series fits a task. Inputs above ``SPLIT_BYTES`` are therefore measured first (a count
over the key columns), and when the longest series exceeds ``LONG_SERIES`` rows all series
are cut into segments of equal row count, each with a copy of the rows its frames look back
to. Both ways give the same rows: NULL keys form a series of their own, NULL times come first.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from wattfleet.schema import SERIES_KEYS
from wattfleet.session import input_bytes

SPLIT_BYTES = 8 << 30
LONG_SERIES = 2_000_000     # over two centuries of hours
SEGMENT_ROWS = 1 << 14

_BLOCK, _POS, _SEG, _OWN = "__block", "__pos", "__seg", "__own"


def should_split(df: DataFrame, keys: Sequence[str], split: bool | None) -> bool:
    """An explicit choice wins; otherwise split a large input that has a very long series."""
    if split is not None:
        return split
    if input_bytes(df) <= SPLIT_BYTES:
        return False
    longest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (longest or 0) > LONG_SERIES


def _beside(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join in which NULL keys match each other, as they do in a window's partition."""
    named = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on]
    return left.join(named, same, "left").drop(*[f"__r_{c}" for c in on])


def _order(order: Sequence[str], descending: bool = False) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def _positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], segment_rows: int, descending: bool = False,
) -> DataFrame:
    """Zero-based position of each row in its series and the segment it falls in.

    Rows are ranked inside (series, day); the day sizes, pre-aggregated on the map side, supply
    the offset. The longest sort is one day of one series.
    """
    blocked = df.withColumn(_BLOCK, F.date_trunc("day", F.col(order[0])))
    in_block = Window.partitionBy(*keys, _BLOCK).orderBy(*_order(order, descending))
    earlier = Window.partitionBy(*keys).orderBy(*_order([_BLOCK], descending)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*keys, _BLOCK).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .drop("__n")
    )
    return (
        _beside(blocked.withColumn("__rn", F.row_number().over(in_block)), offsets, [*keys, _BLOCK])
        .withColumn(_POS, F.coalesce("__before", F.lit(0)) + F.col("__rn") - 1)
        .withColumn(_SEG, F.floor(F.col(_POS) / segment_rows))
        .drop("__before", "__rn", _BLOCK)
    )


#: Weights of the kinds of value in a packed count, of which any frame holds fewer than 2^16.
_INFINITE, _OTHER = 1 << 16, 1 << 32
_GRID = float(1 << 10)


def sliding_means(w: WindowSpec, value: Column, names: Mapping[str, int], current: bool = False) -> list[dict[str, Column]]:
    """Means of the last ``n`` rows, before the current one or with it, at a cost per row that does not grow with ``n``.

    Two steps for ``trailing``: sums from the start of the series or segment, and their differences at two positions. Values are
    cut into a multiple of 2^-10, whose sums are exact (below 2^43), and a rest that is small, so that a
    difference carries no error of far larger values before the frame. NULL counts as absent, as in ``avg``; frames with
    infinite or undefined values are told by their counts and give what ``avg`` gives.
    """
    v = value.cast("double")
    finite = F.abs(v) < float("inf")
    whole = F.rint(v * _GRID) / _GRID
    count = F.when(finite, F.lit(1)).when(v == float("inf"), F.lit(_INFINITE)).when(v.isNotNull(), F.lit(_OTHER)).otherwise(F.lit(0))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    total = lambda c, zero: F.coalesce(F.sum(c).over(so_far), zero)
    zero = F.lit(0.0)
    sums = {"__p_whole": total(F.when(finite, whole), zero), "__p_rest": total(F.when(finite, v - whole), zero),
            "__p_count": total(count.cast("long"), F.lit(0).cast("long"))}

    def mean(n: int) -> Column:
        between = lambda c: F.col(c) - F.coalesce(F.lag(c, n).over(w), F.lit(0))
        packed = between("__p_count")
        known = packed % _INFINITE
        clean = (between("__p_whole") + between("__p_rest")) / F.nullif(known, F.lit(0))
        return (F.when(packed == known, clean).when(packed >= _OTHER, F.lit(float("nan"))).otherwise(F.lit(float("inf"))))

    return [sums, {name: mean(n) for name, n in names.items()}]


def trailing(
    df: DataFrame,
    make: Callable[[WindowSpec], dict[str, Column] | list[dict[str, Column]]],
    keys: Sequence[str] = SERIES_KEYS,
    order: Sequence[str] = ("timestamp",),
    reach: int = 168,
    split: bool | None = None,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Add window columns whose frames look back at most ``reach`` rows and never ahead.

    ``make`` gives the columns, or several steps of which later ones may use earlier ones; columns
    named ``__p_…`` are dropped at the end.
    """
    def added(rows: DataFrame, w: WindowSpec) -> DataFrame:
        steps = make(w)
        for step in steps if isinstance(steps, list) else [steps]:
            rows = rows.withColumns(step)
        return rows.drop(*[c for c in rows.columns if c.startswith("__p_")])

    if not should_split(df, keys, split):
        return added(df, Window.partitionBy(*keys).orderBy(*_order(order)))
    if reach > segment_rows:
        raise ValueError("a segment must be at least as long as the frames reach")
    own = F.struct(F.col(_SEG).alias("seg"), F.lit(True).alias("own"))
    lent = F.struct((F.col(_SEG) + 1).alias("seg"), F.lit(False).alias("own"))
    near_end = F.col(_POS) % segment_rows >= segment_rows - reach
    copies = (
        _positions(df, keys, order, segment_rows)
        .withColumn("__to", F.explode(F.when(near_end, F.array(own, lent)).otherwise(F.array(own))))
        .withColumn(_SEG, F.col("__to.seg")).withColumn(_OWN, F.col("__to.own")).drop("__to")
    )
    w = Window.partitionBy(*keys, _SEG).orderBy(_POS)
    return added(copies, w).where(_OWN).drop(_POS, _SEG, _OWN)


def running_last(
    df: DataFrame,
    values: Callable[[Column], dict[str, Column]],
    keys: Sequence[str] = SERIES_KEYS,
    order: Sequence[str] = ("timestamp",),
    split: bool | None = None,
    segment_rows: int = SEGMENT_ROWS,
    position: str | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add, per row, the last non-null value seen so far in its series.

    ``values`` maps the column of row positions to the expressions to carry. With
    ``position`` the zero-based position is kept under that name.
    """
    if not should_split(df, keys, split):
        w = Window.partitionBy(*keys).orderBy(*_order(order, descending))
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        placed = df.withColumn(_POS, (F.row_number().over(w) - 1).cast("long"))
        out = placed.withColumns(
            {n: F.last(v, ignorenulls=True).over(so_far) for n, v in values(F.col(_POS)).items()})
    else:
        exprs = values(F.col(_POS))
        placed = _positions(df, keys, order, segment_rows, descending)
        so_far = (
            Window.partitionBy(*keys, _SEG).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0))
        earlier = Window.partitionBy(*keys).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            placed.groupBy(*keys, _SEG)
            .agg(*[F.max_by(v, F.when(v.isNotNull(), F.col(_POS))).alias(f"__c_{n}")
                   for n, v in exprs.items()])
            .withColumns({f"__c_{n}": F.last(f"__c_{n}", ignorenulls=True).over(earlier) for n in exprs})
        )
        local = placed.withColumns({f"__l_{n}": F.last(v, ignorenulls=True).over(so_far) for n, v in exprs.items()})
        out = (
            _beside(local, carried, [*keys, _SEG])
            .withColumns({n: F.coalesce(f"__l_{n}", f"__c_{n}") for n in exprs})
            .drop(_SEG, *[f"__l_{n}" for n in exprs], *[f"__c_{n}" for n in exprs])
        )
    return out.withColumnRenamed(_POS, position) if position else out.drop(_POS)
