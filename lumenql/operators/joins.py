"""Range joins by equal cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of a point and a range that one task may compare for one cell.
SHARE_PAIRS = 1 << 26
#: The columns that the two sides are joined by.
KEYS = ["range_level", "range_cell", "range_share"]

#: Levels of cells: widths are powers of two, a range's own between a quarter
#: and half of its length. The last is for ranges without a finite length.
_FINEST, _UNBOUNDED = -1000, 1030


def _cell(value: Column, level: Column) -> Column:
    # the further out, the coarser doubles are: cells stay within a long, and
    # what is beyond (points only) falls into the last cell on either side
    return F.floor(F.when(level == _UNBOUNDED, F.lit(0.0)).otherwise(value / F.pow(F.lit(2.0), level)))


def range_sides(
    points: DataFrame, at: Column, ranges: DataFrame, low: Column, high: Column, width: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns ``KEYS``, equal for each pair with
    ``low <= at <= high``, and for such a pair once. Both are dealt out by these
    over all cores, in tasks that a few short rows a side don't merge into one
    (it is the pairs that are many); a cell of very many pairs is shared out."""
    level, cell, share = map(F.col, KEYS)
    at, low, high = (x.cast("double") for x in (at, low, high))
    # no finer than what low can tell apart, and never zero
    length = F.greatest(high - low, F.abs(low) * F.lit(2.0**-52), F.lit(2.0 ** (_FINEST + 2)), F.lit(width or 0.0))
    own = F.when(F.isnan(length) | (length == float("inf")), F.lit(_UNBOUNDED)).otherwise(
        F.ceil(F.log2(length)) - 2
    )
    filed = ranges.filter(low <= high).withColumn(KEYS[0], own.cast("int"))
    levels = filed.select(KEYS[0]).distinct()  # a few; 2,031 at most
    filed = filed.withColumn(KEYS[1], F.explode(F.sequence(_cell(low, level), _cell(high, level))))
    dealt = points.filter(at.isNotNull()).crossJoin(F.broadcast(levels)).withColumn(KEYS[1], _cell(at, level))
    # cells of more pairs than a share: over a million pairs each, so not many
    counts = [side.groupBy(*KEYS[:2]).agg(F.count("*").alias(n)) for side, n in ((dealt, "range_n"), (filed, "range_m"))]
    shares = F.ceil(F.col("range_n").cast("double") * F.col("range_m") / SHARE_PAIRS)
    hot = counts[0].join(counts[1], KEYS[:2]).select(*KEYS[:2], F.least(shares, "range_n").alias("range_shares"))
    hot = F.broadcast(hot.filter("range_shares > 1"))
    of = F.coalesce("range_shares", F.lit(1))
    dealt = dealt.join(hot, KEYS[:2], "left").withColumn(KEYS[2], F.floor(F.rand(0) * of))
    filed = filed.join(hot, KEYS[:2], "left").withColumn(KEYS[2], F.explode(F.sequence(F.lit(0).cast("long"), of - 1)))
    tasks = 4 * points.sparkSession.sparkContext.defaultParallelism
    dealt, filed = (s.drop("range_shares").repartition(tasks, level, cell, share) for s in (dealt, filed))
    return dealt, filed.hint("merge")


def range_join(
    points: DataFrame, at: Column, ranges: DataFrame, low: Column, high: Column, width: float | None = None
) -> DataFrame:
    """Pairs with ``low <= at < high``, of numbers. Ranges are filed under every
    cell that they touch (7 at most, of a width that goes by their length) and
    points under their own of each width, so that the join is an equi-join; each
    pair meets in just the point's cell. Ranges shorter than ``width`` are filed
    like those of that length. Nulls and empty ranges match nothing."""
    dealt, filed = range_sides(points, at, ranges, low, high, width)
    return dealt.join(filed, KEYS).filter((at >= low) & (at < high)).drop(*KEYS)
