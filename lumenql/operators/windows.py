"""Window specifications with explicit frames: with an order the default frame
is ROWS from the start to the current row, without one the whole partition."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

FIRST, LAST, HERE = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow


def frame(partition=(), order=(), rows: tuple | None = None, values: tuple | None = None) -> WindowSpec:
    """``rows`` and ``values`` are (start, end) of a ROWS or RANGE frame."""
    if rows and values:
        raise ValueError("a window has one frame")
    bounds = rows or values
    if bounds and (bounds[0] == LAST or bounds[1] == FIRST or bounds[0] > bounds[1]):
        raise ValueError("a frame can't start behind its end")
    spec = Window.partitionBy(*partition)
    if order:
        spec = spec.orderBy(*order)
    if values:
        return spec.rangeBetween(*values)
    return spec.rowsBetween(*(rows or ((FIRST, HERE) if order else (FIRST, LAST))))


def ranking(partition=(), order=()) -> WindowSpec:
    """For functions that bring their own frame (row numbers, ranks, lag, lead)."""
    return Window.partitionBy(*partition).orderBy(*order)


def _shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to ``spark.checkpoint.dir``; where that is unset, to a
    folder of our own if driver and tasks are one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="lumenql-")
        context.setCheckpointDir(root)


def numbered(df: DataFrame, *order, name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 1) in ``order``, which no task sees
    whole: rows are dealt out by ranges of it, numbered in their range, and
    moved on by the rows of the ranges before. ``order`` should be total: rows
    that tie are placed in any order, and a group of ties is one range's."""
    _shared_checkpoints(df.sparkSession)
    part, start = f"{name}_part", f"{name}_start"
    # checkpointed: ranges are sampled once, and what follows sees the same ones
    dealt = df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()).checkpoint()
    before = Window.orderBy(part).rowsBetween(FIRST, -1)
    counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(start))  # a row for each range
    starts = counts.select(part, F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start))
    within = ranking((part,), order)
    placed = dealt.join(F.broadcast(starts), part)
    return placed.withColumn(name, F.col(start) + F.row_number().over(within)).drop(part, start)
