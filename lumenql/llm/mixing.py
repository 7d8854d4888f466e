"""Mixing sources to target weights by capped water-filling.

Every source gets a share of all words in proportion to its weight, but never
more than ``max_epochs`` times its own words; what a capped source leaves is
shared again by weight until no source is above its cap. Documents are then
repeated: whole repetitions for all, and one more, in a seeded order, for
documents until the source's target is reached (the last such document gives
the part of its words that is missing).

Defined results: a null text has size 0; a null source is a source of its own
and sorts last; an empty table gives an empty mix; rows that repeat are mixed
as separate documents (identical rows share one place in the seeded order, in
any order among themselves); a source without words has target 0. Columns of
the input stay; columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE_WORD, free_name, materialise, small_side, table

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "lumen"
#: Hexadecimal digits of the seeded key that name a coarse and a fine bucket.
#: A source's order is settled by coarse buckets, by the fine ones of one coarse
#: bucket, and row by row only in one fine bucket: a source of any size gives a
#: task at most 256 buckets.
COARSE_DIGITS, BUCKET_DIGITS = 2, 4


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their place (from 0) by code point, null last, without
    bringing all of them into one task."""
    n = "mix_part"
    parts = materialise(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn(
            n, F.spark_partition_id()
        ),
        "mix-sources",
    )
    before = Window.orderBy(n).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parts.groupBy(n)
        .count()
        .select(n, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy(n).orderBy(F.col("source").asc_nulls_last())
    return (
        parts.join(F.broadcast(starts), n)  # a row for each partition
        .withColumn("place", F.col("start") + F.row_number().over(within) - 1)
        .drop("start", n)
    )


def fill(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, words) with ``target``. The loop holds three whole
    numbers; capped sources are found by exact comparisons."""
    w = F.element_at(
        F.array(*[F.lit(x) for x in weights]), (F.col("place") % len(weights) + 1).cast("int")
    ).cast("long")
    s = materialise(_ranked(sources).withColumn("weight", w), "mix-weights")
    big = lambda c: c.cast("decimal(19,0)")
    total, share = s.agg(F.sum("words"), F.sum("weight")).first()
    total, rest, left, capped = total or 0, total or 0, share or 1, F.lit(False)
    while True:
        now = big(max_epochs * F.col("words")) * big(F.lit(left)) < big(F.lit(rest)) * big(
            F.col("weight")
        )
        got, open_ = s.agg(
            F.sum(F.when(now, F.col("words"))), F.sum(F.when(~now, F.col("weight")))
        ).first()
        new_rest, new_left = total - max_epochs * (got or 0), open_ or 0
        if (new_rest, new_left) == (rest, left) or not new_left:
            capped = now
            break
        rest, left = new_rest, new_left
    even = F.lit(float(rest)) * F.col("weight") / F.lit(float(left))
    return s.withColumn(
        "target", F.when(capped, max_epochs * F.col("words").cast("double")).otherwise(even)
    ).select("source", "words", "target")


def _cut(cells: DataFrame, per: DataFrame, start: Column) -> DataFrame:
    """(source, edge): the first bucket of ``cells`` at which the words so far,
    from ``start`` on, are more than the source's ``part``, and those before it."""
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = cells.withColumn("upto", start + F.sum("words").over(so_far)).alias("b")
    return (
        run.join(per.select(F.col("source").alias("of"), "part").alias("p"), F.col("source").eqNullSafe(F.col("of")))
        .filter(F.col("upto") > F.col("part"))
        .groupBy("source")
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("edge"))
    )


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and
    ``mix_taken`` (words that the mix takes, repetitions counted)."""
    rank, bucket, own, extra = (
        free_name(docs, n) for n in ("mix_rank", "mix_bucket", "mix_info", "mix_extra")
    )
    digest = F.md5(
        F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")
    )
    out = ["mix_size", "mix_source_size", "mix_target", "mix_taken"]
    full = docs.drop(*out).withColumns(
        {"mix_size": size_of(F.col(text)), rank: digest}
    ).withColumn(bucket, F.substring(rank, 1, BUCKET_DIGITS))

    # All that follows about sources is made from sums by source and bucket.
    sums = materialise(
        full.groupBy(F.col(source).alias("source"), F.col(bucket).alias("bucket")).agg(
            F.sum("mix_size").alias("words")
        ),
        "mix-sums",
    )
    filled = materialise(
        fill(sums.groupBy("source").agg(F.sum("words").alias("words")), weights, max_epochs),
        "mix-targets",
    )
    whole = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(
        F.lit(0)
    )
    per = small_side(filled).withColumn("whole", whole.cast("long"))
    per = per.withColumn(
        "part", F.floor(F.col("target") - F.col("whole") * F.col("words")).cast("long")
    )
    coarse = F.substring("bucket", 1, COARSE_DIGITS)
    most = _cut(sums.groupBy("source", coarse.alias("bucket")).agg(F.sum("words").alias("words")), per, F.lit(0))
    least = sums.alias("f").join(
        most.select(F.col("source").alias("of"), "edge").alias("c"),
        F.col("f.source").eqNullSafe(F.col("of")) & (F.substring("f.bucket", 1, COARSE_DIGITS) == F.col("edge.bucket")),
    )
    edge = _cut(least.select("f.source", "f.bucket", "f.words", F.col("edge.before").alias("start")), per, F.col("start"))
    info = materialise(
        per.alias("p")
        .join(edge.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left")
        .select(
            F.struct(
                "p.source",
                "words",
                "target",
                "whole",
                "part",
                F.coalesce("edge.bucket", F.lit("~")).alias("bucket"),
                F.coalesce("edge.before", F.lit(0)).cast("long").alias("before"),
            ).alias(own)
        ),
        "mix-info",
    )
    joined = full.join(
        small_side(info), F.col(source).eqNullSafe(F.col(f"{own}.source"))
    )
    at = Window.partitionBy(source, bucket).orderBy(rank, F.col(key), "mix_size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    i = f"{own}."
    outside = joined.filter(F.col(bucket) != F.col(i + "bucket")).withColumn(
        extra,
        F.when(F.col(bucket) < F.col(i + "bucket"), F.col("mix_size")).otherwise(F.lit(0)),
    )
    inside = joined.filter(F.col(bucket) == F.col(i + "bucket")).withColumn(
        extra,
        F.greatest(
            F.lit(0),
            F.least(
                F.col("mix_size"),
                F.col(i + "part")
                - F.col(i + "before")
                - F.coalesce(F.sum("mix_size").over(at), F.lit(0)),
            ),
        ),
    )
    return (
        outside.unionByName(inside)
        .withColumns(
            {
                "mix_source_size": F.col(i + "words"),
                "mix_target": F.col(i + "target"),
                "mix_taken": (F.col(i + "whole") * F.col("mix_size") + F.col(extra)).cast(
                    "long"
                ),
            }
        )
        .drop(own, extra, rank, bucket)
    )


def emit(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: a row of ``mix`` for each repetition that it takes, with
    the columns of the input and ``mix_copy`` (from 1). The texts' words sum to
    ``mix_taken``: whole texts stay as they are, the one that a source's target
    cuts short has its first words, joined by single spaces. Documents of which
    nothing is taken give no row."""
    copy, last = F.col("mix_copy"), F.col("mix_taken") - (F.col("mix_copy") - 1) * F.col("mix_size")
    times = F.ceil(F.col("mix_taken") / F.col("mix_size")).cast("int")
    each = mixed.drop("mix_copy").filter("mix_taken > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), times)))
    some = F.slice(F.regexp_extract_all(text, F.lit(f"({SPACE_WORD})")), F.lit(1), last.cast("int"))
    whole = copy * F.col("mix_size") <= F.col("mix_taken")
    each = each.withColumn(text, F.when(whole, F.col(text)).otherwise(F.array_join(some, " ")))
    return each.drop("mix_size", "mix_source_size", "mix_target", "mix_taken")


def op10_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('lumen:' || coalesce(cast(doc_id AS VARCHAR), '')) AS r
  FROM documents),
s AS (
  SELECT source, cast(sum(size) AS BIGINT) AS words,
         cast((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, coalesce(sum(words) OVER before, 0) AS sb, coalesce(sum(weight) OVER before, 0) AS wb,
         sum(words) OVER () AS t, sum(weight) OVER () AS wt
  FROM s WINDOW before AS (ORDER BY words / weight, weight, source NULLS LAST
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * words * (wt - wb) < (t - 3 * sb) * weight AS capped FROM o),
g AS (
  SELECT *, cast(sum(words) OVER () - 3 * coalesce(sum(CASE WHEN capped THEN words END) OVER (), 0) AS DOUBLE) AS rest,
         cast(sum(CASE WHEN NOT capped THEN weight END) OVER () AS DOUBLE) AS wleft
  FROM c),
t AS (
  SELECT source, words,
         CASE WHEN capped THEN 3 * cast(words AS DOUBLE) ELSE rest * weight / wleft END AS target
  FROM g),
p AS (
  SELECT *, CASE WHEN words > 0 THEN cast(floor(target / words) AS BIGINT) ELSE 0 END AS whole FROM t),
f AS (SELECT *, cast(floor(target - whole * words) AS BIGINT) AS part FROM p)
SELECT d.doc_id, cast(d.size AS BIGINT) AS size, f.words AS source_size, f.target AS target,
       cast(f.whole * d.size + greatest(0, least(d.size, f.part - coalesce(sum(d.size) OVER (
         PARTITION BY d.source ORDER BY d.r, d.doc_id, d.size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
"""
