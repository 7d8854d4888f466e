"""Changes to tables as functions from the old state to the new."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import setops


class ChangeError(ValueError):
    pass


def _named(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Columns of ``df``, named in any case."""
    known = {c.lower(): c for c in df.columns}
    if unknown := [n for n in names if n.lower() not in known]:
        raise ChangeError(f"the table has no column {unknown[0]}")
    return [known[n.lower()] for n in names]


def insert_values(table: DataFrame, columns: list[str], rows: list[tuple]) -> DataFrame:
    """Append rows of literals; columns that aren't named are null."""
    fields = {f.name.lower(): f for f in table.schema.fields}
    if unknown := [c for c in columns if c.lower() not in fields]:
        raise ChangeError(f"the table has no column {unknown[0]}")
    if any(len(row) != len(columns) for row in rows):
        raise ChangeError("as many values as columns are needed")
    given = {}
    for c, values in zip(columns, zip(*rows, strict=True), strict=False):
        if any(isinstance(v, float) for v in values):
            values = [float(v) if isinstance(v, int) else v for v in values]
        if any(v is not None for v in values):
            given[c.lower()] = values
    if not given:
        more = table.sparkSession.range(len(rows))
    else:
        more = table.sparkSession.createDataFrame(list(zip(*given.values(), strict=True)), list(given))
    line = [(F.col(n) if n in given else F.lit(None)).cast(f.dataType).alias(f.name) for n, f in fields.items()]
    return table.unionByName(more.select(*line))


def insert_select(table: DataFrame, columns: list[str], source: DataFrame) -> DataFrame:
    """Append the rows of a query, by position, to the named columns."""
    if len(columns) != len(source.columns):
        raise ChangeError("the query needs as many columns as are named")
    target = table.select(*columns)
    setops.check(target, source)
    renamed = source.toDF(*columns)
    lines = [
        (F.col(f.name) if f.name.lower() in {c.lower() for c in columns} else F.lit(None))
        .cast(f.dataType)
        .alias(f.name)
        for f in table.schema.fields
    ]
    return table.unionByName(renamed.select(*lines))


def update(table: DataFrame, values: dict[str, object], where: Column | None = None) -> DataFrame:
    """Set columns to literals or expressions in rows that ``where`` is true for."""
    kinds = {f.name.lower(): f.dataType for f in table.schema.fields}
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    new = {}
    for c, v in values.items():
        if c.lower() not in kinds:
            raise ChangeError(f"the table has no column {c}")
        value = (v if isinstance(v, Column) else F.lit(v)).cast(kinds[c.lower()])
        new[c.lower()] = F.when(hit, value).otherwise(F.col(c))
    return table.select(*[new.get(c.lower(), F.col(c)).alias(c) for c in table.columns])


def _flagged(table: DataFrame, columns: list[str], keys: DataFrame, flag: str) -> DataFrame:
    probe = keys.toDF(*[f"{flag}_{i}" for i in range(len(columns))]).distinct().withColumn(flag, F.lit(True))
    on = [F.col(c) == F.col(f"{flag}_{i}") for i, c in enumerate(columns)]
    return table.join(probe, on, "left")


def update_in(table: DataFrame, values: dict[str, object], columns: list[str], keys: DataFrame) -> DataFrame:
    """Update rows whose ``columns``, taken together, are in ``keys``."""
    flag = "dml_hit"
    marked = _flagged(table, columns, keys, flag)
    return update(marked, values, F.col(flag).isNotNull()).select(*table.columns)


def delete(table: DataFrame, where: Column | None = None) -> DataFrame:
    """Remove rows that ``where`` is true for (all rows without it)."""
    return table.limit(0) if where is None else table.filter(~F.coalesce(where, F.lit(False)))


def delete_in(table: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    probe = keys.toDF(*[f"dml_{i}" for i in range(len(columns))])
    return table.join(probe, [F.col(c) == F.col(f"dml_{i}") for i, c in enumerate(columns)], "left_anti")


def truncate(table: DataFrame) -> DataFrame:
    return table.filter(F.lit(False))


def merge(
    target: DataFrame,
    source: DataFrame,
    on: dict[str, str],
    matched: dict[str, str] | str | None = None,
    not_matched: dict[str, str] | None = None,
    not_matched_by_source: dict[str, object] | str | None = None,
) -> DataFrame:
    """The new state of ``target``. ``on`` pairs target and source columns;
    names are taken in any case; a target row that several source rows match is an error when
    the result is read. ``matched`` sets target columns to source columns, or is
    "DELETE"; ``not_matched`` gives the columns of rows to insert;
    ``not_matched_by_source`` sets target columns to literals, or is "DELETE"."""
    on = dict(zip(_named(target, on), _named(source, on.values()), strict=True))
    if isinstance(matched, dict):
        matched = dict(zip(_named(target, matched), _named(source, matched.values()), strict=True))
    if not_matched is not None:
        not_matched = dict(zip(_named(target, not_matched), _named(source, not_matched.values()), strict=True))
    if isinstance(not_matched_by_source, dict):
        not_matched_by_source = dict(
            zip(_named(target, not_matched_by_source), not_matched_by_source.values(), strict=True)
        )
    s = source.select(*[F.col(c).alias(f"merge_s_{c}") for c in source.columns])
    keys = [F.col(f"merge_s_{c}") for c in on.values()]
    keyed = reduce(and_, [k.isNotNull() for k in keys])
    # rows with a null in the key match nothing and are not gathered by it
    s = s.filter(keyed).withColumn("merge_s", F.count("*").over(Window.partitionBy(*keys))).unionByName(
        s.filter(~keyed).withColumn("merge_s", F.lit(1).cast("long"))
    )
    t = target.withColumn("merge_t", F.lit(True))
    cond = [F.col(a) == F.col(f"merge_s_{b}") for a, b in on.items()]
    several = F.raise_error(F.lit("several source rows match one row of the table")).cast("boolean")
    both = t.join(s, cond, "full").filter(
        F.when(F.col("merge_t").isNotNull() & (F.col("merge_s") > 1), several).otherwise(F.lit(True))
    )
    hit = F.col("merge_t").isNotNull() & F.col("merge_s").isNotNull()
    only_t, only_s = F.col("merge_s").isNull(), F.col("merge_t").isNull()
    gone = F.lit(False)
    if matched == "DELETE":
        gone = gone | hit
    if not_matched_by_source == "DELETE":
        gone = gone | only_t
    if not_matched is None:
        gone = gone | only_s
    out = []
    for f in target.schema.fields:
        c = F.col(f.name)
        value = F.when(only_s, F.col(f"merge_s_{not_matched[f.name]}") if f.name in (not_matched or {}) else F.lit(None))
        if isinstance(matched, dict) and f.name in matched:
            value = value.when(hit, F.col(f"merge_s_{matched[f.name]}"))
        if isinstance(not_matched_by_source, dict) and f.name in not_matched_by_source:
            value = value.when(only_t, F.lit(not_matched_by_source[f.name]))
        out.append(value.otherwise(c).cast(f.dataType).alias(f.name))
    return both.filter(~gone).select(*out)
