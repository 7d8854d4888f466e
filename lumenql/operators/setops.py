"""UNION, UNION ALL, MINUS and INTERSECT by position, with type families checked;
a chain is evaluated from the left with equal precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class SetOperationError(ValueError):
    pass


def _family(t: T.DataType) -> str:
    if isinstance(t, (T.NumericType,)):
        return "number"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    return t.simpleString()


def check(left: DataFrame, right: DataFrame) -> None:
    if len(left.columns) != len(right.columns):
        raise SetOperationError("both sides of a set operation need as many columns")
    for a, b in zip(left.schema.fields, right.schema.fields, strict=True):
        if _family(a.dataType) != _family(b.dataType) and "void" not in (_family(a.dataType), _family(b.dataType)):
            raise SetOperationError(f"{a.name} and {b.name} have types that don't go together")


def chain(first: DataFrame, *steps: tuple[str, DataFrame]) -> DataFrame:
    """``chain(a, ("UNION", b), ("MINUS", c))`` is (a UNION b) MINUS c."""
    out = first
    for op, df in steps:
        check(out, df)
        right = df.toDF(*out.columns)
        if op == "UNION ALL":
            out = out.union(right)
        elif op == "UNION":
            out = out.union(right).distinct()
        elif op == "MINUS":
            out = out.subtract(right)
        elif op == "INTERSECT":
            out = out.intersect(right)
        else:
            raise SetOperationError(f"unknown set operation {op}")
    return out
