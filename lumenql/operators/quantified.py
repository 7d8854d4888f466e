"""Comparisons with ALL, ANY and SOME values of a subquery, with three-valued
logic: ALL of nothing is true, ANY of nothing is false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TESTS = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def compare_quantified(left: DataFrame, value: Column, op: str, which: str, right: DataFrame) -> DataFrame:
    """Rows of ``left`` for which ``value op ALL|ANY (right)`` is true."""
    which = {"SOME": "ANY"}.get(which.upper(), which.upper())
    c = F.col(f"`{right.columns[0]}`")
    if (op, which) == ("=", "ANY"):
        probe = right.select(c.alias("quant_value"))
        return left.join(probe, value == F.col("quant_value"), "left_semi")
    # one row: what decides the comparison, whatever the subquery's size
    facts = right.agg(
        F.min(c).alias("quant_min"),
        F.max(c).alias("quant_max"),
        F.count("*").alias("quant_rows"),
        F.count(c).alias("quant_values"),
    )
    joined = left.crossJoin(F.broadcast(facts))
    low, high, test = F.col("quant_min"), F.col("quant_max"), _TESTS[op]
    full = F.col("quant_rows") == F.col("quant_values")
    if which == "ALL":
        if op == "<>":  # NOT IN: null-aware, by the values themselves
            probe = right.select(c.alias("quant_value"))
            fits = joined.filter((F.col("quant_rows") == 0) | (full & value.isNotNull()))
            return fits.join(probe, value == F.col("quant_value"), "left_anti").select(*left.columns)
        bound = {"=": None, "<": low, "<=": low, ">": high, ">=": high}[op]
        sure = (value == low) & (value == high) if bound is None else test(value, bound)
        keep = (F.col("quant_rows") == 0) | (full & sure)
    else:
        bound = {"<>": None, "<": high, "<=": high, ">": low, ">=": low}[op]
        keep = (value != low) | (value != high) if bound is None else test(value, bound)
    return joined.filter(keep).select(*left.columns)
