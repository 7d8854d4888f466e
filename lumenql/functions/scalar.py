"""Scalar functions of the dialect that Spark spells or evaluates differently."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of a format model and their pattern letters.
_MODEL = {
    "YYYY": "yyyy",
    "HH24": "HH",
    "DDD": "DDD",
    "YY": "yy",
    "MM": "MM",
    "DD": "dd",
    "MI": "mm",
    "SS": "ss",
}
_PERCENT = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%j": "DDD",
    "%H": "HH",
    "%M": "mm",
    "%S": "ss",
}
_MODEL_PARTS = re.compile("|".join(sorted(_MODEL, key=len, reverse=True)), re.I)


def date_pattern(model: str) -> str:
    """A format model (``DD/MM/YYYY HH24:MI:SS`` or ``%d/%m/%Y %H:%M:%S``) as a
    Spark pattern."""
    if "%" in model:
        if unknown := set(re.findall("%.?", model)) - _PERCENT.keys():
            raise ValueError(f"not a part of a date model: {min(unknown)}")
        return re.sub("%.", lambda m: _PERCENT[m.group()], model)
    return _MODEL_PARTS.sub(lambda m: _MODEL[m.group().upper()], model)


def to_date(text: Column, model: str = "YYYY-MM-DD HH24:MI:SS") -> Column:
    return F.to_timestamp_ntz(text, F.lit(date_pattern(model)))


def to_char(value: Column, model: str | None = None) -> Column:
    """Dates by their model; without one, the plain text of the value."""
    return value.cast("string") if model is None else F.date_format(value, date_pattern(model))


def number_text(value: Column) -> Column:
    """Two decimals, halves away from zero."""
    return F.format_string("%.2f", F.round(value, 2))


def rounded_avg(value: Column) -> Column:
    """The average of whole numbers as a whole number: trunc(avg + 0.5)."""
    return (F.avg(value) + F.lit(0.5)).cast("bigint")


def like_pattern(pattern: str, escape: str | None = None) -> str:
    """A LIKE pattern with character sets (``[abc]``, ``[^a-z]``) as a regular
    expression for the whole value; trailing blanks of the value don't count."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 2
            continue
        if c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            turned = body.startswith("^")
            body = re.sub(r"([\\\[\]&^])", r"\\\1", body[turned:])
            out.append(f"[{'^' if turned else ''}{body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + " *$"


def like(value: Column, pattern: str, escape: str | None = None) -> Column:
    return value.rlike(like_pattern(pattern, escape))


def decode(value: Column, *pairs, default=None) -> Column:
    """``decode(x, s1, r1, s2, r2, ..., default)``: a null equals a null."""
    out = None
    for s, r in zip(pairs[::2], pairs[1::2], strict=True):
        hit = value.eqNullSafe(F.lit(s))
        out = F.when(hit, F.lit(r)) if out is None else out.when(hit, F.lit(r))
    return out.otherwise(F.lit(default))


def day_start(value: Column) -> Column:
    return F.date_trunc("day", value).cast("timestamp_ntz")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)
