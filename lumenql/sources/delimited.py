"""Bulk loading of delimited text, and the sinks for results."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import number_text
from .catalog import TableDef, internal_type


def _converted(value: Column, declared: str, size: int, date_format: str | None) -> Column:
    """A field as its declared type; empty fields and NULL are null."""
    kind = internal_type(declared)
    trimmed = F.trim(value)
    given = F.when((trimmed != "") & (F.upper(trimmed) != "NULL"), trimmed)
    if kind in ("INT", "BIG_INT"):
        return given.cast("int" if kind == "INT" else "bigint")
    if kind == "DOUBLE":
        return F.replace(given, F.lit(","), F.lit(".")).cast("double")
    if kind == "DATE":
        if date_format:
            return F.to_timestamp_ntz(given, F.lit(date_format))
        return given.cast("timestamp_ntz")
    return F.substring(F.rtrim(value), 1, size) if size > 0 else F.rtrim(value)


def load_delimited(
    spark: SparkSession,
    path: str,
    table: TableDef,
    sep: str = ";",
    quote: str | None = None,
    date_format: str | None = None,
) -> DataFrame:
    """Read a table's text file by its definition: columns by position, numbers
    with comma or point, text cut to its declared size."""
    names = [f"_{i}" for i in range(len(table.columns))]
    raw = spark.read.csv(
        path,
        schema=T.StructType([T.StructField(n, T.StringType()) for n in names]),
        sep=sep,
        quote=quote or "",
        escape="\\",
        header=False,
        ignoreTrailingWhiteSpace=False,
        ignoreLeadingWhiteSpace=False,
        mode="PERMISSIVE",
    )
    return raw.select(
        *[
            _converted(F.col(n), c.type, c.size, date_format).alias(c.name)
            for n, c in zip(names, table.columns, strict=True)
        ]
    )


def import_tables(spark: SparkSession, folder: str, tables: list[TableDef], out: str, **options) -> None:
    """Text files ``folder/<name>.txt`` into Parquet tables ``out/<name>.parquet``."""
    for t in tables:
        load_delimited(spark, f"{folder}/{t.name}.txt", t, **options).write.mode("overwrite").parquet(
            f"{out}/{t.name}.parquet"
        )


def as_text(df: DataFrame, null: str = "NULL") -> DataFrame:
    """All columns as text: doubles with two decimals, null by name."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = number_text(c)
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(F.coalesce(c.cast("string"), F.lit(null)).alias(f.name))
    return df.select(*out)


def answer_lines(df: DataFrame, sep: str = "; ") -> DataFrame:
    """A column ``line``: every value of a row behind the separator."""
    return as_text(df).select(F.concat(*[x for c in df.columns for x in (F.lit(sep), F.col(f"`{c}`"))]).alias("line"))


def write_answer(df: DataFrame, path: str, sep: str = "; ") -> None:
    """Header and rows as lines of text files, the header in a file of its own
    (it sorts first)."""
    head = "".join(sep + c for c in df.columns)
    spark = df.sparkSession
    spark.range(1).select(F.lit(head).alias("line")).write.mode("overwrite").text(f"{path}/0-header")
    answer_lines(df, sep).write.mode("overwrite").text(f"{path}/1-rows")


def grid_lines(df: DataFrame, rows: int | None = None) -> Iterator[str]:
    """An aligned grid for a console, line by line: all rows, or the first
    ``rows`` and how many there are besides."""
    text = as_text(df)
    facts = text.agg(F.count("*"), *[F.max(F.length(f"`{c}`")) for c in text.columns]).first()
    width = [max(len(c), n or 0) for c, n in zip(df.columns, facts[1:], strict=True)]
    line = lambda r: "| " + " | ".join(str(v).ljust(w) for v, w in zip(r, width, strict=True)) + " |"
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    yield from (rule, line(df.columns), rule)
    shown = text if rows is None else text.limit(rows)
    yield from map(line, shown.toLocalIterator())
    yield rule
    if rows is not None and facts[0] > rows:
        yield f"and {facts[0] - rows} more rows"


def grid(df: DataFrame, rows: int | None = None) -> str:
    return "\n".join(grid_lines(df, rows))


def write_rows(df: DataFrame, path: str) -> None:
    """Binary rows: Parquet."""
    df.write.mode("overwrite").parquet(path)
