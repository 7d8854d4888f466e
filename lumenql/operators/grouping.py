"""Bags as distinct rows with their number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_multiplicity(df: DataFrame, name: str = "count") -> DataFrame:
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias(name))
