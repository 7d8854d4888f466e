"""User functions, called in SQL by a prefixed name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

#: Fixed value: the prefix by which statements call user functions.
PREFIX = "AQ_"


def register(spark: SparkSession, name: str, function: Callable, returns: str):
    """Register a function over pandas series under the prefixed name."""
    made = pandas_udf(function, returns)
    return spark.udf.register(PREFIX + name.upper(), made)
