"""Collects the named queries of all families."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_all: dict[str, Query] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None, name: str | None = None):
    """Register a query function together with the SQL it must agree with."""

    def keep(f):
        key = name or f.__name__
        if key in _all:
            raise ValueError(f"two queries are named {key}")
        _all[key] = Query(f, sql)
        return f

    return keep


def registered(name: str) -> Query:
    return _all[name]


def _load() -> None:
    from . import families  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: q.run for k, q in _all.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: q.sql for k, q in _all.items() if q.sql}
