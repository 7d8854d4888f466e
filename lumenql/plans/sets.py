"""Set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.setops import chain
from .registry import query, table as t

c = F.col


def _three(spark, d):
    return (
        t(spark, d, "customer").select(c("c_nationkey").alias("k")),
        t(spark, d, "supplier").select(c("s_nationkey").alias("k")),
        t(spark, d, "nation").filter(c("n_regionkey") == 1).select(c("n_nationkey").alias("k")),
    )


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    a, b, _ = _three(spark, d)
    return chain(a, ("UNION", b))


@query("SELECT s_nationkey AS k FROM supplier UNION ALL SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def union_all(spark, d):
    _, b, n = _three(spark, d)
    return chain(b, ("UNION ALL", n))


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def minus(spark, d):
    a, _, n = _three(spark, d)
    return chain(a, ("MINUS", n))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def intersect(spark, d):
    a, _, n = _three(spark, d)
    return chain(a, ("INTERSECT", n))


@query("(SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def set_chain(spark, d):
    a, b, n = _three(spark, d)
    return chain(b, ("UNION", a), ("MINUS", n))


@query("SELECT cast(n_nationkey AS DOUBLE) AS k FROM nation UNION SELECT c_acctbal FROM customer")
def union_type_widen(spark, d):
    n = t(spark, d, "nation").select(c("n_nationkey").alias("k"))
    return chain(n, ("UNION", t(spark, d, "customer").select("c_acctbal")))
