"""Grouped and global aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rounded_avg
from ..operators.grouping import with_multiplicity
from .registry import query, table as t

c = F.col
FLAGS = ("l_returnflag", "l_linestatus")


def n():
    return F.count("*").alias("n")


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem")
def agg_global(spark, d):
    return t(spark, d, "lineitem").agg(
        n(), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount")
    )


@query("SELECT count(*) AS n, sum(l_quantity) AS quantity, max(l_returnflag) AS flag FROM lineitem WHERE l_quantity < 0")
def agg_empty(spark, d):
    none = t(spark, d, "lineitem").filter(c("l_quantity") < 0)
    return none.agg(n(), F.sum("l_quantity").alias("quantity"), F.max("l_returnflag").alias("flag"))


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS price, cast(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag")
def agg_sum(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("price"), F.sum("l_linenumber").alias("lines")
    )


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def agg_count_star(spark, d):
    return t(spark, d, "orders").groupBy("o_orderstatus").agg(n())


@query("SELECT n_regionkey, count(s_suppkey) AS suppliers, count(*) AS n FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey < 12) ON n_nationkey = s_nationkey GROUP BY n_regionkey")
def agg_count_col(spark, d):
    few = t(spark, d, "supplier").filter(c("s_nationkey") < 12)
    joined = t(spark, d, "nation").join(few, c("n_nationkey") == c("s_nationkey"), "left")
    return joined.groupBy("n_regionkey").agg(F.count("s_suppkey").alias("suppliers"), n())


@query("SELECT p_brand, round(avg(p_retailprice), 6) AS price FROM part GROUP BY p_brand")
def agg_avg(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("price"))


@query("SELECT p_brand, cast(trunc(avg(p_size) + 0.5) AS BIGINT) AS size FROM part GROUP BY p_brand")
def agg_avg_int_rounded(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(rounded_avg(c("p_size")).alias("size"))


@query("SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders")
def agg_min_max(spark, d):
    return t(spark, d, "orders").agg(
        F.min("o_totalprice").alias("low"),
        F.max("o_totalprice").alias("high"),
        F.min("o_orderdate").alias("first"),
        F.max("o_orderdate").alias("last"),
    )


@query("SELECT p_type, min(p_name) AS first, max(p_name) AS last FROM part GROUP BY p_type")
def agg_min_max_string(spark, d):
    return t(spark, d, "part").groupBy("p_type").agg(F.min("p_name").alias("first"), F.max("p_name").alias("last"))


@query("SELECT l_returnflag, round(sum(l_extendedprice + l_tax - l_discount), 2) AS total, max(l_quantity * 2) AS twice FROM lineitem GROUP BY l_returnflag")
def agg_expr(spark, d):
    total = F.sum(c("l_extendedprice") + c("l_tax") - c("l_discount"))
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(total, 2).alias("total"), F.max(c("l_quantity") * 2).alias("twice")
    )


@query("SELECT count(DISTINCT o_custkey) AS customers, cast(sum(DISTINCT o_custkey) AS BIGINT) AS total FROM orders")
def agg_count_distinct(spark, d):
    return t(spark, d, "orders").agg(F.count_distinct("o_custkey").alias("customers"), F.sum_distinct("o_custkey").alias("total"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def group_by_single(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(n())


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_by_multi(spark, d):
    return t(spark, d, "lineitem").groupBy(*FLAGS).agg(
        n(),
        F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"),
    )


@query("SELECT count(*) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus")
def group_by_hidden_key(spark, d):
    return t(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(n()).select("n")


@query("SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_suppkey HAVING count(*) > 550 AND sum(l_quantity) < 16000")
def having(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_suppkey").agg(n(), F.sum("l_quantity").alias("q"))
    return g.filter((c("n") > 550) & (c("q") < 16000)).select("l_suppkey", "n", F.round("q", 2).alias("quantity"))


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def select_distinct(spark, d):
    return t(spark, d, "customer").select("c_mktsegment", "c_nationkey").distinct()


@query("SELECT ALL n_regionkey FROM nation")
def select_all(spark, d):
    return t(spark, d, "nation").select("n_regionkey")


@query('SELECT c_mktsegment, c_nationkey, count(*) AS "count" FROM customer GROUP BY c_mktsegment, c_nationkey')
def rows_with_multiplicity(spark, d):
    return with_multiplicity(t(spark, d, "customer").select("c_mktsegment", "c_nationkey"))
