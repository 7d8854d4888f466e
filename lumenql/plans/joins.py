"""Joins of every kind and shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.joins import range_join
from .registry import query, table as t

c = F.col


def _low(spark, d):
    return t(spark, d, "supplier").filter(c("s_nationkey") < 12)


_LOW = "(SELECT * FROM supplier WHERE s_nationkey < 12)"


@query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
def join_implicit(spark, d):
    return t(spark, d, "nation").join(t(spark, d, "region"), c("n_regionkey") == c("r_regionkey")).select("n_name", "r_name")


@query("SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def join_inner(spark, d):
    on = (c("o_custkey") == c("c_custkey")) & (c("c_acctbal") > 0)
    return t(spark, d, "orders").join(t(spark, d, "customer"), on, "inner").select("o_orderkey", "c_name")


@query(f"SELECT n_name, s_suppkey FROM nation LEFT JOIN {_LOW} ON n_nationkey = s_nationkey")
def join_left(spark, d):
    return t(spark, d, "nation").join(_low(spark, d), c("n_nationkey") == c("s_nationkey"), "left").select("n_name", "s_suppkey")


@query(f"SELECT s_suppkey, n_name FROM {_LOW} RIGHT JOIN nation ON n_nationkey = s_nationkey")
def join_right(spark, d):
    return _low(spark, d).join(t(spark, d, "nation"), c("n_nationkey") == c("s_nationkey"), "right").select("s_suppkey", "n_name")


@query(f"SELECT n_nationkey, s_suppkey FROM (SELECT * FROM nation WHERE n_nationkey > 5) FULL JOIN {_LOW} ON n_nationkey = s_nationkey")
def join_full(spark, d):
    n = t(spark, d, "nation").filter(c("n_nationkey") > 5)
    return n.join(_low(spark, d), c("n_nationkey") == c("s_nationkey"), "full").select("n_nationkey", "s_suppkey")


def _theta(spark, d, on):
    return t(spark, d, "region").join(t(spark, d, "nation"), on).select("r_regionkey", "n_nationkey")


@query("SELECT r_regionkey, n_nationkey FROM region, nation WHERE r_regionkey < n_regionkey")
def join_theta_lt(spark, d):
    return _theta(spark, d, c("r_regionkey") < c("n_regionkey"))


@query("SELECT r_regionkey, n_nationkey FROM region, nation WHERE r_regionkey <= n_regionkey")
def join_theta_le(spark, d):
    return _theta(spark, d, c("r_regionkey") <= c("n_regionkey"))


@query("SELECT r_regionkey, n_nationkey FROM region, nation WHERE r_regionkey > n_regionkey")
def join_theta_gt(spark, d):
    return _theta(spark, d, c("r_regionkey") > c("n_regionkey"))


@query("SELECT r_regionkey, n_nationkey FROM region, nation WHERE r_regionkey >= n_regionkey")
def join_theta_ge(spark, d):
    return _theta(spark, d, c("r_regionkey") >= c("n_regionkey"))


@query("SELECT r_regionkey, n_nationkey FROM region, nation WHERE r_regionkey <> n_regionkey")
def join_theta_ne(spark, d):
    return _theta(spark, d, c("r_regionkey") != c("n_regionkey"))


@query(
    """SELECT c_custkey, p_partkey FROM customer,
    (SELECT p_partkey, p_retailprice AS low, p_retailprice + 25 AS high FROM part WHERE p_size < 5)
    WHERE c_acctbal >= low AND c_acctbal < high"""
)
def join_range(spark, d):
    p = t(spark, d, "part").filter(c("p_size") < 5)
    p = p.select("p_partkey", c("p_retailprice").alias("low"), (c("p_retailprice") + 25).alias("high"))
    return range_join(t(spark, d, "customer"), c("c_acctbal"), p, c("low"), c("high"), 50).select("c_custkey", "p_partkey")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey")
def join_multi_key(spark, d):
    on = (c("c_nationkey") == c("s_nationkey")) & (c("c_custkey") == c("s_suppkey"))
    return t(spark, d, "customer").join(t(spark, d, "supplier"), on).select("c_custkey", "s_suppkey")


@query("SELECT o_orderkey, c_name, n_name FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND o_totalprice > 300000")
def join_3way(spark, d):
    o = t(spark, d, "orders").filter(c("o_totalprice") > 300000)
    return (
        o.join(t(spark, d, "customer"), c("o_custkey") == c("c_custkey"))
        .join(t(spark, d, "nation"), c("c_nationkey") == c("n_nationkey"))
        .select("o_orderkey", "c_name", "n_name")
    )


@query(
    """SELECT p_brand, n_name, o_orderpriority, count(*) AS n FROM lineitem, part, supplier, nation, orders
    WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND l_orderkey = o_orderkey
    AND l_quantity > 45 GROUP BY ALL"""
)
def join_star(spark, d):
    return (
        t(spark, d, "lineitem")
        .filter(c("l_quantity") > 45)
        .join(t(spark, d, "part"), c("l_partkey") == c("p_partkey"))
        .join(t(spark, d, "supplier"), c("l_suppkey") == c("s_suppkey"))
        .join(t(spark, d, "nation"), c("s_nationkey") == c("n_nationkey"))
        .join(t(spark, d, "orders"), c("l_orderkey") == c("o_orderkey"))
        .groupBy("p_brand", "n_name", "o_orderpriority")
        .agg(F.count("*").alias("n"))
    )


@query(
    """SELECT n_name, count(*) AS n FROM customer, orders, lineitem, supplier, nation
    WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_suppkey = s_suppkey
    AND s_nationkey = c_nationkey AND s_nationkey = n_nationkey GROUP BY n_name"""
)
def join_cycle(spark, d):
    closed = (c("l_suppkey") == c("s_suppkey")) & (c("s_nationkey") == c("c_nationkey"))
    return (
        t(spark, d, "customer")
        .join(t(spark, d, "orders"), c("c_custkey") == c("o_custkey"))
        .join(t(spark, d, "lineitem"), c("o_orderkey") == c("l_orderkey"))
        .join(t(spark, d, "supplier"), closed)
        .join(t(spark, d, "nation"), c("s_nationkey") == c("n_nationkey"))
        .groupBy("n_name")
        .agg(F.count("*").alias("n"))
    )


@query("SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
def join_self(spark, d):
    a, b = t(spark, d, "nation").alias("a"), t(spark, d, "nation").alias("b")
    on = (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))
    return a.join(b, on).select(c("a.n_name").alias("one"), c("b.n_name").alias("other"))


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(spark, d):
    return t(spark, d, "region").crossJoin(t(spark, d, "nation")).select("r_name", "n_name")


@query("SELECT k, c_name, n_name FROM (SELECT c_nationkey AS k, c_name FROM customer) JOIN (SELECT n_nationkey AS k, n_name FROM nation) USING (k)")
def join_using(spark, d):
    a = t(spark, d, "customer").select(c("c_nationkey").alias("k"), "c_name")
    return a.join(t(spark, d, "nation").select(c("n_nationkey").alias("k"), "n_name"), "k")
