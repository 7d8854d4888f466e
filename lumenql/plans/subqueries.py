"""Subqueries in predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.quantified import compare_quantified
from .registry import query, table as t

c = F.col


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def in_subquery(spark, d):
    rich = t(spark, d, "customer").filter(c("c_acctbal") > 5000)
    return t(spark, d, "orders").join(rich, c("o_custkey") == c("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 1e12)")
def in_subquery_empty(spark, d):
    rich = t(spark, d, "customer").filter(c("c_acctbal") > 1e12)
    return t(spark, d, "orders").join(rich, c("o_custkey") == c("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def not_in_subquery(spark, d):
    keys = t(spark, d, "supplier").filter(c("s_acctbal") > 8000).select("s_nationkey")
    return compare_quantified(t(spark, d, "customer"), c("c_nationkey"), "<>", "ALL", keys).select("c_custkey", "c_nationkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT CASE WHEN s_nationkey > 3 THEN s_nationkey END FROM supplier)")
def not_in_subquery_null(spark, d):
    keys = t(spark, d, "supplier").select(F.when(c("s_nationkey") > 3, c("s_nationkey")).alias("k"))
    return compare_quantified(t(spark, d, "customer"), c("c_nationkey"), "<>", "ALL", keys).select("c_custkey")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
def scalar_subquery(spark, d):
    t(spark, d, "part").createOrReplaceTempView("lumenql_part")
    return spark.sql(
        "SELECT p_partkey, p_retailprice FROM lumenql_part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM lumenql_part)"
    )


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def exists_subquery(spark, d):
    big = t(spark, d, "orders").filter(c("o_totalprice") > 400000)
    return t(spark, d, "customer").join(big, c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def not_exists_subquery(spark, d):
    big = t(spark, d, "orders").filter(c("o_totalprice") > 100000)
    return t(spark, d, "customer").join(big, c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice > ALL (SELECT p_retailprice FROM part WHERE p_size = 7)")
def gt_all_subquery(spark, d):
    p = t(spark, d, "part")
    return compare_quantified(p, c("p_retailprice"), ">", "ALL", p.filter("p_size = 7").select("p_retailprice")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice <= ALL (SELECT p_retailprice FROM part WHERE p_size > 1000)")
def le_all_empty_subquery(spark, d):
    p = t(spark, d, "part")
    return compare_quantified(p, c("p_retailprice"), "<=", "ALL", p.filter("p_size > 1000").select("p_retailprice")).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = ANY (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def eq_any_subquery(spark, d):
    keys = t(spark, d, "supplier").filter(c("s_acctbal") < 0).select("s_nationkey")
    return compare_quantified(t(spark, d, "customer"), c("c_nationkey"), "=", "ANY", keys).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < ANY (SELECT s_acctbal FROM supplier WHERE s_nationkey = 3)")
def lt_some_subquery(spark, d):
    keys = t(spark, d, "supplier").filter(c("s_nationkey") == 3).select("s_acctbal")
    return compare_quantified(t(spark, d, "customer"), c("c_acctbal"), "<", "SOME", keys).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT p_partkey, s_suppkey FROM part, supplier WHERE p_size = s_nationkey)")
def tuple_in_subquery(spark, d):
    # by the keys of either table, which are unique: their pairs would be many
    sizes = t(spark, d, "part").select("p_partkey", "p_size")
    homes = t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    found = t(spark, d, "lineitem").join(sizes, c("l_partkey") == c("p_partkey"))
    found = found.join(homes, (c("l_suppkey") == c("s_suppkey")) & (c("p_size") == c("s_nationkey")))
    return found.select("l_orderkey", "l_linenumber", "l_partkey")
