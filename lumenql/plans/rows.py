"""Projections, filters and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import like
from ..operators.windows import numbered
from .registry import query, table as t

c = F.col


@query("SELECT n_nationkey, n_name FROM nation")
def project_columns(spark, d):
    return t(spark, d, "nation").select("n_nationkey", "n_name")


@query("SELECT * FROM supplier")
def select_star(spark, d):
    return t(spark, d, "supplier").select("*")


@query("SELECT n.*, r_name FROM nation n JOIN region ON n_regionkey = r_regionkey")
def select_qualified_star(spark, d):
    n, r = t(spark, d, "nation").alias("n"), t(spark, d, "region").alias("r")
    return n.join(r, c("n.n_regionkey") == c("r.r_regionkey")).select("n.*", "r.r_name")


@query("SELECT a.n_name AS label FROM nation AS a")
def table_and_column_alias(spark, d):
    return t(spark, d, "nation").alias("a").select(c("a.n_name").alias("label"))


@query("SELECT s.k AS k, s.label AS label FROM (SELECT n_nationkey AS k, n_name AS label FROM nation WHERE n_regionkey = 1) AS s WHERE s.k > 3")
def derived_table(spark, d):
    s = t(spark, d, "nation").filter(c("n_regionkey") == 1)
    return s.select(c("n_nationkey").alias("k"), c("n_name").alias("label")).filter(c("k") > 3)


@query("SELECT DISTINCT p_brand FROM part")
def distinct_values_scan(spark, d):
    return t(spark, d, "part").select("p_brand").distinct()


@query("SELECT r_regionkey, 42 AS answer, 'fixed' AS word FROM region")
def project_constant(spark, d):
    return t(spark, d, "region").select("r_regionkey", F.lit(42).alias("answer"), F.lit("fixed").alias("word"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem"
)
def project_expr(spark, d):
    charge = c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(charge, 6).alias("charge"))


@query(
    """SELECT p_partkey, p_size + 2 * 3 AS plus, (p_size + 2) * 3 AS grouped, p_size - 5 AS minus,
    round(p_retailprice / nullif(p_size, 0), 6) AS ratio FROM part"""
)
def arith(spark, d):
    size = c("p_size")
    return t(spark, d, "part").select(
        "p_partkey",
        (size + F.lit(2) * 3).alias("plus"),
        ((size + 2) * 3).alias("grouped"),
        (size - 5).alias("minus"),
        F.round(c("p_retailprice") / F.nullif(size, F.lit(0)), 6).alias("ratio"),
    )


@query("SELECT c_custkey, -c_acctbal AS owed FROM customer")
def arith_neg(spark, d):
    return t(spark, d, "customer").select("c_custkey", (-c("c_acctbal")).alias("owed"))


# -- filters ---------------------------------------------------------------

PART = ("p_partkey", "p_name", "p_size")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size >= 10 AND p_size <> 12 AND 40 > p_size")
def filter_cmp(spark, d):
    s = c("p_size")
    return t(spark, d, "part").filter((s >= 10) & (s != 12) & (F.lit(40) > s)).select(*PART)


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_suppkey > l_partkey OR l_linenumber = l_quantity")
def filter_col_col(spark, d):
    hit = (c("l_suppkey") > c("l_partkey")) | (c("l_linenumber") == c("l_quantity"))
    return t(spark, d, "lineitem").filter(hit).select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 5 AND 9")
def filter_between(spark, d):
    return t(spark, d, "part").filter(c("p_size").between(5, 9)).select(*PART)


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size NOT BETWEEN 5 AND 45")
def filter_not_between(spark, d):
    return t(spark, d, "part").filter(~c("p_size").between(5, 45)).select(*PART)


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%O_O%'")
def filter_like(spark, d):
    return t(spark, d, "part").filter(c("p_type").like("%O_O%")).select("p_partkey", "p_type")


@query("SELECT p_partkey, p_type FROM part WHERE p_type NOT LIKE 'PRO%'")
def filter_not_like(spark, d):
    return t(spark, d, "part").filter(~c("p_type").like("PRO%")).select("p_partkey", "p_type")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, '[a-c].*[^a-m] *')")
def filter_like_charset(spark, d):
    return t(spark, d, "part").filter(like(c("p_name"), "[a-c]%[^a-m]")).select("p_partkey", "p_name")


@query(r"SELECT n_nationkey, n_name FROM nation WHERE n_name LIKE 'NATION!_1%' ESCAPE '!'")
def filter_like_escape(spark, d):
    return t(spark, d, "nation").filter(F.expr("n_name LIKE 'NATION!_1%' ESCAPE '!'")).select("n_nationkey", "n_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey IN (1, 5, 9)")
def filter_in_list(spark, d):
    return t(spark, d, "customer").filter(c("c_nationkey").isin(1, 5, 9)).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey NOT IN (1, 5, 9)")
def filter_not_in_list(spark, d):
    return t(spark, d, "customer").filter(~c("c_nationkey").isin(1, 5, 9)).select("c_custkey", "c_mktsegment")


def _gaps(spark, d):
    """Customers with the suppliers of their nation, where there are any."""
    few = t(spark, d, "supplier").filter(c("s_nationkey") < 10).groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return t(spark, d, "customer").join(few, c("c_nationkey") == c("s_nationkey"), "left")


_GAPS = """customer LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey < 10
GROUP BY s_nationkey) s ON c_nationkey = s_nationkey"""


@query(f"SELECT c_custkey, c_nationkey FROM {_GAPS} WHERE n IS NULL")
def filter_is_null(spark, d):
    return _gaps(spark, d).filter(c("n").isNull()).select("c_custkey", "c_nationkey")


@query(f"SELECT c_custkey, n FROM {_GAPS} WHERE n IS NOT NULL")
def filter_is_not_null(spark, d):
    return _gaps(spark, d).filter(c("n").isNotNull()).select("c_custkey", "n")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 20 AND p_retailprice > 905 AND p_type LIKE 'PROMO%'")
def filter_and(spark, d):
    return t(spark, d, "part").filter((c("p_size") > 20) & (c("p_retailprice") > 905) & c("p_type").like("PROMO%")).select(*PART)


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size < 3 OR p_type = 'ECONOMY' AND p_size > 45")
def filter_or(spark, d):
    return t(spark, d, "part").filter((c("p_size") < 3) | ((c("p_type") == "ECONOMY") & (c("p_size") > 45))).select(*PART)


@query("SELECT p_partkey, p_name, p_size FROM part WHERE NOT (p_size < 30 OR p_type IN ('PROMO', 'ECONOMY') AND p_size <> 40)")
def filter_not(spark, d):
    inner = (c("p_size") < 30) | (c("p_type").isin("PROMO", "ECONOMY") & (c("p_size") != 40))
    return t(spark, d, "part").filter(~inner).select(*PART)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-04-01 00:00:00'")
def filter_date_literal(spark, d):
    stamp = lambda x: F.expr(f"TIMESTAMP_NTZ '{x} 00:00:00'")
    day = c("o_orderdate")
    return t(spark, d, "orders").filter((day >= stamp("1998-03-01")) & (day < stamp("1998-04-01"))).select("o_orderkey", day)


@query(f"SELECT c_custkey, (n > 1) IS TRUE AS is_true, (n > 1) IS NOT FALSE AS not_false, (n > 1) IS NULL AS is_unknown FROM {_GAPS}")
def bool_is_true(spark, d):
    return _gaps(spark, d).selectExpr(
        "c_custkey", "(n > 1) IS TRUE AS is_true", "(n > 1) IS NOT FALSE AS not_false", "(n > 1) IS UNKNOWN AS is_unknown"
    )


# -- sorts -------------------------------------------------------------------
# The place of a row is a column, so that the order itself is compared. That
# takes one task, and so is done on dimension tables.


# Results carry the place of each row: tables are sorted whole.


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice NULLS FIRST, o_orderkey) AS place FROM orders")
def order_by(spark, d):
    return numbered(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("SELECT o_orderkey AS k, o_totalprice * 2 AS twice, row_number() OVER (ORDER BY o_totalprice * 2, o_orderkey) AS place FROM orders")
def order_by_alias(spark, d):
    o = t(spark, d, "orders").select(c("o_orderkey").alias("k"), (c("o_totalprice") * 2).alias("twice"))
    return numbered(o, "twice", "k")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS place FROM orders")
def order_by_ordinal(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey")
    return numbered(o, *(c(o.columns[n - 1]) for n in (1, 2)))


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS place FROM orders")
def order_by_desc(spark, d):
    return numbered(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), c("o_totalprice").desc(), "o_orderkey")


@query(
    """SELECT c_custkey, n, row_number() OVER (ORDER BY n NULLS FIRST, c_custkey) AS place FROM customer LEFT JOIN
    (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey"""
)
def order_by_nulls_first(spark, d):
    sums = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    g = t(spark, d, "customer").join(sums, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "n")
    return numbered(g, c("n").asc_nulls_first(), "c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(c("o_totalprice").desc(), "o_orderkey").limit(10)
