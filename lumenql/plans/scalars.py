"""Scalar functions and expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registry
from ..functions.scalar import date_pattern, day_start, days_between, decode, number_text, to_char, to_date
from .registry import query, table as t

c = F.col


@query("SELECT c_custkey, c_name || c_mktsegment AS label FROM customer")
def string_plus(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.concat("c_name", "c_mktsegment").alias("label"))


@query("SELECT c_custkey, c_name || ' / ' || c_mktsegment AS label FROM customer")
def string_concat(spark, d):
    return t(spark, d, "customer").selectExpr("c_custkey", "c_name || ' / ' || c_mktsegment AS label")


@query("SELECT c_custkey, abs(c_acctbal) AS size, abs(c_nationkey - 10) AS off FROM customer")
def fn_abs(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.abs("c_acctbal").alias("size"), F.abs(c("c_nationkey") - 10).alias("off"))


@query("SELECT p_partkey, round(sqrt(p_retailprice), 9) AS root FROM part")
def fn_sqrt(spark, d):
    return t(spark, d, "part").select("p_partkey", F.round(F.sqrt("p_retailprice"), 9).alias("root"))


@query("SELECT p_partkey, substring(p_name, 1, 3) AS head, substring(p_name, 1, 2) AS zero, substring(p_name, 4) AS tail FROM part")
def fn_substring(spark, d):
    return t(spark, d, "part").selectExpr(
        "p_partkey", "substring(p_name, 1, 3) AS head", "substr(p_name, 0, 2) AS zero", "substring(p_name, 4) AS tail"
    )


@query("SELECT p_partkey, substring(p_name, -3, 2) AS part, substring(p_name, -4) AS tail FROM part")
def fn_substring_neg(spark, d):
    return t(spark, d, "part").selectExpr("p_partkey", "substring(p_name, -3, 2) AS part", "substring(p_name, -4) AS tail")


@query("SELECT p_partkey, replace(replace(p_name, 'widget', 'part'), ' ', '_') AS name FROM part")
def fn_replace(spark, d):
    inner = F.replace(c("p_name"), F.lit("widget"), F.lit("part"))
    return t(spark, d, "part").select("p_partkey", F.replace(inner, F.lit(" "), F.lit("_")).alias("name"))


@query("SELECT o_orderkey, cast(date_trunc('day', o_orderdate) AS TIMESTAMP) AS day FROM orders")
def fn_to_date(spark, d):
    text = F.date_format("o_orderdate", date_pattern("DD/MM/YYYY"))
    return t(spark, d, "orders").select("o_orderkey", to_date(text, "DD/MM/YYYY").alias("day"))


@query("SELECT p_partkey, printf('%.2f', round(p_retailprice, 2)) AS price, cast(p_size AS VARCHAR) AS size FROM part")
def fn_to_char_num(spark, d):
    return t(spark, d, "part").select("p_partkey", number_text(c("p_retailprice")).alias("price"), to_char(c("p_size")).alias("size"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS month FROM orders")
def fn_to_char_date(spark, d):
    return t(spark, d, "orders").select("o_orderkey", to_char(c("o_orderdate"), "YYYYMM").alias("month"))


@query("SELECT o_orderkey, cast(year(o_orderdate) AS INTEGER) AS y, cast(month(o_orderdate) AS INTEGER) AS m, cast(day(o_orderdate) AS INTEGER) AS d FROM orders")
def fn_year_month_day(spark, d):
    day = c("o_orderdate")
    return t(spark, d, "orders").select(
        "o_orderkey", F.year(day).alias("y"), F.month(day).alias("m"), F.dayofmonth(day).alias("d")
    )


@query("SELECT event_id, cast(date_trunc('day', ts) AS TIMESTAMP) AS day FROM events")
def fn_date_trunc(spark, d):
    return t(spark, d, "events").select("event_id", day_start(c("ts")).alias("day"))


@query("SELECT o_orderkey, cast(date_diff('day', TIMESTAMP '1995-01-01 00:00:00', o_orderdate) AS INTEGER) AS age FROM orders")
def fn_date_minus(spark, d):
    start = F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00'")
    return t(spark, d, "orders").select("o_orderkey", days_between(c("o_orderdate"), start).alias("age"))


@query("SELECT n_nationkey, true AS ok FROM nation")
def fn_current_date(spark, d):
    now = F.current_timestamp()
    return t(spark, d, "nation").select("n_nationkey", (now > F.lit("2020-01-01").cast("timestamp")).alias("ok"))


@query("SELECT c_custkey, cast(trunc(c_acctbal) AS INTEGER) AS whole, cast(c_nationkey AS VARCHAR) AS text, cast(c_nationkey AS DOUBLE) AS real FROM customer")
def fn_cast(spark, d):
    return t(spark, d, "customer").select(
        "c_custkey",
        c("c_acctbal").cast("int").alias("whole"),
        c("c_nationkey").cast("string").alias("text"),
        c("c_nationkey").cast("double").alias("real"),
    )


@query("SELECT n_nationkey, coalesce(s_suppkey, -1) AS supplier FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey < 12) ON n_nationkey = s_nationkey")
def fn_nvl(spark, d):
    few = t(spark, d, "supplier").filter(c("s_nationkey") < 12)
    joined = t(spark, d, "nation").join(few, c("n_nationkey") == c("s_nationkey"), "left")
    return joined.select("n_nationkey", F.nvl(c("s_suppkey"), F.lit(-1).cast("bigint")).alias("supplier"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state, CASE o_orderstatus WHEN 'P' THEN 1 END AS part FROM orders")
def fn_decode(spark, d):
    s = c("o_orderstatus")
    return t(spark, d, "orders").select(
        "o_orderkey", decode(s, "F", "done", "O", "open", default="other").alias("state"), decode(s, "P", 1).alias("part")
    )


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE NULL END AS rank FROM orders")
def case_simple(spark, d):
    return t(spark, d, "orders").selectExpr(
        "o_orderkey", "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE NULL END AS rank"
    )


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size FROM part")
def case_searched(spark, d):
    s = c("p_size")
    return t(spark, d, "part").select("p_partkey", F.when(s < 10, "small").when(s < 30, "middle").otherwise("large").alias("size"))


@query("SELECT p_partkey, p_size * 2 + 1 AS odd FROM part")
def udf_scalar(spark, d):
    double_odd = registry.register(spark, "odd", lambda s: s * 2 + 1, "int")
    return t(spark, d, "part").select("p_partkey", double_odd("p_size").alias("odd"))
