"""Changes to tables: each query returns the state after the change."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dml
from .registry import query, table as t

c = F.col


@query("SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY n_regionkey")
def ctas(spark, d):
    return t(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("nations"))


@query("SELECT * FROM region UNION ALL SELECT 77, 'NOWHERE' UNION ALL SELECT 78, NULL")
def insert_values(spark, d):
    once = dml.insert_values(t(spark, d, "region"), ["r_name", "r_regionkey"], [("NOWHERE", 77)])
    return dml.insert_values(once, ["r_regionkey"], [(78,)])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, NULL FROM region")
def insert_select(spark, d):
    more = t(spark, d, "region").select((c("r_regionkey") + 100).alias("k"), "r_name")
    return dml.insert_select(t(spark, d, "nation"), ["n_nationkey", "n_name"], more)


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'blocked' ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_where(spark, d):
    return dml.update(t(spark, d, "supplier"), {"s_name": "blocked", "s_acctbal": 0.0}, c("s_acctbal") < 0)


@query("SELECT n_nationkey, CASE WHEN (n_nationkey, n_regionkey) IN (SELECT s_nationkey, 1 FROM supplier) THEN 'seen' ELSE n_name END AS n_name, n_regionkey FROM nation")
def update_in_subquery(spark, d):
    keys = t(spark, d, "supplier").select("s_nationkey", F.lit(1).alias("one"))
    return dml.update_in(t(spark, d, "nation"), {"n_name": "seen"}, ["n_nationkey", "n_regionkey"], keys)


@query("SELECT * FROM supplier WHERE NOT (s_nationkey = 3 AND s_acctbal > 0)")
def delete_where(spark, d):
    return dml.delete(t(spark, d, "supplier"), (c("s_nationkey") == 3) & (c("s_acctbal") > 0))


@query("SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def delete_in_subquery(spark, d):
    return dml.delete_in(t(spark, d, "nation"), ["n_nationkey"], t(spark, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT * FROM region WHERE false")
def truncate(spark, d):
    return dml.truncate(t(spark, d, "region"))


def _news(spark, d):
    n = t(spark, d, "nation")
    return n.filter(c("n_regionkey") < 2).select(
        F.when(c("n_regionkey") == 0, c("n_nationkey")).otherwise(c("n_nationkey") + 100).alias("k"),
        F.concat(F.lit("new "), "n_name").alias("label"),
    )


_NEWS = """(SELECT CASE WHEN n_regionkey = 0 THEN n_nationkey ELSE n_nationkey + 100 END AS k,
'new ' || n_name AS label FROM nation WHERE n_regionkey < 2)"""


@query(f"SELECT coalesce(n_nationkey, k) AS n_nationkey, coalesce(label, n_name) AS n_name, n_regionkey FROM nation FULL JOIN {_NEWS} ON n_nationkey = k")
def merge_upsert(spark, d):
    return dml.merge(
        t(spark, d, "nation"),
        _news(spark, d),
        {"n_nationkey": "k"},
        matched={"n_name": "label"},
        not_matched={"n_nationkey": "k", "n_name": "label"},
    )


@query(f"SELECT n_nationkey, 'unknown' AS n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT k FROM {_NEWS})")
def merge_delete(spark, d):
    return dml.merge(
        t(spark, d, "nation"),
        _news(spark, d),
        {"n_nationkey": "k"},
        matched="DELETE",
        not_matched_by_source={"n_name": "unknown"},
    )
