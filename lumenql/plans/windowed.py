"""Window functions; every order has a unique tail and every frame is stated."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.windows import FIRST, HERE, LAST, frame, ranking
from .registry import query, table as t

c = F.col
BY, TIME = ("o_custkey",), ("o_orderdate", "o_orderkey")
_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_TO_HERE = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _orders(spark, d, **new):
    return t(spark, d, "orders").select("o_orderkey", *[v.alias(k) for k, v in new.items()])


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey, o_orderstatus), 2) AS total FROM orders")
def win_partition(spark, d):
    w = frame(("o_custkey", "o_orderstatus"))
    return _orders(spark, d, total=F.round(F.sum("o_totalprice").over(w), 2))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total FROM orders")
def win_sum(spark, d):
    return _orders(spark, d, total=F.round(F.sum("o_totalprice").over(frame(BY)), 2))


@query(f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_W} {_TO_HERE}), 2) AS running FROM orders")
def win_sum_running(spark, d):
    return _orders(spark, d, running=F.round(F.sum("o_totalprice").over(frame(BY, TIME)), 2))


@query(f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS near FROM orders")
def win_rows_sliding(spark, d):
    return _orders(spark, d, near=F.round(F.sum("o_totalprice").over(frame(BY, TIME, rows=(-2, 1))), 2))


@query(f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 2) AS later FROM orders")
def win_rows_following(spark, d):
    return _orders(spark, d, later=F.round(F.sum("o_totalprice").over(frame(BY, TIME, rows=(1, LAST))), 2))


@query(f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_W} ROWS 3 PRECEDING), 2) AS near FROM orders")
def win_rows_single_bound(spark, d):
    return _orders(spark, d, near=F.round(F.sum("o_totalprice").over(frame(BY, TIME, rows=(-3, HERE))), 2))


@query(f"SELECT o_orderkey, sum(o_totalprice) OVER ({_W} ROWS BETWEEN CURRENT ROW AND CURRENT ROW) AS own FROM orders")
def win_rows_current(spark, d):
    return _orders(spark, d, own=F.sum("o_totalprice").over(frame(BY, TIME, rows=(HERE, HERE))))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM part")
def win_range(spark, d):
    w = frame(("p_brand",), ("p_size",), values=(-3, 3))
    return t(spark, d, "part").select("p_partkey", F.count("*").over(w).alias("near"))


@query(f"SELECT o_orderkey, count(*) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before, count(o_totalprice) OVER (PARTITION BY o_custkey) AS of_all FROM orders")
def win_count(spark, d):
    return _orders(
        spark,
        d,
        before=F.count("*").over(frame(BY, TIME, rows=(-3, -1))),
        of_all=F.count("o_totalprice").over(frame(BY)),
    )


@query(f"SELECT o_orderkey, round(avg(o_totalprice) OVER ({_W} {_TO_HERE}), 8) AS mean FROM orders")
def win_avg(spark, d):
    return _orders(spark, d, mean=F.round(F.avg("o_totalprice").over(frame(BY, TIME)), 8))


@query(f"SELECT o_orderkey, min(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS low, max(o_totalprice) OVER ({_W} {_TO_HERE}) AS high, max(o_orderpriority) OVER (PARTITION BY o_custkey) AS top FROM orders")
def win_min_max(spark, d):
    return _orders(
        spark,
        d,
        low=F.min("o_totalprice").over(frame(BY, TIME, rows=(-2, 2))),
        high=F.max("o_totalprice").over(frame(BY, TIME, rows=(FIRST, HERE))),
        top=F.max("o_orderpriority").over(frame(BY)),
    )


@query(f"SELECT o_orderkey, row_number() OVER ({_W}) AS place FROM orders")
def win_row_number(spark, d):
    return _orders(spark, d, place=F.row_number().over(ranking(BY, TIME)).cast("bigint"))


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr FROM part")
def win_rank(spark, d):
    w = ranking(("p_brand",), ("p_size",))
    return t(spark, d, "part").select(
        "p_partkey", F.rank().over(w).cast("bigint").alias("r"), F.dense_rank().over(w).cast("bigint").alias("dr")
    )


@query(f"SELECT o_orderkey, first_value(o_totalprice) OVER ({_W} {_TO_HERE}) AS first FROM orders")
def win_first_value(spark, d):
    return _orders(spark, d, first=F.first_value("o_totalprice").over(frame(BY, TIME)))


@query(f"SELECT o_orderkey, first_value(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS first FROM orders")
def win_first_value_frame(spark, d):
    return _orders(spark, d, first=F.first_value("o_totalprice").over(frame(BY, TIME, rows=(-2, HERE))))


@query(f"SELECT o_orderkey, lag(o_totalprice, 2) OVER ({_W}) AS back FROM orders")
def win_lag(spark, d):
    return _orders(spark, d, back=F.lag("o_totalprice", 2).over(ranking(BY, TIME)))


@query(f"SELECT o_orderkey, lag(o_totalprice, 1, -1.0) OVER ({_W}) AS back FROM orders")
def win_lag_default(spark, d):
    return _orders(spark, d, back=F.lag("o_totalprice", 1, -1.0).over(ranking(BY, TIME)))


@query("SELECT event_id, lead(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events")
def win_lead(spark, d):
    w = ranking(("user_id",), ("ts", "event_id"))
    return t(spark, d, "events").select("event_id", F.lead("value", 1).over(w).alias("next"))


@query(f"SELECT o_orderkey, last_value(o_totalprice) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM orders")
def win_last_value(spark, d):
    return _orders(spark, d, last=F.last_value("o_totalprice").over(frame(BY, TIME, rows=(FIRST, LAST))))


@query(f"SELECT o_orderkey, sum(o_totalprice) OVER w AS near FROM orders WINDOW w AS ({_W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)")
def win_named(spark, d):
    t(spark, d, "orders").createOrReplaceTempView("lumenql_orders")
    return spark.sql(
        f"SELECT o_orderkey, sum(o_totalprice) OVER w AS near FROM lumenql_orders WINDOW w AS ({_W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)"
    )
