"""Statements of the dialect, run as text by the engine."""

from __future__ import annotations

from ..engine import Engine
from .registry import query, registered

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _engine(spark, d) -> Engine:
    e = Engine(spark)
    e.open(d, TABLES)
    return e


@query("SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, '[^a-m].*t *') AND p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_retailprice < 1000)")
def sql_like_and_all(spark, d):
    return _engine(spark, d).execute(
        "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '[^a-m]%t' "
        "AND p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_retailprice < 1000);"
    )


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders WHERE o_orderdate >= TIMESTAMP '1990-12-31 00:00:00'")
def sql_window_default_frame(spark, d):
    return _engine(spark, d).execute(
        "SELECT o_orderkey, round(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running "
        "FROM orders WHERE o_orderdate >= '12/31/1990 00:00:00' ;"
    )


@query("SELECT c_name || '-' || c_mktsegment AS label, CASE c_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'more' END AS word FROM customer")
def sql_plus_and_decode(spark, d):
    return _engine(spark, d).execute(
        "SELECT c_name + '-' + c_mktsegment AS label, DECODE(c_nationkey, 1, 'one', 2, 'two', 'more') AS word FROM customer"
    )


@query("SELECT n_regionkey, n_name FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 9, 'ATLANTIS'")
def sql_changes(spark, d):
    e = _engine(spark, d)
    e.run(
        "INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (99, 'X', 9);"
        "UPDATE nation SET n_name = 'ATLANTIS' WHERE n_nationkey = 99;"
        "DELETE FROM nation WHERE n_nationkey = 4; -- gone"
    )
    return e.execute("SELECT n_regionkey, n_name FROM nation")


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > ANY (SELECT avg(s_acctbal) FROM supplier)")
def sql_minus_any(spark, d):
    return _engine(spark, d).execute(
        "SELECT n_nationkey AS k FROM nation MINUS SELECT s_nationkey FROM supplier "
        "WHERE s_acctbal > ANY (SELECT AVG(s_acctbal) FROM supplier)"
    )


@query("SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) AS n FROM orders GROUP BY ALL")
def sql_dates(spark, d):
    return _engine(spark, d).execute(
        "SELECT TO_CHAR(DATE(o_orderdate), 'YYYYMM') AS month, COUNT(*) AS n FROM orders "
        "WHERE o_orderdate > TO_DATE('01/01/1990', 'DD/MM/YYYY') GROUP BY TO_CHAR(DATE(o_orderdate), 'YYYYMM')"
    )


@query("SELECT n_regionkey, count(*) AS nations FROM nation WHERE n_name > 'C' GROUP BY n_regionkey")
def sql_ctas(spark, d):
    e = _engine(spark, d)
    e.run(
        "CREATE TABLE counts AS SELECT n_regionkey, COUNT(*) AS nations FROM nation WHERE n_name > 'C' GROUP BY n_regionkey;"
        "CREATE TABLE again AS SELECT * FROM counts"
    )
    return e.execute("SELECT * FROM again")


@query("SELECT coalesce(n_nationkey, r_regionkey + 23) AS n_nationkey, coalesce(r_name, n_name) AS n_name, n_regionkey FROM nation FULL JOIN region ON n_nationkey = r_regionkey + 23")
def sql_merge(spark, d):
    e = _engine(spark, d)
    e.execute("CREATE TABLE news AS SELECT r_regionkey + 23 AS k, r_name AS label FROM region")
    e.execute(
        "MERGE INTO nation AS a USING news b ON b.K = a.N_NATIONKEY WHEN MATCHED THEN UPDATE SET a.N_NAME = b.label "
        "WHEN NOT MATCHED THEN INSERT (N_NATIONKEY, N_NAME) VALUES (b.k, b.label)"
    )
    return e.execute("SELECT * FROM nation")


@query("SELECT n_nationkey + 1 AS a, n_name || r_name AS b, substr(n_name, 1, 2) || substr(r_name, 1, 2) AS c, n_nationkey + r_regionkey AS e FROM nation JOIN region ON n_regionkey = r_regionkey")
def sql_plus_types(spark, d):
    return _engine(spark, d).execute(
        "SELECT n_nationkey + 1 AS a, x.n_name + y.r_name AS b, SUBSTR(n_name, 1, 2) + SUBSTR(r_name, 1, 2) AS c, "
        "n_nationkey + r_regionkey AS e FROM nation x, region AS y WHERE n_regionkey = r_regionkey"
    )


@query("SELECT p_partkey FROM part WHERE p_size * 2 + 1 > (SELECT max(p_size) FROM part WHERE p_retailprice < 1000) AND p_size - 1 <> 5")
def sql_quantified_expression(spark, d):
    return _engine(spark, d).execute(
        "SELECT p_partkey FROM part WHERE p_size * 2 + 1 > ALL (SELECT p_size FROM part WHERE p_retailprice < 1000) AND p_size - 1 <> 5"
    )


@query("SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01 00:00:00' THEN o_orderstatus || ' WHERE old' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01 00:00:00' THEN o_totalprice * 2 + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def sql_update_expression(spark, d):
    e = _engine(spark, d)
    e.execute(
        "UPDATE orders SET o_orderstatus = o_orderstatus + ' WHERE old', o_totalprice = o_totalprice * 2 + 1 "
        "WHERE o_orderdate < TO_DATE('01/01/1996', '%d/%m/%Y')"
    )
    return e.execute("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")


# -- twins -------------------------------------------------------------------
# Queries of the other families, run as text: the statement that the DataFrame
# is compared with is in the dialect as it stands.

TWINS = """
    agg_global agg_empty agg_sum agg_count_star agg_count_col agg_avg agg_min_max agg_min_max_string agg_expr
    agg_count_distinct group_by_single group_by_multi group_by_hidden_key having select_distinct select_all
    join_implicit join_inner join_left join_range join_multi_key join_3way join_star join_cycle join_self
    join_using project_columns select_star select_qualified_star table_and_column_alias derived_table
    distinct_values_scan project_constant project_expr arith arith_neg filter_cmp filter_col_col filter_between
    filter_not_between filter_like filter_not_like filter_like_escape filter_in_list filter_not_in_list
    filter_is_null filter_is_not_null filter_and filter_or filter_not filter_date_literal bool_is_true top_k
    string_plus string_concat fn_abs fn_sqrt fn_substring fn_substring_neg fn_replace fn_to_date
    fn_year_month_day fn_date_trunc fn_nvl fn_decode case_simple case_searched union_distinct union_all minus
    intersect set_chain union_type_widen in_subquery in_subquery_empty not_in_subquery not_in_subquery_null
    scalar_subquery exists_subquery not_exists_subquery gt_all_subquery le_all_empty_subquery eq_any_subquery
    lt_some_subquery tuple_in_subquery win_partition win_sum win_sum_running win_rows_sliding win_rows_following
    win_rows_single_bound win_rows_current win_range win_count win_avg win_min_max win_row_number win_rank
    win_first_value win_first_value_frame win_lag win_lag_default win_lead win_last_value win_named
""".split()


def _twin(name: str) -> None:
    sql = registered(name).sql
    query(sql, f"sql_{name}")(lambda spark, d: _engine(spark, d).execute(sql))


def add_twins() -> None:
    """Once all families are registered."""
    for name in TWINS:
        _twin(name)
