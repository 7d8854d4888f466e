import pytest

from lumenql.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(name, spark, data, agrees):
    agrees(QUERIES[name](spark, data), SQL[name])


def test_entry_runs(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, data):
    df = QUERIES["filter_between"](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_size)" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_size:int>" in plan
