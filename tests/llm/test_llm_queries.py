import pytest

from lumenql.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_its_sql(name, spark, data, agrees):
    agrees(queries.QUERIES[name](spark, data), queries.SQL[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
