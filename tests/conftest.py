import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"
NAMES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark():
    from lumenql.session import session

    s = session(
        "tests",
        **{
            "spark.master": "local[4]",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    for n in NAMES:
        if os.path.exists(f"{data}/{n}.parquet"):
            c.sql(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{data}/{n}.parquet')")
    return c


@pytest.fixture(scope="session")
def agrees(duck):
    """Whether a DataFrame has the rows of a statement, in any order."""

    def check(df, sql):
        rel = duck.sql(sql)
        assert sorted(rel.columns) == sorted(df.columns)
        at = [rel.columns.index(c) for c in df.columns]
        want = sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
        assert sorted(repr(tuple(r)) for r in df.collect()) == want

    return check
