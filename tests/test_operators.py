import pytest
from pyspark.sql import functions as F

from lumenql.operators import dml, setops
from lumenql.operators.grouping import with_multiplicity
from lumenql.operators.joins import range_join
from lumenql.operators.quantified import compare_quantified
from lumenql.operators.windows import FIRST, HERE, LAST, frame, numbered


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def kv(spark):
    return spark.createDataFrame([(1, 10), (2, None), (None, 30)], "k int, v int")


def test_default_frame_counts_rows_not_ties(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 3), ("b", 1, 4)], "p string, o int, v int")
    got = df.select("v", F.sum("v").over(frame(("p",), ("o", "v"))).alias("s"))
    assert rows(got) == [(1, 1), (2, 3), (3, 6), (4, 4)]
    ranged = df.select("v", F.sum("v").over(frame(("p",), ("o",), values=(FIRST, HERE))).alias("s"))
    assert rows(ranged) == [(1, 3), (2, 3), (3, 6), (4, 4)]
    none = df.select("v", F.sum("v").over(frame(("p",), ("v",), rows=(-3, -3))), F.count("v").over(frame(("p",), ("v",), rows=(-3, -3))))
    assert rows(none)[0] == (1, None, 0)


def test_illegal_frames():
    for bad in ((LAST, LAST), (FIRST, FIRST), (1, 0)):
        with pytest.raises(ValueError):
            frame(("p",), ("o",), rows=bad)


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
@pytest.mark.parametrize("which", ["ALL", "ANY"])
@pytest.mark.parametrize("right", [[1, 2], [2], [], [1, None], [None]])
def test_quantified_comparisons(spark, duck, op, which, right):
    values = [1, 2, 3, None]
    left = spark.createDataFrame([(v,) for v in values], "v int")
    got = compare_quantified(left, F.col("v"), op, which, spark.createDataFrame([(v,) for v in right], "w int"))
    lit = lambda xs: ", ".join(f"({'NULL::INT' if x is None else x})" for x in xs)
    source = f"(VALUES {lit(right)}) r(w)" if right else "(SELECT 1 AS w WHERE false) r"
    want = duck.sql(f"SELECT v FROM (VALUES {lit(values)}) l(v) WHERE v {op} {which} (SELECT w FROM {source})").fetchall()
    assert rows(got) == sorted(want, key=repr)


def test_range_join_is_a_theta_join(spark):
    points = spark.createDataFrame([(x / 3,) for x in range(-20, 60)], "x double")
    ranges = spark.createDataFrame([(1, 0.0, 5.0), (2, 4.5, 4.6), (3, 7.0, 7.0), (4, -6.0, 30.0), (5, None, 1.0)], "r int, lo double, hi double")
    got = range_join(points, F.col("x"), ranges, F.col("lo"), F.col("hi"), 2.5).select("x", "r")
    want = points.join(ranges, (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).select("x", "r")
    assert rows(got) == rows(want)


def test_range_join_of_odd_values_and_few_hot_ones(spark, monkeypatch):
    inf, nan = float("inf"), float("nan")
    edges = [None, nan, inf, -inf, 0.0, -0.0, 1e300, -1e300, 1e-300, 5e-324, 7.0, 7.25, 1e17, 900.0]
    points = spark.createDataFrame([(x,) for x in edges] + [(900.0 + k % 7,) for k in range(300)], "x double")
    ranges = spark.createDataFrame([(x, y) for x in edges for y in edges], "lo double, hi double")
    want = points.join(ranges, (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).select("x", "lo", "hi")
    for share in (1 << 26, 100):  # whole and shared cells
        monkeypatch.setattr("lumenql.operators.joins.SHARE_PAIRS", share)
        for width in (None, 50):
            got = range_join(points, F.col("x"), ranges, F.col("lo"), F.col("hi"), width).select("x", "lo", "hi")
            assert repr(rows(got)) == repr(rows(want))  # nan differs from itself


def test_range_join_deals_points_of_one_bucket_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr("lumenql.operators.joins.SHARE_PAIRS", 10_000)
    points = spark.range(2000).select((F.col("id") % 10 + 900).cast("double").alias("x"))
    ranges = spark.range(200).select((F.col("id") % 10 + 890).cast("double").alias("lo"))
    got = range_join(points, F.col("x"), ranges, F.col("lo"), F.col("lo") + 25, 50)
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(t[1] for t in tasks) == 400_000
    assert max(t[1] for t in tasks) < 200_000
    # a range of a million widths is filed under a few cells
    wide = spark.createDataFrame([(0.0, 5e13)], "lo double, hi double")
    assert range_join(points, F.col("x"), wide, F.col("lo"), F.col("hi"), 50).count() == 2000


def test_set_operations(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(2,), (2,), (4,)], "j int")
    assert rows(setops.chain(a, ("UNION", b))) == [(1,), (2,), (3,), (4,)]
    assert rows(setops.chain(a, ("UNION ALL", b))) == [(1,), (1,), (2,), (2,), (2,), (3,), (4,)]
    assert rows(setops.chain(a, ("MINUS", b))) == [(1,), (3,)]
    assert rows(setops.chain(a, ("INTERSECT", b))) == [(2,)]
    assert rows(setops.chain(a, ("UNION", b), ("MINUS", a.filter("k = 1")))) == [(2,), (3,), (4,)]
    with pytest.raises(setops.SetOperationError):
        setops.chain(a, ("UNION", a.select("k", "k")))
    with pytest.raises(setops.SetOperationError):
        setops.chain(a, ("UNION", spark.createDataFrame([("x",)], "s string")))


def test_multiplicity(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3)], "a int, b int")
    assert rows(with_multiplicity(df)) == [(1, None, 2), (2, 3, 1)]


def test_updates_and_deletes_keep_rows_with_unknown_conditions(kv):
    assert rows(dml.update(kv, {"v": 0}, F.col("v") > 5)) == [(1, 0), (2, None), (None, 0)]
    assert rows(dml.update(kv, {"v": 7})) == [(1, 7), (2, 7), (None, 7)]
    assert rows(dml.delete(kv, F.col("v") > 20)) == [(1, 10), (2, None)]
    assert rows(dml.delete(kv)) == rows(dml.truncate(kv)) == []


def test_tuples_are_tested_together(spark, kv):
    keys = spark.createDataFrame([(1, 99), (2, 10), (1, 10)], "a int, b int")
    assert rows(dml.update_in(kv, {"v": 0}, ["k", "v"], keys)) == [(1, 0), (2, None), (None, 30)]
    assert rows(dml.delete_in(kv, ["k", "v"], keys)) == [(2, None), (None, 30)]


def test_inserts(spark, kv):
    assert rows(dml.insert_values(kv.limit(0), ["v"], [(5,), (6,)])) == [(None, 5), (None, 6)]
    more = spark.createDataFrame([(8,)], "x int")
    assert rows(dml.insert_select(kv.limit(0), ["k"], more)) == [(8, None)]
    with pytest.raises(dml.ChangeError):
        dml.insert_values(kv, ["nope"], [(1,)])


def test_merge(spark, kv):
    news = spark.createDataFrame([(1, 11), (5, 55)], "id int, n int")
    upsert = dml.merge(kv, news, {"k": "id"}, {"v": "n"}, {"k": "id", "v": "n"})
    assert rows(upsert) == [(1, 11), (2, None), (5, 55), (None, 30)]
    gone = dml.merge(kv, news, {"k": "id"}, "DELETE", None, {"v": -1})
    assert rows(gone) == [(2, -1), (None, -1)]
    only = dml.merge(kv, news, {"k": "id"}, None, None, "DELETE")
    assert rows(only) == [(1, 10)]


def test_places_need_no_single_task(spark):
    values = [(i * 7919 % 500 if i % 3 else None, i) for i in range(900)]
    df = spark.createDataFrame(values, "v int, i int")
    got = {r.i: r.place for r in numbered(df, F.col("v").asc_nulls_first(), "i").collect()}
    order = sorted(values, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [got[i] for _, i in order] == list(range(1, 901))
    down = {r.i: r.place for r in numbered(df, F.col("v").desc_nulls_last(), "i").collect()}
    order = sorted(values, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [down[i] for _, i in order] == list(range(1, 901))
    assert numbered(df.limit(0), "v").collect() == []
