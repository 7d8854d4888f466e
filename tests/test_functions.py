from pyspark.sql import functions as F

from lumenql.functions import scalar


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_like_sets_escapes_and_trailing_blanks(spark):
    df = spark.createDataFrame([("abc",), ("a-c",), ("a%c",), ("abc  ",), ("a]c",)], "s string")
    found = lambda p, e=None: [r.s for r in df.filter(scalar.like(F.col("s"), p, e)).collect()]
    assert found("a[a-c]c") == ["abc", "abc  "]
    assert found("a[^a-z]c") == ["a-c", "a%c", "a]c"]
    assert found("a!%c", "!") == ["a%c"]
    assert found("a_c") == ["abc", "a-c", "a%c", "abc  ", "a]c"]
    assert found("a.c") == []


def test_numbers_as_text_round_halves_away_from_zero(spark):
    assert one(spark, scalar.number_text(F.lit(2.345))) == "2.35"
    assert one(spark, scalar.number_text(F.lit(-2.345))) == "-2.35"


def test_average_of_whole_numbers_truncates_after_adding_a_half(spark):
    avg = lambda *v: spark.createDataFrame([(x,) for x in v], "v int").agg(scalar.rounded_avg(F.col("v"))).first()[0]
    assert (avg(1, 2), avg(-2, -3), avg(1, 1, 2)) == (2, -2, 1)


def test_date_models_round_trip(spark):
    iso = one(spark, scalar.to_date(F.lit("1981-05-30 18:36:23")))
    day_first = one(spark, scalar.to_date(F.lit("30/05/1981 18:36:23"), "DD/MM/YYYY HH24:MI:SS"))
    assert iso == day_first
    back = scalar.to_char(scalar.to_date(F.lit("1981-05-30 18:36:23")), "DD/MM/YYYY HH24:MI:SS")
    assert one(spark, back) == "30/05/1981 18:36:23"


def test_decode_matches_nulls(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "k int")
    got = df.select(scalar.decode(F.col("k"), 1, "one", None, "none", default="more")).collect()
    assert [r[0] for r in got] == ["one", "none", "more"]
