import pytest

import corpus_pipeline


def test_stages_keep_columns_and_run_end_to_end(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = corpus_pipeline.run(spark, data)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert 0 < len(rows) < docs.count()
    assert all(0 < r.mix_taken <= 3 * r.mix_size for r in rows)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_every_stage_does_its_work(spark, data):
    from lumenql.llm import decontaminate, simhash, spans

    docs = spark.read.parquet(f"{data}/documents.parquet")
    _, near, cut, clean, _ = [f for _, f in corpus_pipeline.STAGES]
    one = near(spark, docs, data)
    again = simhash.near_duplicates(one).collect()
    assert len({r.first.doc for r in again}) == len(again)
    short = cut(spark, one, data)
    assert short.schema == docs.schema and short.count() == one.count()
    assert spans.without_repeats(one).filter("span_removed > 0").count() > 0
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    kept = clean(spark, short, data)
    assert decontaminate.contamination(kept, bench).filter("contaminated").count() == 0
    assert kept.count() < short.count()


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_nulls_repeats_and_nothing(spark, data, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    text = "And all of this is plain prose, with words and with stops. It goes on for a while, as prose does. " * 3
    rows = [(1, text, "en", "a", len(text))] * 2 + [(None, None, None, None, None), (2, "", "en", None, 0)]
    some = f(spark, spark.createDataFrame(rows, schema), data)
    assert some.columns[:5] == schema.names
    some.collect()
    assert f(spark, spark.createDataFrame([], schema), data).collect() == []


def test_operators_keep_columns_that_are_named_like_their_own(spark, data):
    from lumenql.llm import decontaminate, mixing, quality, simhash, spans

    names = "deco deco_key span_doc span_row span_starts simhash_key simhash_doc mix_info mix_rank quality_body".split()
    text = "All of this is prose. It has words, and it has stops. Some of it says the same as before. " * 4
    rows = [(i, text + str(i % 2), "en", "s", 1, *range(len(names))) for i in range(4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    docs = spark.createDataFrame(rows, schema)
    t = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    for out in (
        quality.keep_good(docs, t("labels")),
        simhash.keep_one(docs),
        spans.without_repeats(docs),
        decontaminate.drop_contaminated(docs, t("benchmark")),
        decontaminate.remove_spans(docs, t("benchmark")),
        mixing.mix(docs),
    ):
        assert [r[n] for r in out.collect() for n in names] == [*range(len(names))] * out.count()
