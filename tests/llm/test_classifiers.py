import random

import numpy as np
import pytest

from lumenql.llm import quality, toxicity


def held_out(rows, labels, column):
    known = {r.doc_id: r[column] for r in labels.collect()}
    return [(known[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in known]


def test_quality_held_out_accuracy(spark, data):
    rows = quality.op2_quality(spark, data).collect()
    found = held_out(rows, spark.read.parquet(f"{data}/labels.parquet"), "quality")
    assert len(rows) == 200 and all(0 <= r.score <= 1 for r in rows)
    assert sum(a == b for a, b in found) >= 0.9 * len(found)


def test_toxicity_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = toxicity.op9_toxicity(spark, folder).collect()
    found = held_out(rows, spark.read.parquet(f"{folder}/labels.parquet"), "toxic")
    assert sum(a == b for a, b in found) >= 0.9 * len(found)
    assert sum(b for a, b in found if not a) <= 1
    assert sum(b for a, b in found if a) >= 0.5 * sum(a for a, _ in found)


def made(spark, n=600):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghijklm", k=r.randint(3, 8)))
    bad = ["zozzig", "zozzigly", "quarble", "quarbles", "wexnor"]
    texts, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(5, 300))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(w) // 25)):
                w[r.randrange(len(w))] = r.choice(bad)
        text = " ".join(w)
        if i % 3 == 0:
            text = text.upper() + "!!! $$$ ###"
        texts.append((i, text, i))
        if i < n * 2 // 3:
            labels.append((i, int(i % 3 != 0), int(toxic)))
    texts += [(n, None, 0), (n + 1, "", 0), (n + 2, "x" * 200_000, 0), (None, "no id", 0), (1, texts[1][1], 0)]
    labels += [(n + 9, 1, 1), (None, 0, 0), (3, None, None)]
    return (
        spark.createDataFrame(texts, "doc_id long, text string, score int"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_made_texts(spark, which):
    docs, labels = made(spark)
    module = quality if which == "quality" else toxicity
    rows = module.scores(docs, labels).collect()
    assert len(rows) == 605 and all(0 <= r.score <= 1 for r in rows)
    new = [(r.doc, r.score >= 0.5) for r in rows if r.doc is not None and 400 <= r.doc < 600]
    right = sum(s == ((d % 3 != 0) if which == "quality" else (d % 4 == 0)) for d, s in new)
    # measured: the dictionaries of 200 training texts find less than the list of
    # marked stems did that they replaced (0.95 and more)
    assert right >= (0.95 if which == "quality" else 0.9) * len(new)
    assert len({r.score for r in rows if r.doc == 1}) == 1


@pytest.mark.parametrize("module, column", [(quality, "quality"), (toxicity, "toxic")])
@pytest.mark.parametrize("values, want", [([], 0.5), ([1, 1], 1.0), ([0], 0.0)])
def test_without_both_classes(spark, docs, module, column, values, want):
    ids = [i for i in range(200) if module.FOLDS][:100]
    labels = spark.createDataFrame([(i, v) for i in ids for v in values], f"doc_id long, {column} int")
    got = {r.score for r in module.scores(docs((1, "a"), (2, None)), labels).collect()}
    assert got == {0.0 if module is toxicity and not values else want}
    assert module.scores(docs(), labels).collect() == []


def test_keep_good_keeps_columns_and_good_texts(spark):
    docs, labels = made(spark)
    docs = docs.withColumnRenamed("score", "quality_ok")
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema
    ids = {r.doc_id for r in kept.collect()}
    good = {i for i in range(600) if i % 3}
    assert len(ids & good) >= 0.97 * len(good) and len(ids - good - {None, 600, 601, 602}) <= 10


def test_statistics_are_finite_for_odd_texts():
    for t in (None, b"", b" ", b"\n\n", b"\x00" * 10, b"a", b"1" * 10**6, "é".encode() * 99):
        assert np.isfinite(quality.statistics(t)).all() and len(quality.statistics(t)) == len(quality.FEATURES)


def test_discriminant_is_the_quadratic_rule():
    r = np.random.default_rng(0)
    x0, x1 = r.normal(0, 1, (4000, 2)), r.normal(0, 3, (4000, 2)) + [1, 0]
    sums = {c: (len(x), x.sum(axis=0), x.T @ x) for c, x in ((0, x0), (1, x1))}
    model = quality.Discriminant(sums)
    test = np.array([[0.0, 0.0], [6.0, 6.0], [-6.0, 0.0], [0.3, 0.2]])
    assert (model.score(test) > 0.5).tolist() == [False, True, True, False]
