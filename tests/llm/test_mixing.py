import random
from fractions import Fraction

from lumenql.llm import mixing


def targets(sizes, weights=(1, 2, 3), most=3):
    """Exact water-filling over (source, words) by brute force."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = sum(w[s] for s in order if s not in capped)
        rest = total - sum(most * sizes[s] for s in capped)
        t = {s: Fraction(most * sizes[s]) if s in capped else Fraction(rest * w[s], left) for s in order}
        new = {s for s in order if t[s] > most * sizes[s]}
        if not new:
            return t
        capped |= new


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size int, bucket string")


def check(spark, rows):
    got = mixing.mix(make(spark, rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").split())
    words = {}
    for _, t, s, *_ in rows:
        words[s] = words.get(s, 0) + size(t)
    want = targets(words) if words else {}
    taken = {}
    for r in got:
        assert r.mix_size == size(r.text) and r.mix_source_size == words[r.source]
        assert abs(r.mix_target - float(want[r.source])) <= 1e-9 * max(1, float(want[r.source]))
        assert 0 <= r.mix_taken <= 3 * r.mix_size
        taken[r.source] = taken.get(r.source, 0) + r.mix_taken
    for s, n in taken.items():
        assert abs(n - float(want[s])) <= 1
    assert sum(taken.values()) >= sum(words.values()) - len(words)
    return sorted((r.doc_id or -1, r.mix_taken) for r in got)


def test_targets_are_met_and_reruns_agree(spark):
    r = random.Random(7)
    rows = [
        (i, "w " * int(r.paretovariate(1.2) * 20), r.choice(["a", "a", "a", "a", "b", "Z", "é", None]), 9, "x")
        for i in range(800)
    ]
    assert check(spark, rows) == check(spark, rows[::-1])


def test_caps_nulls_repeats_and_empty_sources(spark):
    rows = [
        (1, "one two", "small", 0, "x"),
        (2, "w " * 1000, "huge", 0, "x"),
        (2, "w " * 1000, "huge", 0, "x"),
        (3, None, "none", 0, "x"),
        (4, "", "none", 0, "x"),
        (None, "a b c", None, 0, "x"),
    ]
    check(spark, rows)
    check(spark, [(1, "", "a", 0, "x")])
    check(spark, [(1, "only one source", "a", 0, "x")])
    assert mixing.mix(make(spark, [])).collect() == []


def test_many_sources(spark):
    check(spark, [(i, "w " * (i % 17), f"s{i % 97}", 0, "x") for i in range(600)])


def test_the_mix_is_emitted(spark):
    rows = [(i, "  ".join(f"d{i}w{k}" for k in range(i % 9)), "abc"[i % 3 and i % 2], i, "x") for i in range(60)]
    rows += [(100, None, None, 0, None), (101, "", "a", 0, None), (102, "long " * 50000, "c", 0, None)]
    mixed = mixing.mix(make(spark, rows))
    taken = {r.doc_id: (r.mix_taken, r.mix_size) for r in mixed.collect()}
    out = mixing.emit(mixed)
    assert out.columns == ["doc_id", "text", "source", "bucket", "mix_copy"]
    got, texts = {}, {i: t for i, t, *_ in rows}
    for r in out.collect():
        own = r.text.split()
        got[r.doc_id] = got.get(r.doc_id, 0) + len(own)
        assert own == texts[r.doc_id].split()[: len(own)]
        n, size = taken[r.doc_id]
        assert r.mix_copy * size > n or r.text == texts[r.doc_id]
    assert got == {i: n for i, (n, _) in taken.items() if n}
    assert mixing.emit(mixing.mix(make(spark, []))).collect() == []


def test_hot_and_null_ids(spark):
    check(spark, [(7, "same id " * (i % 5), "a", 0, "") for i in range(300)] + [(None, "no id", None, 0, "")] * 200)
