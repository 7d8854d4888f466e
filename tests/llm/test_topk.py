import math
import random

import numpy as np
import pytest

from lumenql.llm import topk


def brute(rows, k=5, every=50, scale=256):
    whole = []
    for i, v in rows:
        if i is None or v is None or any(c is None or not math.isfinite(c * scale) for c in v):
            continue
        whole.append((i, [math.floor(c * scale) for c in v]))
    out = []
    for q, x in [w for w in whole if w[0] % every == 0]:
        scored = []
        for i, y in whole:
            if i != q:
                n = max(len(x), len(y))
                a, b = x + [0] * (n - len(x)), y + [0] * (n - len(y))
                s = sum(p * r for p, r in zip(a, b, strict=True))
                scored.append((min(max(s, topk.LONG[0]), topk.LONG[1]), i))
        scored.sort(key=lambda r: (-r[0], r[1]))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    return sorted(tuple(r) for r in topk.top_k(df, lambda i: i % 50 == 0, **kw).collect())


def made(n, dim, spread, seed=1):
    r = random.Random(seed)
    return [
        (i, [r.gauss(0, 1) * math.exp(r.gauss(0, spread)) for _ in range(dim)], "x")
        for i in range(n)
    ]


@pytest.mark.parametrize("dim, spread", [(2, 0.0), (2, 1.5), (3, 0.2), (16, 1.0)])
def test_equals_brute_force_when_buckets_are_pruned(spark, monkeypatch, dim, spread):
    monkeypatch.setattr(topk, "BUCKET", 16)
    rows = made(700, dim, spread)
    assert run(spark, rows) == brute([r[:2] for r in rows])


def test_pruning_happens(monkeypatch):
    rows = made(2000, 2, 0.5)
    vs = np.array([r[1] for r in rows])
    lens = np.sqrt((vs * vs).sum(axis=1))
    order = np.argsort(-lens)
    verified = 0

    class Counting(topk._Best):
        def add(self, scores, ids):
            nonlocal verified
            verified += len(ids)
            super().add(scores, ids)

    best, ids = [Counting(5)], np.arange(2000)
    for at in range(0, 2000, 100):
        cut = order[at : at + 100]
        topk._bucket(best, np.array([0]), vs[:1], lens[:1], ids[cut], vs[cut], lens[cut])
    assert verified < 600


def test_ties_blocks_repeats_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 200)
    rows = [
        (0, [1.0, 0.0], "a"),
        (50, [0.0, 0.0], "a"),
        (100, [], "a"),
        (150, None, "a"),
        (200, [None, 1.0], "a"),
        (250, [float("nan"), 1.0], "a"),
        (300, [float("inf"), 1.0], "a"),
        (None, [1.0, 1.0], "a"),
        (350, [1e30, 2.0], "a"),
        (1, [1.0, 0.0], "a"),
        (2, [1.0, 0.0, 5.0], "a"),
        (3, [1.0, 0.0], "a"),
        (3, [1.0, 0.0], "a"),
        (4, [-1e30, 0.0], "a"),
        (5, [-0.001, 0.0], "a"),
    ]
    assert run(spark, rows) == brute([r[:2] for r in rows])


def test_one_hot_vector(spark):
    rows = made(300, 4, 0.3) + [(1000 + i, [1.0, 2.0, 3.0, 4.0], "x") for i in range(300)]
    assert run(spark, rows) == brute([r[:2] for r in rows])


def test_empty_table_and_few_vectors(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], "x")]) == []
    assert run(spark, [(0, [1.0], "x"), (1, [2.0], "x")]) == [(0, 1, 1, 256 * 512)]
