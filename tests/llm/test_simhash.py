import random

import numpy as np
import pytest
import xxhash

from lumenql.llm import simhash
from lumenql.llm.graph import components


def brute_fingerprint(text):
    import re

    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]
    if not w:
        return 0
    each = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in each]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "a b c", "É b c d é", "a  b\x0bc d e f" * 9, "x " * 5000])
def test_fingerprints(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("limit", [4, 256])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "FILE_ROWS", limit)
    r = random.Random(limit)
    fps = {r.getrandbits(64) for _ in range(150)}
    for c in [r.getrandbits(64) for _ in range(4)]:  # dense clusters and chains
        for _ in range(60):
            fps.add(c ^ sum(1 << b for b in r.sample(range(12), r.randint(0, 4))))
            c ^= 1 << r.randrange(64) if r.random() < 0.1 else 0
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {x.node: x.root for x in components(simhash.links(df)).collect()}
    want = brute_components(fps, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert {f: roots.get(f, f) for f in fps} == want


def test_any_plan_covers_all_pairs():
    r = random.Random(3)
    few = np.array([r.getrandbits(64) for _ in range(500)], np.uint64)
    for count in (1, 1000, 10**6, 10**9):
        masks = simhash.masks_of(simhash.plan(few, count))
        for _ in range(300):
            a = r.getrandbits(64)
            b = a ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 3)))
            assert any(a & m == b & m for m in masks)
    assert simhash.plan(few, 10**9) != simhash.plan(few, 1000)
    simhash.plan(np.array([], np.uint64), 0)
    simhash.plan(np.zeros(3, np.uint64), 3)


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (102, 100), (103, 103), (100, 101)]
    random.Random(5).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in (100, 101, 102)}, 103: 103}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_documents_with_nulls_copies_and_repeated_rows(spark, docs):
    base = " ".join(f"w{i}" for i in range(300))
    near = base.replace("w150", "other")
    rows = [(9, base, 1), (4, base, 2), (4, base, 2), (7, near, 3), (None, base, 4), (1, None, 5), (2, "", 6), (3, "alone", 7)]
    d = docs(*rows, extra=", fp int")
    got = sorted((r.doc is None, r.doc, r.first.doc) for r in simhash.near_duplicates(d).collect())
    same = (simhash.fingerprint(base.encode()) ^ simhash.fingerprint(near.encode())).bit_count() <= 3
    assert got == sorted(
        [(False, 9, 4), (False, 4, 4), (False, 4, 4), (False, 7, 4 if same else 7), (True, None, 4)]
        + [(False, 1, 1), (False, 2, 1), (False, 3, 3)],
        key=lambda x: (x[0], x[1] or 0),
    )
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(tuple(r) for r in kept.collect()) == sorted([(4, base, 2), (1, None, 5), (3, "alone", 7)] + ([] if same else [(7, near, 3)]))


def test_empty_table(docs):
    assert simhash.near_duplicates(docs()).collect() == simhash.keep_one(docs()).collect() == []


def test_query_equals_brute_force(spark, data):
    rows = simhash.op8_simhash(spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert all(int(r.fingerprint, 16) == brute_fingerprint(texts[r.doc_id]) for r in rows if r.doc_id % 5 == 0)
    fp = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    want = brute_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    assert {r.doc_id: r.component_id for r in rows} == want
