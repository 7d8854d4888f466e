import re

import pytest

from lumenql.llm import decontaminate as deco
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items):
    wins = {}
    for k, t in items:
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = []
    for d, t in rows:
        w, hit, who = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    who |= wins[tuple(w[i : i + n])]
        ids = sorted(str(k) for k in who if k is not None)
        out.append((d, len(w), len(hit), ids, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


LONG = " ".join(f"item{i}" for i in range(20))
ITEMS = [(1, LONG), (2, "Short ONE, here"), (3, ""), (4, None), (10, LONG), (5, "é É x")]
ROWS = [
    (1, "before " + LONG.upper() + " after"),
    (2, " ".join(LONG.split()[:12])),
    (3, "a short one-here and " + "pad " * 100),
    (4, None),
    (5, ""),
    (6, "É é x / é É x"),
    (7, "it's " + LONG[:-1] + " 'quoted' \\ back " + "z " * 900),
    (8, "short one here"),
    (8, "short one here"),
    (9, "clean text"),
]


@pytest.fixture
def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def compared(df):
    import hashlib

    sha = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())
    want = sorted((d, n, h, len(i), sha(i), c) for d, n, h, i, c in brute(ROWS, ITEMS))
    return got, want


def test_equals_brute_force(docs, bench):
    got, want = compared(deco.contamination(docs(*ROWS), bench))
    assert got == want and any(w[5] for w in want) and sum(w[2] > 0 and not w[5] for w in want) == 2


def test_large_benchmarks_are_joined_by_hash(docs, bench, monkeypatch):
    monkeypatch.setattr(deco, "SET_ROWS", 3)
    monkeypatch.setattr(deco, "BROADCAST_BYTES", 1)
    got, want = compared(deco.contamination(docs(*ROWS), bench))
    assert got == want


def test_contaminated_documents_go_and_columns_stay(docs, bench):
    d = docs(*[(*r, "x") for r in ROWS], extra=", window string")
    kept = deco.drop_contaminated(d, bench)
    assert kept.columns == d.columns
    bad = {w[0] for w in brute(ROWS, ITEMS) if w[4]}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in ROWS if d not in bad)


def test_spans_are_cut_out(docs, bench):
    got = {r.doc_id: r.text for r in deco.remove_spans(docs(*ROWS), bench).collect()}
    assert got[1] == "before after" and got[9] == "clean text" and got[4] is None and got[8] == ""


def test_empty_tables(docs, bench, spark):
    none = bench.filter(F.lit(False))
    assert deco.contamination(docs(), bench).collect() == []
    assert all(r.n_hit == 0 and not r.contaminated for r in deco.contamination(docs(*ROWS), none).collect())
    assert deco.drop_contaminated(docs(*ROWS), none).count() == len(ROWS)


def test_no_python_in_the_plan(docs, bench):
    plan = deco.contamination(docs(*ROWS), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_hits_of_equal_hashes_are_verified(docs, bench, monkeypatch):
    found = deco.text_hits

    def more(d, windows, text):  # each text also claims a window that it hasn't
        extra = F.struct(F.lit(1).alias("at"), F.lit(3).alias("len"), F.lit("not its words").alias("window"))
        claimed = d.select(*(c.alias(k) for c, k in zip(deco._text_keys(text), ("k1", "k2"), strict=True))).distinct()
        both = claimed.join(found(d, windows, text), ["k1", "k2"], "left")
        return both.select("k1", "k2", F.array_append(F.coalesce("hits", F.expr("array()")), extra).alias("hits"))

    monkeypatch.setattr(deco, "text_hits", more)
    got, want = compared(deco.contamination(docs(*ROWS), bench))
    assert got == want


def test_a_very_long_text_made_of_a_benchmark_item(docs, bench):
    (r,) = deco.contamination(docs((1, (LONG + " ") * 3000)), bench).collect()
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (60000, 60000, 2, True)


def test_a_large_benchmark_takes_one_pass(docs, spark):
    many = spark.range(2000).select(
        F.col("id").alias("item_id"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), F.col("id"), F.lit("x"), i)), " ").alias("text"),
    )
    own = " ".join(f"w77x{i}" for i in range(5, 30))
    (r,) = deco.contamination(docs((1, own)), many).collect()
    assert (r.n_words, r.n_hit, r.n_items) == (25, 25, 1)
