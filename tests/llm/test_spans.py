import random

from lumenql.llm import spans


def brute(rows):
    """(new text, pieces removed) by going over all documents in order."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            out[d] = (None, 0)
            continue
        body = t.encode()
        cut, gone = spans.pieces(body), set()
        for i, j in spans.runs(cut):
            k = b" ".join(c[1] for c in cut[i:j])
            if k in seen:
                gone.add(i)
            seen.add(k)
        new, _, n = spans.remove(body, gone) if gone else (body, 0, 0)
        out[d] = (new.decode(), n)
    return out


def prose(r, words):
    out = []
    while len(out) < words:
        n = r.choice([1, 2, 5, 8, 12, 30])
        s = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n)]
        out += s[:-1] + [s[-1] + r.choice([".", "!", "?", ".\n", ","])]
    return " ".join(out)


def run(df):
    return {r.doc_id: (r.text, r.span_removed) for r in spans.without_repeats(df).collect()}


def test_equals_brute_force_and_catches_long_passages(docs):
    r = random.Random(2)
    common = [prose(r, 70) for _ in range(3)]
    rows = []
    for i in range(60):
        parts = [prose(r, r.choice([5, 40, 200])) for _ in range(2)]
        if i % 3:
            parts.insert(1, common[i % 7 % 3])
        rows.append((i, "\n".join(parts)))
    got = run(docs(*rows))
    assert got == brute(rows)
    clean = [i for i, _ in rows if i % 3 == 0]
    assert all(got[i] == (dict(rows)[i], 0) for i in clean)
    for p in common:
        w = p.split()
        middle = " ".join(w[30:40])
        flat = lambda t: " ".join(t.split())
        assert sum(middle in flat(t) for _, t in rows) > 5
        assert sum(middle in flat(t) for t, _ in got.values()) == 1  # the first keeps it


def test_pieces_cover_the_text_and_don_t_depend_on_what_is_before():
    r = random.Random(4)
    t = prose(r, 400).encode()
    cut = spans.pieces(t)
    assert cut[-1][0] == len(t) and sum(c[2] for c in cut) == len(t.split())
    later = spans.pieces(prose(r, 50).encode() + b"\n" + t)
    assert [c[1] for c in later[-(len(cut) - 2) :]] == [c[1] for c in cut[2:]]
    assert spans.pieces(b"") == [] and spans.pieces(b" \n ") == []


def test_nulls_empty_texts_repeats_in_one_text_and_clashing_names(docs):
    r = random.Random(8)
    p = prose(r, 90)
    rows = [(1, None), (2, ""), (3, p + "\n" + p), (4, "short."), (None, p)]
    got = run(docs(*rows))
    assert got == brute(rows)
    assert got[3][1] > 0 and got[None][1] > 0
    d = docs((1, p, 7, "s"), (2, p, 8, "t"), extra=", span_removed int, starts string")
    assert [(x.doc_id, x.starts) for x in spans.without_repeats(d).orderBy("doc_id").collect()] == [(1, "s"), (2, "t")]


def test_rows_that_repeat_are_one_document(docs):
    p = prose(random.Random(9), 90)
    got = spans.without_repeats(docs((1, p), (1, p), (2, p))).orderBy("doc_id").collect()
    assert [r.text == p for r in got] == [True, True, False]


def test_long_lines_and_one_very_common_passage(docs):
    r = random.Random(1)
    p = prose(r, 80)
    rows = [(i, p + " " + prose(r, 30)) for i in range(150)] + [(200, "word " * 30000)]
    assert run(docs(*rows)) == brute(rows)


def test_empty_table(docs):
    assert spans.without_repeats(docs()).collect() == []


def test_shuffled_paths_give_the_same(docs, monkeypatch):
    r = random.Random(12)
    p = prose(r, 80)
    rows = [(i, p + " " + prose(r, 60)) for i in range(20)]
    want = brute(rows)
    import lumenql.llm.spans as s

    monkeypatch.setattr(s, "small_side", lambda df, *a: df)
    assert run(docs(*rows)) == want


def test_query_equals_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.op5_substring_dedup(spark, data).collect()}
    assert got == brute(rows)


def holds_a_run(passage, *hosts):
    """Whether the hosts (text before, text behind) share a run inside the passage."""
    found = []
    for before, behind in hosts:
        text = " ".join(x for x in (before, passage, behind) if x).encode()
        cut = spans.pieces(text)
        found.append({b" ".join(c[1] for c in cut[i:j]) for i, j in spans.runs(cut)})
    inside = " " + " ".join(passage.lower().split()) + " "
    return any(f" {x.decode()} " in inside for x in set.intersection(*found))


def short_lines(r, words, last):
    out = []
    while len(out) < words:
        out += ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(r.randint(0, 2))] + [last + "\n"]
    return " ".join(" ".join(out).split(" ")[:words])


def test_lists_of_short_lines_with_one_closing_word(docs):
    r = random.Random(31)
    for last in ("no", "ok", "none", "usd", "yes", "of.", "x."):
        for n in range(51, 81):
            hosts = [(short_lines(r, r.randint(0, 40), last), short_lines(r, r.randint(0, 40), last)) for _ in range(2)]
            assert holds_a_run(short_lines(r, n, last), *hosts), (last, n)
    assert holds_a_run("of. " * 126, *[(prose(r, 60), prose(r, 60)) for _ in range(2)])
    p = short_lines(r, 60, "usd")
    rows = [(i, "\n".join([short_lines(r, 30, "usd"), p, short_lines(r, 30, "usd")])) for i in range(3)]
    got = run(docs(*rows))
    assert [got[i][1] > 0 for i in range(3)] == [False, True, True]


def sentences(r, words, least, most):
    out = []
    while len(out) < words + most:
        s = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(r.randint(least, most))]
        out += s[:-1] + [s[-1] + "."]
    at = r.randint(0, most - 1) if most < words else 0
    return " ".join(out[at : at + words])


def test_passages_of_51_words_pasted_inside_a_sentence(docs):
    r = random.Random(33)
    for least, most in ((12, 16), (17, 30), (1, 40), (500, 500)):
        for n in [*range(49, 56)] * 12:
            hosts = [[sentences(r, r.randint(1, 40), least, most) for _ in "ab"] for _ in range(2)]
            assert holds_a_run(sentences(r, n, least, most), *hosts), (least, most, n)
    p = sentences(r, 51, 500, 500)
    rows = [(i, " ".join([prose(r, 43), p, prose(r, 37)])) for i in range(40)]
    got = run(docs(*rows))
    assert got == brute(rows) and all(got[i][1] > 0 for i in range(1, 40))
