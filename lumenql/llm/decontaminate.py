"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

Texts are folded (A-Z to lower case) and cut into alphanumeric words. A window
is ``n`` consecutive words of a benchmark item; an item with fewer words, but
not none, is one window. The hash set is a table with a row for each window. It
is broadcast if it has at most ``SET_ROWS`` rows (two longs each); a larger one
is joined by its hashes. Document windows are exploded as (text, place, hash)
and probe it once, whatever its size; what hits is gathered for each different
text, joined back to the documents and verified there against the words, and a
document word inside a verified window is *hit*. All of it is JVM expressions.

Defined results: null and empty texts have no words, are never hit and hit
nothing; null and repeated items count as items of their own (null ids are
skipped in the list of ids); an empty benchmark hits nothing; rows that repeat
are judged one by one; extra columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM_GAP, BROADCAST_BYTES, LOWER, UPPER, free_name, materialise, small_side, table, words

N = 13
#: A document is contaminated if at least 1 / SHARE of its words are hit.
SHARE = 20
#: Rows above which the hash set is not broadcast (some 50 bytes each in memory).
SET_ROWS = 2_000_000


def item_windows(bench: DataFrame, n: int = N, text: str = "text", item: str = "item_id"):
    """Distinct windows of the benchmark: ``window`` (joined words), ``len``
    and ``items`` (ids of the items that have it)."""
    own = bench.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w"))
    own = own.filter(F.size("w") > 0).withColumn("len", F.least(F.lit(n), F.size("w")))
    each = own.select(
        "item",
        "len",
        F.explode(
            F.expr("transform(sequence(1, size(w) - len + 1), i -> array_join(slice(w, i, len), ' '))")
        ).alias("window"),
    )
    return each.groupBy("window", "len").agg(F.collect_set("item").alias("items"))


def _words(text: str) -> str:
    return f"array_remove(split(translate(coalesce(`{text}`, ''), '{UPPER}', '{LOWER}'), r'{ALNUM_GAP}'), '')"


def _bound(value: str, name: str, body: str) -> str:
    """SQL for ``body`` over ``name``, a lambda variable: its value is computed
    once for a row wherever the optimizer moves the expression."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _text_keys(text: str) -> list[Column]:
    """128 bits that name a text: hits depend on nothing else of a row."""
    own = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(own), F.xxhash64(F.lit("deco"), own)]


def _bytes(array: str, value: str) -> Column:
    return F.expr(f"aggregate({array}, 48L, (a, x) -> a + 40L + coalesce(octet_length({value}), 0))")


#: SQL over h: the number of hit words, from windows in order of their places.
_N_HIT = """aggregate(array_sort(h), named_struct('n', 0L, 'upto', 0L), (a, x) -> named_struct(
    'n', a.n + greatest(0L, x.at + x.len - greatest(cast(x.at AS long), a.upto)),
    'upto', greatest(a.upto, cast(x.at + x.len AS long)))).n"""
_BAD = f"size(h) > 0 AND {SHARE} * {_N_HIT} >= size(w)"
#: SQL over h: places of hit words.
_COVERED = "array_distinct(flatten(transform(h, x -> sequence(x.at, x.at + x.len - 1))))"


def text_hits(docs: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    """(k1, k2, hits): by text, the places (at, len) whose hash is a window's,
    with the window, as yet unverified."""
    lens = sorted(r.len for r in windows.select("len").distinct().collect())  # at most n
    v = "transform(sequence(1, size(v) - {less}), i -> xxhash64({own}))"
    hashes = [
        f"struct({n} AS len, if(size(v) < {n}, array(), "
        + v.format(less=n - 1, own=", ".join(f"get(v, i + {k - 1})" for k in range(n)))
        + ") AS hashes)"
        for n in lens
    ] or ["struct(0 AS len, array(0L) AS hashes)"]
    all_hashes = _bound(f"transform({_words(text)}, x -> xxhash64(x))", "v", f"array({', '.join(hashes)})")
    k1, k2 = _text_keys(text)
    # in a projection of its own: exploded rows carry no texts; outer: an inferred
    # filter on the array's size would compute it twice
    own = docs.select(k1.alias("k1"), k2.alias("k2"), F.expr(all_hashes).alias("own"))
    own = own.select("k1", "k2", F.explode_outer("own").alias("own"))
    places = own.select("k1", "k2", "own.len", F.posexplode_outer("own.hashes").alias("at", "hash"))
    probes = places.withColumn("at", F.col("at") + 1)
    found = probes.join(
        small_side(windows.select("hash").distinct(), SET_ROWS), "hash", "left_semi"
    )
    named = windows.select("hash", "window")
    weight = F.octet_length("window") + 48
    sure = found.join(small_side(named, BROADCAST_BYTES, weight), "hash")
    return materialise(
        sure.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "len", "window")).alias("hits")), "deco-hits"
    )


def with_hits(
    docs: DataFrame,
    bench: DataFrame,
    bodies: dict[str, str],
    n: int = N,
    text: str = "text",
    item: str = "item_id",
    others: bool = False,
) -> tuple[DataFrame, str, DataFrame]:
    """``docs`` with a struct of ``bodies`` (SQL over w, the words, and h, the
    verified hits), the struct's name, and the benchmark's windows. Documents
    without a hit have a null struct, or, with ``others``, theirs."""
    deco, k1, k2, hits = (free_name(docs, x) for x in ("deco", "deco_k1", "deco_k2", "deco_hits"))
    hashed = F.xxhash64(F.transform(F.split("window", " "), lambda x: F.xxhash64(x)))
    windows = materialise(item_windows(bench, n, text, item).withColumn("hash", hashed), "bench-windows")
    found = text_hits(docs, windows, text).toDF(k1, k2, hits)
    one, two = _text_keys(text)
    joined = docs.withColumns({k1: one, k2: two}).join(
        small_side(found, BROADCAST_BYTES, _bytes(hits, "x.window")), [k1, k2], "left"
    )
    own = f"coalesce({hits}, array())" if others else hits
    sure = f"filter({own}, x -> array_join(slice(w, x.at, x.len), ' ') = x.window)"
    body = f"named_struct({', '.join(f'{k!r}, {v}' for k, v in bodies.items())})"
    each = _bound(_words(text), "w", _bound(sure, "h", body))
    if not others:
        each = f"if({hits} IS NULL, NULL, {each})"
    return joined.withColumn(deco, F.expr(each)).drop(k1, k2, hits), deco, windows


def drop_contaminated(docs: DataFrame, bench: DataFrame, n: int = N) -> DataFrame:
    """``docs`` without its contaminated documents, columns as they were."""
    marked, deco, _ = with_hits(docs, bench, {"bad": _BAD}, n)
    return marked.filter(~F.coalesce(f"{deco}.bad", F.lit(False))).select(*docs.columns)


def remove_spans(docs: DataFrame, bench: DataFrame, n: int = N, text: str = "text") -> DataFrame:
    """``docs`` with hit words cut out of the texts (of texts with hits, the
    words that stay are joined by single spaces)."""
    kept = f"array_join(transform(array_except(sequence(1, size(w)), {_COVERED}), i -> element_at(w, i)), ' ')"
    marked, deco, _ = with_hits(docs, bench, {"kept": f"if(size(h) > 0, {kept}, NULL)"}, n, text)
    return marked.withColumn(text, F.coalesce(f"{deco}.kept", text)).select(*docs.columns)


def contamination(docs: DataFrame, bench: DataFrame, n: int = N, key: str = "doc_id") -> DataFrame:
    """For each document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = "array_distinct(transform(h, x -> x.window))"
    marked, _, windows = with_hits(
        docs.select(key, "text"),
        bench,
        {"n_words": "cast(size(w) AS long)", "n_hit": _N_HIT, "bad": _BAD, "found": found},
        n,
        others=True,
    )
    row = "deco_row"
    rows = marked.select(F.monotonically_increasing_id().alias(row), key, "deco")
    each = rows.select(
        row, key, "deco.n_words", "deco.n_hit", "deco.bad", F.explode_outer("deco.found").alias("window")
    )
    weight = _bytes("items", "x") + F.octet_length("window")
    owners = small_side(windows.select("window", "items"), BROADCAST_BYTES, weight)
    grouped = (
        each.join(owners, "window", "left")
        .groupBy(row, key, "n_words", "n_hit", "bad")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    )
    return grouped.select(
        key,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        F.col("bad").alias("contaminated"),
    )


def op7_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bs AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bi),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS x FROM bs),
ns AS (SELECT DISTINCT n FROM bi),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS x FROM ds),
h AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.x = bw.x),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
      FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       cast(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
