"""Substring dedup by sliding spans of pieces.

A text is cut into pieces after words that rank least in some window of
``PIECE_WINDOW`` words (the last of equal ones; ends of sentences rank first,
then ends of clauses, then the words' hashes). So words alone decide, those
nearer than a window, and no stretch of a window's length is without a cut: of
a passage all cuts but those in its first and last ``PIECE_WINDOW - 1`` words
are the same wherever it stands, whatever stops and lines it has. Every run of
consecutive pieces with at least ``RUN_WORDS`` words is hashed (96 bits). A
passage of 4 * PIECE_WINDOW + RUN_WORDS - 3 = 49 words or more holds a whole
run. Runs that occur more than once, in one text or in several, are found by a
global join; of each, the first occurrence (by doc id, then place) stays, and
pieces that any other occurrence covers are removed.

The join works in two steps: the first 64 bits are counted (with partial sums
before the shuffle), and only runs whose first bits repeat are joined in full.
All joins are merge joins at every size, as their sides grow with the corpus;
the one that brings removals to their texts shuffles each text once.

Defined results: null and empty texts have no pieces and stay as they are; a
text shorter than a run is never changed; rows that repeat doc id and text are
one document (all keep the same pieces); null doc ids come last in the order;
ties are ordered by place; an empty table gives an empty table; all columns
stay, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, materialise, python_batches, small_side, spread, table

RUN_WORDS = 20
#: A piece ends at least once in so many words.
PIECE_WINDOW = 8

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\f")] = True
#: What a word ends in: stops are cut after first, then commas, then others.
_ENDS = np.full(256, 2 << 32)
_ENDS[list(b",;:")] = 1 << 32
_ENDS[list(b".!?")] = 0


def _least(ranks: np.ndarray, window: int) -> np.ndarray:
    """Whether a word has the last least rank of any ``window`` words on end."""
    out = np.zeros(len(ranks), bool)
    if len(ranks) >= window:
        each = np.lib.stride_tricks.sliding_window_view(ranks[::-1], window)
        out[len(ranks) - 1 - (each.argmin(axis=1) + np.arange(len(each)))] = True
    return out


def pieces(text: bytes) -> list[tuple[int, bytes, int]]:
    """(end, normalised words, number of words) of each piece, in order."""
    low = text.lower()
    words = low.split()
    if not words:
        return []
    data = np.frombuffer(low, np.uint8)
    gap = np.concatenate(([True], _SPACE[data], [True]))
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    last = data[np.flatnonzero(~gap[:-1] & gap[1:]) - 1]
    cut = _least(np.array([*map(zlib.crc32, words)]) + _ENDS[last], PIECE_WINDOW)
    cut[-1] = True
    to = np.flatnonzero(cut) + 1
    ends = np.append(starts, len(text))[to].tolist()
    ends[-1] = len(text)
    out, at = [], 0
    for end, j in zip(ends, to.tolist(), strict=True):
        out.append((end, b" ".join(words[at:j]), j - at))
        at = j
    return out


def runs(cut: list[tuple[int, bytes, int]]) -> list[tuple[int, int]]:
    """(first piece, piece behind the last) of the shortest run from each piece."""
    found, j, words = [], 0, 0
    for i in range(len(cut)):
        while j < len(cut) and words < RUN_WORDS:
            words += cut[j][2]
            j += 1
        if words < RUN_WORDS:
            break
        found.append((i, j))
        words -= cut[i][2]
    return found


def _hashes(batches):
    import xxhash

    for b in batches:
        high, low = [], []
        for t in b.column("body").to_pylist():
            cut = pieces(t) if t else []
            texts = [c[1] for c in cut]
            own = b"".join(xxhash.xxh3_128_digest(b" ".join(texts[i:j])) for i, j in runs(cut))
            both = np.frombuffer(own, np.int64).reshape(-1, 2)
            high.append(both[:, 0])
            low.append(both[:, 1].astype(np.int32))  # its low half
        arrays = [pa.array(high, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int32()))]
        names = b.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*b.select(names).columns, *arrays], [*names, "h1", "h2"])


def row_names(key: str, text: str) -> tuple:
    """What names a row: its doc id, and a hash that tells texts apart."""
    return F.col(key).cast("long"), F.xxhash64(F.col(key), F.col(text))


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(span_doc, span_row, starts): the runs of a document that repeat an
    earlier one, by the number of their first piece."""
    python_batches(docs.sparkSession)
    doc, row = row_names(key, text)
    own = docs.select(
        doc.alias("span_doc"), row.alias("span_row"), F.col(text).cast("binary").alias("body")
    )
    own = own.mapInArrow(_hashes, "span_doc long, span_row long, h1 array<long>, h2 array<int>")
    # whole copies of a row are one document: they must not repeat themselves
    spans = materialise(own.filter(F.size("h1") > 0), "span-hashes")
    copies = materialise(
        spans.groupBy("span_doc", "span_row").count().filter("count > 1").select("span_doc", "span_row"),
        "span-copies",
    )
    if copies.limit(1).count():
        from pyspark.sql import Window

        at = Window.partitionBy("span_doc", "span_row").orderBy("span_row")
        same = (spans["span_row"] == copies["span_row"]) & spans["span_doc"].eqNullSafe(copies["span_doc"])
        side = small_side(copies)
        one = (
            spans.join(side, same, "left_semi").withColumn("nth", F.row_number().over(at)).filter("nth = 1").drop("nth")
        )
        spans = materialise(spans.join(side, same, "left_anti").unionByName(one), "span-once")
    often = materialise(
        spans.select(F.explode("h1").alias("h1")).groupBy("h1").count().filter("count > 1").select("h1"),
        "span-often",
    )
    each = spans.select("span_doc", "span_row", F.posexplode(F.arrays_zip("h1", "h2")).alias("at", "h"))
    each = each.select("span_doc", "span_row", "at", "h.h1", "h.h2")
    # merge joins at every size: these lists grow with the corpus
    some = materialise(each.join(often.hint("merge"), "h1"), "span-candidates")
    place = F.struct(F.col("span_doc").isNull().alias("missing"), "span_doc", "span_row", "at")
    first = materialise(
        some.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n"),
        "span-first",
    )
    late = some.join(first.hint("merge"), ["h1", "h2"]).filter(place != F.col("first"))
    return materialise(
        late.groupBy("span_doc", "span_row").agg(F.collect_set("at").alias("starts")), "span-removals"
    )


def remove(text: bytes, starts) -> tuple[bytes, int, int]:
    """The text without the pieces of the runs that begin at ``starts``; the
    number of its pieces, and of those removed."""
    cut = pieces(text)
    gone = np.zeros(len(cut), bool)
    spans = dict(runs(cut))
    for s in starts:
        gone[s : spans[s]] = True
    begin, kept = 0, []
    for (end, _, _), out in zip(cut, gone, strict=True):
        if not out:
            kept.append(text[begin:end])
        begin = end
    return b"".join(kept), len(cut), int(gone.sum())


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated passages removed from its texts, and with
    span_pieces and span_removed (numbers of pieces, 0 if nothing was removed)."""
    found = removals(docs, key, text)
    starts, doc, row, of_doc, of_row = (
        free_name(docs, n) for n in ("span_starts", "span_doc", "span_row", "span_of_doc", "span_of_row")
    )
    side = found.select(
        F.col("span_doc").alias(of_doc), F.col("span_row").alias(of_row), F.col("starts").alias(starts)
    )
    own = docs.drop("span_pieces", "span_removed").withColumns(
        dict(zip((doc, row), row_names(key, text), strict=True))
    )
    at = (F.col(row) == F.col(of_row)) & F.col(doc).eqNullSafe(F.col(of_doc))
    joined = own.join(side.hint("merge"), at, "left").drop(doc, row, of_doc, of_row)
    kept = [c for c in docs.columns if c not in ("span_pieces", "span_removed")]

    def cut(batches):
        for b in batches:
            texts, starts = b.column(kept.index(text)), b.column(len(kept)).to_pylist()
            n = np.zeros((b.num_rows, 2), np.int64)
            changed = [k for k, s in enumerate(starts) if s]
            columns = [b.column(i) for i in range(len(kept))]
            if changed:
                new = texts.to_pylist()
                for k in changed:
                    body, n[k, 0], n[k, 1] = remove(new[k].encode(), starts[k])
                    new[k] = body.decode()
                columns[kept.index(text)] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n[:, 0]), pa.array(n[:, 1])], [*kept, "span_pieces", "span_removed"]
            )

    from pyspark.sql import types as T

    fields = [docs.schema[c] for c in kept]
    more = [T.StructField(c, T.LongType()) for c in ("span_pieces", "span_removed")]
    return joined.mapInArrow(cut, T.StructType([*fields, *more]))


def op5_substring_dedup(spark, sf_dir):
    return without_repeats(spread(table(spark, sf_dir, "documents"))).select(
        "doc_id",
        F.col("span_pieces").alias("n_pieces_changed"),
        F.col("span_removed").alias("n_removed"),
        "text",
    )
