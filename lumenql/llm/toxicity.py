"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.
Every window of ``WINDOW`` words of a text, its own bytes and all of them, is
compressed with both; the difference of the two lengths is how much better the
toxic dictionary knows the window. What a difference is worth is calibrated:
its log-odds are read off labelled texts that no dictionary has seen, and a
logistic curve over a text's sum of them and its number of windows gives the
score, so that long texts need more evidence.

Training. Both dictionaries begin with the same part, trained by the library on
ordinary windows: letters that all texts share then cost the same under both
and don't blur the difference. Each goes on with a part of its own, trained on
the windows of its class without the words of which the common part holds
every stretch. Windows that repeat train once: copies are not evidence.

The fit reads at most ``SAMPLE`` labelled rows of each class (the first by a
hash of the id) and of these at most ``SAMPLE_WINDOWS`` windows for training; a
quarter of the rows calibrates and is not in the dictionaries. Windows are cut
and calibration texts measured on the executors.

Defined results: null and empty texts have no window, and no evidence; rows
whose label or id is null are not learned from; without labelled rows of both
classes every score is the toxic share (0 without any); a class of too few
words for the library's trainer is used as it is; rows that repeat are scored
one by one; a null id is not held out; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, python_batches, spread, table

CUTOFF = 0.5
FOLDS, HELD = 5, 0
SAMPLE = 4096
SAMPLE_WINDOWS = 49_152
#: Words in a window, and in one that trains.
WINDOW, LEARNED = 8, 32
#: Bytes of the dictionaries: the common part, and the part of each class.
COMMON, OWN = 800_000, 4096
#: The trainer's segments and the stretches that it counts, for either part.
COMMON_SEGMENT, OWN_SEGMENT = {"k": 16, "d": 6}, {"k": 24, "d": 8}
#: Differences of lengths that calibration tells apart.
LEAST, MOST = -3, 7
#: And from which on one is counted by itself.
CLEAR = 3

_GAPS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_WORDS = bytes.maketrans(_GAPS, b" " * len(_GAPS))


def windows(text: bytes | None, size: int = WINDOW) -> list[bytes]:
    words = (text or b"").lower().translate(_TO_WORDS).split()
    return [b" %b " % b" ".join(words[i : i + size]) for i in range(0, len(words), size)]


def _compressor(content: bytes):
    import zstandard as zstd

    how = zstd.ZstdCompressionParameters(
        window_log=20,
        chain_log=18,
        hash_log=18,
        search_log=4,
        min_match=5,
        target_length=64,
        strategy=zstd.STRATEGY_BTOPT,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
        format=zstd.FORMAT_ZSTD1_MAGICLESS,
    )
    known = zstd.ZstdCompressionDict(content)
    known.precompute_compress(compression_params=how)
    return zstd.ZstdCompressor(dict_data=known, compression_params=how)


class Distance:
    """Differences of lengths under two dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)

    def gains(self, text: bytes | None) -> list[int]:
        """For each window, the bytes that the toxic dictionary saves."""
        return [len(self.ordinary.compress(w)) - len(self.toxic.compress(w)) for w in windows(text)]

    def evidence(self, text: bytes | None) -> np.ndarray:
        """How many windows have each difference, from ``LEAST`` to ``MOST``."""
        return np.bincount(np.clip(np.array(self.gains(text), int), LEAST, MOST) - LEAST, minlength=MOST - LEAST + 1)


def _trained(size: int, samples: list[bytes], segment: dict) -> bytes:
    """A dictionary by the library's trainer, or of too few samples themselves."""
    import zstandard as zstd

    try:
        return zstd.train_dictionary(size, samples, **segment).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def train(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The dictionaries of the classes, from windows of each."""
    common = _trained(COMMON, ordinary, COMMON_SEGMENT)
    stretch = COMMON_SEGMENT["d"]
    held = {common[i : i + k] for k in range(3, stretch + 1) for i in range(len(common))}

    def rest(window: bytes) -> bytes:
        new = []
        for w in window.split():
            padded = b" %b " % w
            if any(padded[i : i + stretch] not in held for i in range(max(1, len(padded) - stretch + 1))):
                new.append(w)
        return b" %b " % b" ".join(new)

    own = [_trained(OWN, [r for r in map(rest, x) if r.strip()], OWN_SEGMENT) for x in (toxic, ordinary)]
    most = max(map(len, own))
    return tuple(common + bytes(most - len(o)) + o for o in own)


class Calibration:
    """From counts of differences to the probability that a text is toxic."""

    def __init__(self, counts: np.ndarray, y: np.ndarray, prior: float, ridge: float = 0.02):
        seen = [counts[y == c].sum(axis=0) + 1 for c in (0, 1)]
        self.odds = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())
        self.mean, self.scale = np.zeros(5), np.ones(5)
        x = self.terms(counts)
        self.mean[1:], self.scale[1:] = x[:, 1:].mean(axis=0), x[:, 1:].std(axis=0) + 1e-9
        x = self.terms(counts)
        share = y.mean()  # classes count by their true shares
        each = np.where(y == 1, prior / share if share else 0, (1 - prior) / (1 - share) if share < 1 else 0)
        w = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = (x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            w = w + np.linalg.solve(slope, x.T @ (each * (y - p)) - ridge * w)
        self.weights = w

    def terms(self, counts: np.ndarray) -> np.ndarray:
        n = counts.sum(axis=1)
        s = counts @ self.odds
        clear = counts[:, CLEAR - LEAST :].sum(axis=1)
        x = np.column_stack([np.ones(len(s)), s, np.sqrt(n), s / np.sqrt(n + 1), clear])
        return (x - self.mean) / self.scale

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.terms(counts) @ self.weights, -500, 500)))


def _cut(batches):
    """The training windows of texts, by class, with a hash of each."""
    import xxhash

    for b in batches:
        found = [
            (w, y, xxhash.xxh64_intdigest(w, 42) >> 1)
            for t, y in zip(b.column("body").to_pylist(), b.column("label").to_pylist(), strict=True)
            for w in windows(t, LEARNED)
        ]
        cols = list(zip(*found, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int64()), strict=True)],
            ["body", "label", "h"],
        )


def scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(doc, score) for every row of ``docs``."""
    from .quality import fold_of

    spark = docs.sparkSession
    python_batches(spark)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc"), F.col(label).cast("int").alias("label"))
    marked = marked.filter(
        F.col("label").isin(0, 1) & F.col("doc").isNotNull() & (fold_of("doc", FOLDS) != HELD)
    ).withColumn("h", F.xxhash64("doc"))
    totals = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    all_ = sum(totals.values())
    prior = totals.get(1, 0) / all_ if all_ else 0.0
    own = docs.select(F.col(key).cast("long").alias("doc"), F.col("text").cast("binary").alias("body"))
    if not (totals.get(0) and totals.get(1)):
        return own.select("doc", F.lit(prior).alias("score"))
    some = [marked.filter(F.col("label") == c).orderBy("h", "doc").limit(SAMPLE) for c in (0, 1)]
    picked = materialise(some[0].unionByName(some[1]), "toxic-sample")
    texts = materialise(own.join(F.broadcast(picked), "doc"), "toxic-texts")  # 2 SAMPLE labels at most
    part = F.pmod(F.col("h"), F.lit(4))
    cut = texts.filter(part != 0).select("body", "label").mapInArrow(_cut, "body binary, label int, h long")
    cut = materialise(cut.groupBy("body", "label").agg(F.min("h").alias("h")), "toxic-windows")
    learned = [
        [bytes(r.body) for r in cut.filter(F.col("label") == c).orderBy("h", "body").limit(SAMPLE_WINDOWS).collect()]
        for c in (1, 0)
    ]
    known = spark.sparkContext.broadcast(train(*learned))
    names = [f"n{i}" for i in range(MOST - LEAST + 1)]

    def measured(b, distance):
        return np.array([distance.evidence(t) for t in b.column("body").to_pylist()]).reshape(-1, len(names))

    def count(batches):
        distance = Distance(*known.value)
        for b in batches:
            columns = map(pa.array, measured(b, distance).T)
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["label", *names])

    checked = texts.filter(part == 0).select("label", "body")
    rows = checked.mapInArrow(count, "label int, " + ", ".join(f"{n} long" for n in names)).collect()
    counts = np.array([r[1:] for r in rows], float).reshape(-1, len(names))
    if rows:
        curve = Calibration(counts, np.array([r.label for r in rows], float), prior)
    else:
        curve = Calibration(np.zeros((2, len(names))), np.array([0.0, 1.0]), prior)

    def judge(batches):
        distance = Distance(*known.value)
        for b in batches:
            score = curve.score(measured(b, distance))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["doc", "score"])

    return own.mapInArrow(judge, "doc long, score double")


def op9_toxicity(spark, sf_dir):
    from .quality import fold_of

    found = scores(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return found.select(
        F.col("doc").alias("doc_id"),
        F.coalesce(fold_of("doc", FOLDS) == HELD, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= CUTOFF, 1).otherwise(0).cast("int").alias("predicted"),
    )
