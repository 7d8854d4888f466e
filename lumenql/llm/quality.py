"""Quality classifier: a regularised quadratic discriminant.

Every whole text becomes a vector of transformed statistics (logs, logits of
shares). Each class of the labelled rows gives a mean and a covariance; a
covariance is shrunk towards the pooled one and that towards its diagonal. A
score is the logistic of the (tempered) difference of the classes' log
densities, whose Mahalanobis terms use Cholesky factors that are computed once.

Sums for the fit are gathered from all labelled rows of the training folds, by
class and entry, so the driver sees a few hundred numbers at any size.

Defined results: null and empty texts have statistics of their own and are
scored like any other; rows whose label is null, or of whose id is null, are
not learned from; labels for one document that repeat count once each; without
rows of either class every score is that class's share (0.5 with no labels);
rows that repeat are scored one by one; extra columns stay in ``keep_good``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, materialise, python_batches, small_side, table

CUTOFF = 0.7
FOLDS, HELD = 4, 2
#: Shrinkage of class covariances to the pooled one, and of that to its diagonal.
TO_POOLED, TO_DIAGONAL = 0.3, 0.1
#: Log-density differences are divided by this: statistics aren't quite normal.
TEMPER = 2.0
FEATURES = (
    "chars words word_length letters digits upper marks rare_marks spaces lines "
    "line_length distinct_words repeated_lines ends"
).split()

# Byte classes.
_CLASS = np.zeros(256, np.uint8)
_LETTER, _DIGIT, _UPPER, _MARK, _RARE, _SPACE = range(1, 7)
for _b in range(256):
    _c = chr(_b)
    if _b >= 0x80 or "a" <= _c <= "z":
        _CLASS[_b] = _LETTER
    elif "A" <= _c <= "Z":
        _CLASS[_b] = _UPPER
    elif "0" <= _c <= "9":
        _CLASS[_b] = _DIGIT
    elif _c in " \t\n\r\x0b\x0c":
        _CLASS[_b] = _SPACE
    elif _c in ".,;:'\"()-":
        _CLASS[_b] = _MARK
    else:
        _CLASS[_b] = _RARE


def _logit(part: float, whole: float) -> float:
    return math.log((part + 0.5) / (whole - part + 0.5))


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of a UTF-8 text, in the order of FEATURES."""
    t = text or b""
    n = len(t)
    by = np.bincount(_CLASS[np.frombuffer(t, np.uint8)], minlength=7) if n else np.zeros(7)
    words = t.split()
    lines = [x for x in t.split(b"\n") if x.strip()]
    w, k = len(words), len(lines)
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines)
    letters = by[_LETTER] + by[_UPPER]
    # shares are taken of at most 400 units, so that long texts don't run away
    part = lambda a, b: _logit(min(b, 400.0) * (a / b if b else 0.0), min(b, 400.0))
    return [
        math.log1p(n),
        math.log1p(w),
        math.log1p(n / w if w else 0),
        part(letters, n),
        part(by[_DIGIT], n),
        part(by[_UPPER], letters),
        part(by[_MARK], n),
        part(by[_RARE], n),
        part(by[_SPACE], n),
        math.log1p(k),
        math.log1p(w / k if k else 0),
        part(len(set(words)), w),
        part(k - len(set(lines)), k),
        part(ends, k),
    ]


def _with_statistics(batches):
    for b in batches:
        rows = [statistics(t) for t in b.column("quality_body").to_pylist()]
        stats = pa.array(rows, pa.list_(pa.float64()))
        names = b.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*b.select(names).columns, stats], [*names, "stats"])


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    python_batches(docs.sparkSession)
    own = docs.select(
        F.col(key).cast("long").alias("doc"), F.col(text).cast("binary").alias("quality_body")
    )
    return own.mapInArrow(_with_statistics, "doc long, stats array<double>")


def fold_of(key: str, folds: int):
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


class Discriminant:
    """Two Gaussians; ``score`` gives the odds of class 1 as a probability."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        n = {c: sums[c][0] if c in sums else 0.0 for c in (0, 1)}
        self.parts = None
        total = n[0] + n[1]
        self.share = n[1] / total if total else 0.5
        if not (n[0] and n[1]):
            return
        mean = {c: sums[c][1] / n[c] for c in (0, 1)}
        cov = {c: sums[c][2] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)}
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / total
        flat = np.diag(np.diag(pooled)) + np.eye(len(pooled)) * 1e-3
        pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * flat + np.eye(len(pooled)) * 1e-4
        self.parts = {}
        for c in (0, 1):
            trust = n[c] / (n[c] + 5 * len(pooled))  # few rows: nearer the pooled one
            own = (1 - TO_POOLED) * trust
            factor = np.linalg.cholesky(own * cov[c] + (1 - own) * pooled)
            inverse = np.linalg.inv(factor)
            self.parts[c] = (mean[c], inverse, -np.log(np.diag(factor)).sum() + math.log(n[c] / total))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.share)
        density = []
        for c in (0, 1):
            mean, inverse, base = self.parts[c]
            z = (x - mean) @ inverse.T
            density.append(base - 0.5 * (z * z).sum(axis=1))
        gap = np.clip((density[1] - density[0]) / TEMPER, -500, 500)
        return 1 / (1 + np.exp(-gap))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """From all labelled rows outside the held fold: sums of 1, x and x x'."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc"), F.col(label).alias("label"))
    known = known.filter(
        F.col("label").isin(0, 1) & F.col("doc").isNotNull() & (fold_of("doc", FOLDS) != HELD)
    )

    def moments(batches):
        held = {}
        for b in batches:
            x = np.array(b.column("stats").to_pylist(), float).reshape(b.num_rows, -1)
            y = b.column("label").to_numpy()
            for c in (0, 1):
                own = x[y == c]
                if len(own):
                    one = np.column_stack([np.ones(len(own)), own])
                    held[c] = held.get(c, 0) + one.T @ one
        rows = [(c, i, float(v)) for c, m in held.items() for i, v in enumerate(m.ravel())]
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64())],
            ["label", "at", "value"],
        )

    rows = (
        stats.join(known, "doc")
        .select("stats", F.col("label").cast("int").alias("label"))
        .mapInArrow(moments, "label int, at int, value double")
        .groupBy("label", "at")
        .agg(F.sum("value").alias("value"))
        .collect()  # at most 2 (d + 1)^2 rows
    )
    d = len(FEATURES) + 1
    sums = {}
    for c in {r.label for r in rows}:
        m = np.zeros(d * d)
        for r in rows:
            if r.label == c:
                m[r.at] = r.value
        m = m.reshape(d, d)
        sums[c] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return Discriminant(sums)


def _scorer(model: Discriminant):
    def run(batches):
        for b in batches:
            x = np.array(b.column("stats").to_pylist(), float).reshape(b.num_rows, len(FEATURES))
            names = b.schema.names[:-1]
            yield pa.RecordBatch.from_arrays(
                [*b.select(names).columns, pa.array(model.score(x))], [*names, "score"]
            )

    return run


def scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc, score) for every row of ``docs``."""
    stats = materialise(document_statistics(docs, key), "quality-stats")
    model = fit(stats, labels)
    return stats.mapInArrow(_scorer(model), "doc long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", cutoff: float = CUTOFF):
    """``docs`` without the documents that score below ``cutoff``; texts go
    through the scorer in place and are never shuffled."""
    of_doc = free_name(docs, "quality_doc")
    named = labels.select(F.col("doc_id").cast("long").alias(of_doc)).distinct()
    side = small_side(materialise(named, "quality-labels"))
    known = docs.join(side, F.col(key).cast("long") == F.col(of_doc), "left_semi")
    model = fit(document_statistics(known, key), labels)  # which reads labelled texts alone
    body = free_name(docs, "quality_body")

    def judge(batches):
        for b in batches:
            rows = [statistics(t) for t in b.column(body).to_pylist()]
            x = np.array(rows, float).reshape(b.num_rows, len(FEATURES))
            keep = pa.array(model.score(x) >= cutoff)
            yield b.filter(keep).drop_columns([body])

    return docs.withColumn(body, F.col("text").cast("binary")).mapInArrow(judge, docs.schema)


def op2_quality(spark, sf_dir):
    found = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        F.col("doc").alias("doc_id"),
        F.coalesce(fold_of("doc", FOLDS) == HELD, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= CUTOFF, 1).otherwise(0).cast("int").alias("predicted"),
    )
