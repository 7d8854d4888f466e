"""Exact top-k inner-product search in norm buckets.

Vectors are dealt to tasks by their length, longest first, and cut into buckets
of ``BUCKET`` vectors of similar length. For a query with the k-th best score
so far, theta, a bucket with longest vector l needs a cosine of theta / (|q| l)
at least: the bucket's local threshold. Above 1 the bucket is skipped; a high
threshold is used coordinate by coordinate (the unit vector's coordinates at
the query's largest ones must lie in narrow ranges); a low one by length alone
(a prefix of the bucket). What is left is verified by exact integer products.

Queries travel in blocks of bounded bytes (``BLOCK_BYTES``), each against all
vectors; a task keeps k rows for each query.

Defined results: vectors that are null or hold null or non-finite components
take no part, neither as queries nor as candidates; vectors of unequal
dimension are compared as if padded with zeros; ties go to the smaller id;
null ids take no part; rows that repeat are candidates of their own (a query
leaves out all rows that have its id, and asks once for each of its rows);
scores beyond the range of a long are set to its ends; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, table

K = 5
SCALE = 256
EVERY = 50
BUCKET = 2048
BLOCK_BYTES = 32 << 20
#: From this local cosine threshold on, coordinates are used; below, lengths.
COORDINATE_FROM = 0.6
FOCUS = 4
LONG = (-(1 << 63), (1 << 63) - 1)


def whole_vectors(vectors: DataFrame, vec: str, key: str, scale: int = SCALE) -> DataFrame:
    """(id, v, norm): floored components as doubles (whole numbers), and length."""
    x = F.col(vec)
    size = lambda c: F.abs(c.cast("double") * scale)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (size(c) < float("inf")))
    own = vectors.filter(x.isNotNull() & F.col(key).isNotNull()).filter(fine)
    # floor() gives a long; a huge component is whole already
    down = F.transform(
        x,
        lambda c: F.when(F.abs(c.cast("double")) < 2.0**44, F.floor(c.cast("double") * scale).cast("double")).otherwise(
            c.cast("double") * scale
        ),
    )
    return own.select(F.col(key).cast("long").alias("id"), down.alias("v")).withColumn(
        "norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    )


def _padded(lists, dim=None) -> np.ndarray:
    dim = max([dim or 0, *(len(v) for v in lists)])
    out = np.zeros((len(lists), dim))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact products of one query with the rows of ``m``, as Python-safe longs."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * max(1, len(q))
    if top < 2**53:
        return (m @ q).astype(np.int64)  # doubles hold all partial sums exactly
    if top < 2**63:
        return m.astype(np.int64) @ q.astype(np.int64)
    qi = [int(c) for c in q]
    exact = [sum(a * int(b) for a, b in zip(qi, row, strict=True)) for row in m]
    return np.array([min(max(s, LONG[0]), LONG[1]) for s in exact], np.int64)


class _Best:
    """The k best (score, id) of one query."""

    def __init__(self, k):
        self.k, self.rows = k, []

    def theta(self) -> float:
        return float(self.rows[-1][0]) if len(self.rows) == self.k else -np.inf

    def add(self, scores, ids):
        if len(scores) > 4 * self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= cut
            scores, ids = scores[keep], ids[keep]
        if len(self.rows) == self.k:
            keep = scores >= self.rows[-1][0]
            scores, ids = scores[keep], ids[keep]
        if len(scores):
            rows = self.rows + list(zip(scores.tolist(), ids.tolist(), strict=True))
            self.rows = sorted(rows, key=lambda r: (-r[0], r[1]))[: self.k]


def _search(queries, k):
    """queries: (row number, id, vector) of a block -> function over partitions."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        qn = [q[0] for q in queries.value]
        qid = np.array([q[1] for q in queries.value], np.int64)
        qs = _padded([q[2] for q in queries.value])
        qlen = np.sqrt((qs * qs).sum(axis=1))
        best = [_Best(k) for _ in qn]
        for ids, vs, lens in _buckets(batches, qs.shape[1]):
            if vs.shape[1] > qs.shape[1]:
                qs = np.pad(qs, ((0, 0), (0, vs.shape[1] - qs.shape[1])))
            _bucket(best, qid, qs, qlen, ids, vs, lens)
        rows = [(n, q, s, i) for n, q, b in zip(qn, qid.tolist(), best, strict=True) for s, i in b.rows]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in cols], ["query_row", "query_id", "score", "vec_id"]
        )

    return run


def _buckets(batches, dim):
    """Buckets of a partition, whose rows come longest first."""
    for b in batches:
        for at in range(0, b.num_rows, BUCKET):
            part = b.slice(at, BUCKET)
            vs = _padded(part.column("v").to_pylist(), dim)
            yield part.column("id").to_numpy(), vs, part.column("norm").to_numpy()


def _bucket(best, qid, qs, qlen, ids, vs, lens):
    longest = float(lens.max(initial=0))
    if not len(ids):
        return
    theta = np.array([b.theta() for b in best])
    with np.errstate(invalid="ignore", divide="ignore"):
        local = np.where(qlen * longest > 0, theta / (qlen * longest), np.where(theta > 0, np.inf, -np.inf))
    slack = 1e-9
    unit = None
    whole = []  # queries that need most of the bucket are verified together
    for j in np.flatnonzero(~(local > 1 + slack)):
        t = local[j]
        if t >= COORDINATE_FROM:
            if unit is None:
                unit = vs / np.where(lens > 0, lens, 1)[:, None]
            q = qs[j] / qlen[j]
            own = np.ones(len(ids), bool)
            for f in np.argsort(-np.abs(q))[:FOCUS]:
                mid = q[f] * t
                half = np.sqrt(max(0.0, (1 - min(t, 1.0) ** 2) * (1 - q[f] ** 2))) + slack
                # a cosine of t or more keeps the coordinate within that angle of q's
                low = -1.0 if q[f] <= -t else mid - half
                high = 1.0 if q[f] >= t else mid + half
                own &= (unit[:, f] >= low - slack) & (unit[:, f] <= high + slack)
            at = np.flatnonzero(own)
        elif t > 0:
            at = np.arange(np.count_nonzero(lens * qlen[j] >= theta[j] * (1 - slack)))
            if 2 * len(at) > len(ids):
                whole.append(j)
                continue
        else:
            whole.append(j)
            continue
        at = at[ids[at] != qid[j]]
        if len(at):
            best[j].add(_products(qs[j], vs[at]), ids[at])
    if whole:
        _verify(best, whole, qid, qs, ids, vs)


def _verify(best, whole, qid, qs, ids, vs):
    top = float(np.abs(qs[whole]).max(initial=0)) * float(np.abs(vs).max(initial=0)) * vs.shape[1]
    for s in range(0, len(whole), 256):
        some = whole[s : s + 256]
        many = (vs @ qs[some].T).astype(np.int64).T if top < 2**53 else None
        for r, j in enumerate(some):
            scores = many[r] if many is not None else _products(qs[j], vs)
            keep = ids != qid[j]
            best[j].add(scores[keep], ids[keep])


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = K,
    scale: int = SCALE,
    vec: str = "embedding",
    key: str = "vec_id",
) -> DataFrame:
    """The ``k`` best other vectors of each query: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    own = materialise(whole_vectors(vectors, vec, key, scale), "topk-vectors")
    asked = own.filter(is_query(F.col("id")))
    size = asked.agg(F.sum(F.size("v") * 8 + 64)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    # longest first, ties by id: equal lengths spread over partitions too
    dealt = own.repartitionByRange(F.col("norm").desc(), "id").sortWithinPartitions(
        F.col("norm").desc(), "id"
    )
    found = None
    for b in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        queries = spark.sparkContext.broadcast([(n, r.id, r.v) for n, r in enumerate(mine)])
        rows = dealt.mapInArrow(
            _search(queries, k), "query_row long, query_id long, score long, vec_id long"
        ).withColumn("block", F.lit(b))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("block", "query_row").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op1_exact_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % EVERY == 0)


OP1_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
