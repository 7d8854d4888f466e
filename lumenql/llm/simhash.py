"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its
three-word shingles. Fingerprints that differ in at most ``DISTANCE`` bits are
linked; a document's component is all that links reach.

Search. Correlated bits are put into the same partition (correlations and
candidate counts are estimated on a bounded sample of distinct fingerprints,
``SAMPLE``). If the thresholds t_i of m partitions sum to DISTANCE - m + 1, any
linked pair agrees within t_i in some partition i; dynamic programming picks m
and the unequal t_i with the least estimated work (t_i = -1: not probed). A
fingerprint is filed under each partition's bits, with every choice of t_i of
them masked out; only fingerprints that share a file are compared. The sample
steers cost alone: the search is exact under any partition.

Copies have equal fingerprints and are grouped before the search. A file with
more than ``FILE_ROWS`` fingerprints is split by further bits: its members
agree on the filed bits, so of the other bits, cut into DISTANCE + 1 chunks, a
linked pair agrees on a chunk. This repeats until files are small, so no task
holds a hot file. From a file come not all its pairs but a star for each
component in it, which connects the same documents.

Defined results: null and empty texts have fingerprint zero, linked like any
other; texts of one or two words are one shingle; rows that repeat are members
like any other; a null doc_id is never the smallest unless all are null; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import free_name, materialise, python_batches, small_side, spread, table

BITS = 64
SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Distinct fingerprints at most from which bit statistics are estimated.
SAMPLE = 4096
#: Fingerprints in one file; larger files are split.
FILE_ROWS = 256
#: Work of filing one fingerprint, in compared pairs.
FILING = 30.0


def fingerprint(text: bytes | None) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - SHINGLE + 1
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        cut = slice(at, min(n, at + (1 << 16)))
        pairs = zip(starts[:n][cut].tolist(), ends[SHINGLE - 1 :][cut].tolist(), strict=True)
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in pairs])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, BITS)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprints(batches):
    for b in batches:
        fps = [fingerprint(t) for t in b.column("body").to_pylist()]
        out = np.array(fps, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [*b.select(b.schema.names[:-1]).columns, pa.array(out)], [*b.schema.names[:-1], "fp"]
        )


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, row_key, fp): ``row_key`` tells rows apart that share a doc id."""
    python_batches(docs.sparkSession)
    own = docs.select(
        F.col(key).cast("long").alias("doc"),
        F.xxhash64(F.col(key), F.col(text)).alias("row_key"),
        F.col(text).cast("binary").alias("body"),
    )
    return own.mapInArrow(_fingerprints, "doc long, row_key long, fp long")


# -- the plan of the search --------------------------------------------------


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """Bit positions in ``m`` partitions of nearly equal width, each grown from
    a bit by the bits most correlated with it."""
    if len(bits) > 1:
        with np.errstate(invalid="ignore", divide="ignore"):
            near = np.abs(np.nan_to_num(np.corrcoef(bits.T.astype(float))))
    else:
        near = np.zeros((BITS, BITS))
    np.fill_diagonal(near, 0)
    free, parts = set(range(BITS)), []
    for k in range(m):
        width = (BITS - sum(map(len, parts))) // (m - k)
        order = sorted(free)
        part = [max(order, key=lambda b: (near[b][order].sum(), -b))]
        free.discard(part[0])
        while len(part) < width:
            best = max(sorted(free), key=lambda b: (near[b][part].sum(), -b))
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def pair_shares(bits: np.ndarray, part: list[int], top: int) -> list[float]:
    """Estimated share of pairs that differ in at most t bits of ``part``, for
    t = 0..top: what is larger of the sample's share and that of independent
    bits (the sample can't show shares below one in its pairs)."""
    p = bits[:, part].mean(axis=0) if len(bits) else np.full(len(part), 0.5)
    exact = np.zeros(len(part) + 1)
    exact[0] = 1
    for d in 2 * p * (1 - p):
        exact[1:] = exact[1:] * (1 - d) + exact[:-1] * d
        exact[0] *= 1 - d
    some = bits[:1024, part].astype(np.int32)
    n = len(some)
    if n > 1:
        ones = some.sum(axis=1)
        apart = ones[:, None] + ones[None, :] - 2 * (some @ some.T)
        seen = [(np.count_nonzero(apart <= t) - n) / (n * (n - 1)) for t in range(top + 1)]
    else:
        seen = [0.0] * (top + 1)
    return [max(float(exact[: t + 1].sum()), seen[t]) for t in range(top + 1)]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 and up) that sum to ``total`` at least cost: ``costs[i][t + 1]``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, len(own) - 1):
                new = (cost + own[t + 1], [*chosen, t])
                if spent + t not in grown or new[0] < grown[spent + t][0]:
                    grown[spent + t] = new
        best = grown
    return best[total]


def plan(sample: np.ndarray, count: int) -> list[tuple[list[int], int]]:
    """(partition, threshold) for every partition that is probed."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8)).reshape(-1, BITS)[:, ::-1]
    choices = []
    for m in range(2, DISTANCE + 2):
        parts = group_bits(bits, m)
        top = DISTANCE - m + 1 + (m - 1)
        costs = []
        for part in parts:
            shares = pair_shares(bits, part, top)
            work = [
                count * comb(len(part), t) * FILING + count * count / 2 * shares[t]
                for t in range(top + 1)
            ]
            costs.append([0.0, *work])
        cost, ts = allocate(costs, DISTANCE - m + 1)
        choices.append((cost, [(p, t) for p, t in zip(parts, ts, strict=True) if t >= 0]))
    return min(choices, key=lambda c: c[0])[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks_of(chosen: list[tuple[list[int], int]]) -> list[int]:
    """The bit masks under which fingerprints are filed."""
    found = set()
    for part, t in chosen:
        for out in combinations(part, t):
            found.add(sum(1 << b for b in part if b not in out))
    return sorted(found)


def finer(mask: int) -> list[int]:
    """``mask`` with each of DISTANCE + 1 chunks of the other bits added."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    chunks = [rest[i :: DISTANCE + 1] for i in range(DISTANCE + 1)]
    return [mask | sum(1 << b for b in c) for c in chunks]


# -- the search --------------------------------------------------------------


def _stars(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect the linked fingerprints of one file."""
    fps = np.unique(fps)
    n = len(fps)
    if n < 2:
        return []
    if n == 2:
        a, b = int(fps[0]), int(fps[1])
        return [(a, b)] if (a ^ b).bit_count() <= DISTANCE else []
    edges, left = [], np.ones(n, bool)
    for i in range(n):
        if not left[i]:
            continue
        left[i] = False
        todo = [i]
        while todo:
            j = todo.pop()
            near = np.flatnonzero(left & (np.bitwise_count(fps ^ fps[j]) <= DISTANCE))
            left[near] = False
            todo.extend(near.tolist())
            edges += [(int(fps[i]), int(fps[k])) for k in near]
    return edges


def _file_edges(batches):
    """Rows come sorted by file; a file has few rows by construction."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[np.ndarray] = []
    for b in batches:
        rows = np.column_stack([b.column(i).to_numpy() for i in range(3)])
        rows = np.concatenate([*held, rows]) if held else rows
        new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        bounds = [0, *new.tolist()]
        edges = []
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            if e - s > 1:
                edges += _stars(rows[s:e, 2].view(np.uint64))
        held = [rows[bounds[-1] :]]
        if edges:
            yield _edge_batch(edges, schema)
    if held and (edges := _stars(held[0][:, 2].view(np.uint64))):
        yield _edge_batch(edges, schema)


def _edge_batch(edges, schema):
    flat = np.array(edges, np.uint64).view(np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], schema=schema)


def links(classes: DataFrame) -> DataFrame:
    """``classes`` (fp: distinct fingerprints, materialised) -> edges (a, b)
    that connect just what links connect."""
    spark = classes.sparkSession
    count = classes.count()
    few = classes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r.fp for r in few], np.int64).view(np.uint64)
    masks = masks_of(plan(sample, count))
    filed = classes.select(
        F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"), "fp"
    ).withColumn("val", F.col("fp").bitwiseAND(F.col("mask")))
    ready = []
    while True:
        big = materialise(
            filed.groupBy("mask", "val").count().filter(F.col("count") > FILE_ROWS).select("mask", "val"),
            "simhash-big",
        )
        if not (hot := [r.mask for r in big.select("mask").distinct().collect()]):
            ready.append(filed)
            break
        side = small_side(big)
        ready.append(filed.join(side, ["mask", "val"], "left_anti"))
        steps = [(m, _signed(f)) for m in hot for f in finer(m % (1 << 64)) if _signed(f) != m]
        tree = spark.createDataFrame(steps or [(0, 0)], "mask long, next long")
        filed = (
            filed.join(side, ["mask", "val"], "left_semi")
            .join(F.broadcast(tree), "mask")  # DISTANCE + 1 rows for each mask
            .select(F.col("next").alias("mask"), "fp")
            .withColumn("val", F.col("fp").bitwiseAND(F.col("mask")))
        )
    files = ready[0]
    for f in ready[1:]:
        files = files.unionByName(f)
    dealt = files.select("mask", "val", "fp").repartition("mask", "val")
    edges = dealt.sortWithinPartitions("mask", "val").mapInArrow(_file_edges, "a long, b long")
    return materialise(edges.groupBy("a", "b").count().select("a", "b"), "simhash-links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, row_key, fp, first): ``first`` is the smallest (doc, row_key) of
    the row's component, as a struct (missing, doc, row_key)."""
    fps = materialise(fingerprints(docs, key, text), "simhash-docs")
    order = F.struct(F.col("doc").isNull().alias("missing"), "doc", "row_key")
    classes = materialise(fps.groupBy("fp").agg(F.min(order).alias("own")), "simhash-classes")
    roots = components(links(classes.select("fp"))).withColumnRenamed("node", "fp")
    placed = materialise(
        classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")),
        "simhash-roots",
    )
    firsts = placed.groupBy("root").agg(F.min("own").alias("first"))
    of_fp = materialise(placed.join(firsts, "root").select("fp", "first"), "simhash-first")
    return fps.join(of_fp, "fp")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", find=near_duplicates) -> DataFrame:
    """``docs`` with one document of each component that ``find`` gives: that
    with the smallest doc id. Texts are not shuffled unless the list of those
    to go is large."""
    found = find(docs, key, text)
    mine = (F.col("doc").eqNullSafe(F.col("first.doc"))) & (F.col("row_key") == F.col("first.row_key"))
    marks = materialise(
        found.groupBy("doc", "row_key").agg(F.min(mine).alias("mine"), F.count("*").alias("n")),
        "simhash-marks",
    )
    k, doc, nth = (free_name(docs, n) for n in ("simhash_key", "simhash_doc", "simhash_nth"))
    keyed = docs.withColumn(k, F.xxhash64(F.col(key), F.col(text)))
    losers = marks.filter(~F.col("mine")).select(F.col("row_key").alias(k), F.col("doc").alias(doc))
    gone = small_side(materialise(losers, "simhash-gone"))
    at = (keyed[k] == gone[k]) & F.col(key).cast("long").eqNullSafe(F.col(doc))
    rest = keyed.join(gone, at, "left_anti")
    again = marks.filter(F.col("mine") & (F.col("n") > 1)).select(F.col("row_key").alias(k))
    again = materialise(again, "simhash-again")
    if not again.limit(1).count():
        return rest.select(*docs.columns)
    again = small_side(again)  # whole rows that repeat: one of them stays
    place = F.row_number().over(Window.partitionBy(k).orderBy(k))
    once = rest.join(again, k, "left_semi").withColumn(nth, place).filter(F.col(nth) == 1)
    return rest.join(again, k, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def op8_simhash(spark, sf_dir):
    return near_duplicates(spread(table(spark, sf_dir, "documents"))).select(
        F.col("doc").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc").alias("component_id"),
    )
