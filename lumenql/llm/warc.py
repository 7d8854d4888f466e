"""WARC archives: writing with revisit records, and reading by boundary chains.

Writing. Pages become response records; of equal payloads only the page with
the smallest id is stored, the others are revisits that refer to it. Spark's
own text writer puts records into files, so a lost task leaves nothing behind.

Reading. Files are read in blocks (splits), cut at every ``CRLF CRLF WARC/1.``.
Each cut is only a candidate: a payload may hold the same bytes. A task emits,
for each candidate of its block, the offset at which the chain of records that
starts there leaves the block; pointer jumping from the start of each file over
these links tells which candidate of each block is truly a record. A second
pass walks every block from there. Records that cross blocks are put together
from their fragments. Payloads are not shuffled, except such fragments.

Both passes must see the same blocks. What decides on them (settings, and the
number of cores) is therefore fixed in a session of its own when the reading
begins, and a block that the first pass hasn't seen is an error.

Defined results: a null or empty payload is a payload of 0 bytes; a null url
gives no target header; a null page id is written as ``null``, read back as
null, and refers to the smallest id of its payload (all are responses where no
id is known); rows that repeat the smallest id of a payload are all responses;
an empty table gives no records; extra columns are ignored. Bytes before the
first record of a file, or behind a broken one, are skipped.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, materialise, new_folder, python_batches, small_side, table

#: The marks of the format.
VERSION = "WARC/1.1"
MAGIC = b"WARC/1."
CUT = b"\r\n\r\n" + MAGIC
URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
MIN_REVISIT_BYTES = 0


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 32 groups of 5 bits of 40 hex digits. The
    hash is bound as a lambda variable, so that it is computed once."""

    def coded(hexes: Column) -> Column:
        def group(i: Column) -> Column:
            at = F.floor(i * 5 / 4).cast("int") + 1
            twelve = F.conv(F.substring(hexes, at, F.lit(3)), 16, 10).cast("int")
            five = F.floor(twelve / F.pow(F.lit(2), 7 - (i * 5) % 4)) % 32
            return F.substring(F.lit(BASE32), five.cast("int") + 1, F.lit(1))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), group), "")

    return F.get(F.transform(F.array(F.concat(F.sha1(payload), F.lit("00"))), coded), F.lit(0))


def with_revisits(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, first): ``first`` is
    the page that a revisit refers to, null for responses."""
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumns(
        {
            "payload_bytes": F.octet_length("html").cast("long"),
            "sha": F.sha1(F.col("html").cast("binary")),
        }
    )
    shared = materialise(
        own.filter(F.col("payload_bytes") >= least)
        .groupBy("sha", F.col("payload_bytes").alias("size"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n"),
        "warc-shared",
    )
    side = small_side(shared.withColumnRenamed("sha", "key"))
    at = (F.col("sha") == F.col("key")) & (F.col("payload_bytes") == F.col("size"))
    joined = own.join(side, at, "left").drop("key", "size")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.withColumns(
        {
            "first": F.when(again, F.col("first")),
            "payload_digest": digest(F.col("html").cast("binary")),
        }
    ).drop("sha")


def write_warc(pages: DataFrame, path: str, least: int = MIN_REVISIT_BYTES) -> None:
    """Write one record for each page into files below ``path``."""
    p = with_revisits(pages, least)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    url = F.regexp_replace("url", r"[\x00-\x20]+", "%20")
    again = F.col("first").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit("\r\n"),
    )
    length = F.octet_length("http") + F.when(again, 0).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit(VERSION + "\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(
            again, F.concat(line("WARC-Refers-To", urn(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    body = F.when(again, F.lit("")).otherwise(F.col("html"))
    records = p.withColumn("http", http).select(F.concat(head, "http", body).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").text(path)


# -- reading -----------------------------------------------------------------


def header_of(chunk: bytes) -> tuple[int, dict[str, str], int] | None:
    """Length of a record's header (with its blank line), its fields, and the
    length of its block; None if the chunk doesn't begin with a header."""
    end = chunk.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = chunk[:end].decode("utf-8", "replace").split("\r\n")
    fields = {}
    for x in lines[1:]:
        name, colon, value = x.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    return (end + 4, fields, int(size)) if size.isdecimal() else None


def _chunks(batches):
    """(file, block, place in the block, bytes, *more) in order; the first chunk
    of a file has the magic in front, as the others lost theirs to the cut. The
    reader misses a cut that has line ends before it and crosses the end of a
    block, so chunks are cut again."""
    at, now = 0, None
    for b in batches:
        for f, k, whole, *more in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (f, k) != now:
                now, at = (f, k), 0
            for body in whole.split(CUT):
                yield f, k, at, body, *more
                at += len(body) + len(CUT)


def _start(block: int, at: int, body: bytes) -> tuple[int, bytes] | None:
    """Where a chunk's candidate starts, and the chunk from its magic on."""
    if block == 0 and at == 0:
        return (0, body) if body.startswith(MAGIC) else None
    return at - len(MAGIC), MAGIC + body


def _links(batches):
    """A row for each candidate: file, block, start, where its chain leaves the
    block; and one with start null and the block's length."""
    schema = pa.schema([("file", pa.string())] + [(c, pa.int64()) for c in ("block", "start", "exit")])

    def out(key, starts, nexts, length):
        to = dict(zip(starts, nexts, strict=True))
        for s in reversed(starts):  # successors lie behind and are settled first
            to[s] = to.get(to[s], to[s])
        rows = [(*key, None, length), *((*key, s, to[s]) for s in starts)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema
        )

    key, starts, nexts, length = None, [], [], 0
    for f, k, at, body in _chunks(batches):
        if (f, k) != key:
            if key:
                yield out(key, starts, nexts, length)
            key, starts, nexts = (f, k), [], []
        length = at + len(body) + len(CUT)
        if (c := _start(k, at, body)) and (h := header_of(c[1])):
            starts.append(c[0])
            nexts.append(c[0] + h[0] + h[2] + 4)
    if key:
        yield out(key, starts, nexts, length)


RECORD = "file string, offset long, headers map<string,string>, http string, payload binary"
_RECORD = pa.schema(
    [
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("headers", pa.map_(pa.string(), pa.string())),
        ("http", pa.string()),
        ("payload", pa.binary()),
    ]
)


def _record(file: str, offset: int, chunk: bytes):
    size, fields, length = header_of(chunk)
    block, http = chunk[size : size + length], None
    if fields.get("content-type", "").startswith("application/http"):
        end = block.find(b"\r\n\r\n")
        if end >= 0:
            http, block = block[:end].decode("utf-8", "replace"), block[end + 4 :]
    return file, offset, list(fields.items()), http, block


def _walk(batches, whole: bool):
    """Of blocks whose first true record is known: the records that lie in one
    block if ``whole``, else the fragments of records that cross blocks. Input:
    file, block, body, base, entry."""

    def rows():
        now, due, held, size, need, owner = None, None, [], 0, 0, 0
        for f, k, at, body, base, entry in _chunks(batches):
            if (f, k) != now:
                if held:  # the record goes on in another block
                    yield (now[0], owner, owner, True, b"".join(held))
                now, due, held = (f, k), entry, []
            if held:
                held += [CUT, body]
                size += len(CUT) + len(body)
                if size >= need:
                    yield (f, owner, None, False, b"".join(held))
                    due, held = owner - base + need + 4, []
                continue
            start = _start(k, at, body)
            if start and start[0] == due and (h := header_of(start[1])):
                need, owner = h[0] + h[2], base + due
                if len(start[1]) >= need:
                    yield (f, owner, None, False, start[1])
                    due += need + 4
                else:
                    held, size = [start[1]], len(start[1])
            elif due is None or (entry is not None and at < entry):
                # what stands before the first true record belongs to an earlier one
                yield (f, None, base + at - len(MAGIC), False, MAGIC + body)
        if held:
            yield (now[0], owner, owner, True, b"".join(held))

    for f, off, place, open_, chunk in rows():
        if (place is None) != whole:
            continue
        if whole:
            file, offset, fields, http, payload = _record(f, off, chunk)
            yield _one((file, offset, fields, http, payload, None, False))
        else:
            yield _one((f, off, [], None, chunk, place, open_))


_WALKED = pa.schema([*_RECORD, ("place", pa.int64()), ("open", pa.bool_())])


def _one(row):
    return pa.RecordBatch.from_arrays(
        [pa.array([v], t) for v, t in zip(row, _WALKED.types, strict=True)], schema=_WALKED
    )


def _batched(rows, many: int = 256, most: int = 4 << 20):
    """Batches of bounded rows and bytes from single-row batches."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += r.nbytes
        if len(held) >= many or size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _assemble(batches):
    for b in batches:
        rows = []
        for f, off, chunk in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            h = header_of(chunk)
            if h and len(chunk) >= h[0] + h[2]:
                rows.append(_record(f, off, chunk))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, _RECORD.types, strict=True)], schema=_RECORD
        )


def _fixed(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark``, in which files are always
    split as they would be now."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return own


def _raw(spark: SparkSession, path: str) -> DataFrame:
    chunks = spark.read.option("lineSep", CUT.decode()).text(path)
    return chunks.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("body"),
    )


def entries(links: DataFrame) -> DataFrame:
    """(file, block, base, entry) for every block: its first byte in the file,
    and the place in it of its first true record (null: it has none)."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialise(
        links.filter(F.col("start").isNull()).select(
            "file", "block", F.coalesce(F.sum("exit").over(before), F.lit(0)).alias("base")
        ),
        "warc-blocks",
    )
    most = blocks.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    # merge joins: these tables grow with the records, however well they compress
    placed = links.filter(F.col("start").isNotNull()).hint("merge").join(blocks, ["file", "block"])
    jump = materialise(
        placed.select(
            "file",
            "block",
            "base",
            (F.col("base") + F.col("start")).alias("at"),
            (F.col("base") + F.col("exit")).alias("to"),
        ),
        "warc-jump",
    )
    known = jump.select("file", "block", "base", "at")
    reach = blocks.select("file").distinct().withColumn("at", F.lit(0).cast("long"))
    link = jump.select("file", "at", "to")
    for _ in range(math.ceil(math.log2(max(most, 1))) + 1):
        more = reach.join(link.hint("merge"), ["file", "at"]).select("file", F.col("to").alias("at"))
        reach = materialise(reach.union(more).distinct(), "warc-reach")
        far = link.select("file", F.col("at").alias("to"), F.col("to").alias("next"))
        link = materialise(
            link.hint("merge").join(far, ["file", "to"]).select("file", "at", F.col("next").alias("to")), "warc-link"
        )
    first = known.hint("merge").join(reach, ["file", "at"]).groupBy("file", "block").agg(F.min("at").alias("at"))
    return blocks.join(first, ["file", "block"], "left").select(
        "file", "block", "base", (F.col("at") - F.col("base")).alias("entry")
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path``: file, offset, headers (lower-case names),
    http (head of an HTTP block) and payload."""
    python_batches(spark)
    fixed = _fixed(spark)
    links = materialise(
        _raw(fixed, path).mapInArrow(_links, "file string, block long, start long, exit long"), "warc-links"
    )
    known = materialise(entries(links), "warc-entries")
    n = "n"
    chunks = _raw(fixed, path).withColumn(n, F.monotonically_increasing_id())
    side = small_side(known, BROADCAST_BYTES, F.length("file") + 64)
    joined = side.join(chunks, ["file", "block"], "right")
    if side is known:  # a shuffled join loses the order
        joined = joined.repartition("file", "block").sortWithinPartitions("file", "block", n)
    lost = F.raise_error(F.concat(F.lit("a block of an archive was not seen before: "), "file", F.lit(" "), "block"))
    ready = joined.select("file", "block", "body", F.coalesce("base", lost.cast("long")).alias("base"), "entry")

    def walked(whole):
        return ready.mapInArrow(lambda batches: _batched(_walk(batches, whole)), RECORD + ", place long, open boolean")

    crossing = known.groupBy("file").count().filter("count > 1").limit(1).count()
    whole = walked(True).drop("place", "open")
    if not crossing:
        return whole
    # each fragment belongs to the last open record before it
    last = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    parts = walked(False).withColumn(
        "owner", F.last(F.when(F.col("open"), F.col("offset")), ignorenulls=True).over(last)
    )
    joined_parts = (
        parts.filter(F.col("owner").isNotNull())
        .groupBy("file", F.col("owner").alias("offset"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "payload"))).alias("p"))
        .select(
            "file",
            "offset",
            F.expr(
                "aggregate(p, X'', (a, x) -> concat(a, if(a = X'', X'', X'0D0A0D0A'), x.payload))"
            ).alias("chunk"),
        )
    )
    return whole.unionByName(joined_parts.mapInArrow(_assemble, RECORD))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    r = read_warc(spark, path)
    own = lambda name: F.regexp_extract(F.col("headers")[name], URN + r"(-?\d+)>", 1)
    number = lambda c: F.when(c != "", c).cast("long")
    kind = F.col("headers")["warc-type"]
    again = kind == "revisit"
    said = F.regexp_extract("http", r"(?i)content-length: *(\d+)", 1)
    return r.select(
        number(own("warc-record-id")).alias("page_id"),
        F.when(again, number(said)).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(again, F.regexp_replace(F.col("headers")["warc-payload-digest"], "^sha1:", ""))
        .otherwise(digest(F.col("payload")))
        .alias("payload_digest"),
        kind.alias("record_type"),
        number(own("warc-refers-to")).alias("refers_to"),
    )


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) || '00' AS h FROM pages),
d AS (
  SELECT page_id, cast(strlen(html) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           cast(((cast('0x' || substr(h, i * 5 // 4 + 1, 3) AS BIGINT) >> (7 - (i * 5) % 4)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
