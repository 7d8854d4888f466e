import base64
import hashlib
import random

import pytest

from lumenql.llm import warc


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha string")


NASTY = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n\r\n"


def back(spark, tmp_path, rows, name="w", **kw):
    path = f"file://{tmp_path}/{name}"
    warc.write_warc(pages(spark, rows), path, **kw)
    return warc.read_warc(spark, path)


def check(records, rows):
    got = sorted((r.headers["warc-record-id"], bytes(r.payload).decode()) for r in records.collect())
    smallest = {}
    for i, _, h, _ in rows:
        if i is not None:
            smallest[h or ""] = min(i, smallest.get(h or "", i))
    want = []
    for i, _, h, _ in rows:
        first = smallest.get(h or "")
        want.append((f"<urn:page:{'null' if i is None else i}>", (h or "") if first is None or i == first else ""))
    assert got == sorted(want)


@pytest.mark.parametrize("block", ["128m", "3000", "700"])
def test_round_trip_with_magic_in_payloads(spark, tmp_path, block):
    r = random.Random(3)
    rows = []
    for i in range(120):
        html = "".join(r.choice([NASTY, "\r\n\r\n", "WARC/1.", "text ", "é" * 40, "\n"]) for _ in range(r.choice([0, 1, 3, 60])))
        rows.append((i, f"http://a/{i} \r\nx" if i % 5 else None, html if i % 7 else None, "s"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        check(back(spark, tmp_path, rows), rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_shuffled_blocks_give_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "small_side", lambda df, *a: df)
    rows = [(i, "u", NASTY * (i % 9), "s") for i in range(60)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        check(back(spark, tmp_path, rows), rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_headers_digests_and_revisits(spark, tmp_path):
    rows = [(5, "http://a/", "same", "s"), (3, "http://b/", "same", "s"), (9, None, "other é", "s"), (None, "u", "same", "s"), (4, "u", "", "s"), (6, "u", None, "s")]
    got = {r.headers["warc-record-id"]: r for r in back(spark, tmp_path, rows).collect()}
    at = lambda i: got[f"<urn:page:{i}>"].headers
    assert at(3)["warc-type"] == "response" and at(3)["warc-target-uri"] == "http://b/"
    assert at(5)["warc-type"] == at("null")["warc-type"] == "revisit"
    assert at(5)["warc-refers-to"] == at("null")["warc-refers-to"] == "<urn:page:3>"
    assert at(6)["warc-refers-to"] == "<urn:page:4>" and at(4)["warc-type"] == "response"
    assert at(9)["warc-payload-digest"] == "sha1:" + sha("other é")
    assert "warc-target-uri" not in at(9)
    assert [got[f"<urn:page:{i}>"].offset for i in (3,)] is not None


def test_small_payloads_can_be_left_out_of_revisits(spark, tmp_path):
    rows = [(1, "u", "ab", "s"), (2, "u", "ab", "s"), (3, "u", "abcdef", "s"), (4, "u", "abcdef", "s")]
    got = back(spark, tmp_path, rows, least=4).collect()
    assert sorted((r.headers["warc-record-id"], r.headers["warc-type"]) for r in got) == [
        ("<urn:page:1>", "response"), ("<urn:page:2>", "response"), ("<urn:page:3>", "response"), ("<urn:page:4>", "revisit")
    ]


def test_repeated_rows_and_empty_tables(spark, tmp_path):
    rows = [(1, "u", "a", "s"), (1, "u", "a", "s"), (2, "u", "a", "s")]
    kinds = sorted(r.headers["warc-type"] for r in back(spark, tmp_path, rows).collect())
    assert kinds == ["response", "response", "revisit"]
    assert back(spark, tmp_path, [], "none").collect() == []


def test_other_archives(spark, tmp_path):
    record = lambda body: b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.warc").write_bytes(record(b"\xff\x00one") + record(NASTY.encode()) + record(b""))
    (tmp_path / "x/b.warc").write_bytes(record(b"two") + b"WARC/1.0\r\nbroken\r\n\r\n" + record(b"lost"))
    got = [(r.file[-6:], bytes(r.payload)) for r in warc.read_warc(spark, f"file://{tmp_path}/x").collect()]
    assert sorted(got) == [("a.warc", b""), ("a.warc", NASTY.encode()), ("a.warc", b"\xff\x00one"), ("b.warc", b"two")]


def test_splits_stay_as_they_were_when_reading_began(spark, tmp_path):
    rows = [(i, "u", f"{i} " + NASTY * (i % 9), "s") for i in range(400)]
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        records = back(spark, tmp_path, rows)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1100")
        check(records, rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_block_that_was_not_seen_is_an_error(spark, tmp_path, monkeypatch):
    plain = warc.entries
    monkeypatch.setattr(warc, "entries", lambda links: plain(links).filter("block = 0"))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        with pytest.raises(Exception, match="not seen before"):
            back(spark, tmp_path, [(i, "u", "text " * i, "s") for i in range(100)]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_long_payloads(spark, tmp_path):
    rows = [(1, "u", "é\r\n\r\nWARC/1.1\r\n" * 200_000, "s"), (2, "u", "", "s"), (3, "u", "x" * 3_000_000, "s")]
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        check(back(spark, tmp_path, rows), rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
