"""Archives: round trips over many range sizes, embedded archives, damage and foreign files."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accessgraph.llm import warc

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def numbered(records):
    return records.withColumns({"page": warc.page_number(F.col("record_id")), "first": warc.page_number(F.col("refers_to"))})


@pytest.mark.parametrize("range_bytes", [97, 1500, 1 << 23])
def test_round_trip_with_repeats(spark, folder, range_bytes):
    rows = [(5, "http://a/b c\r\nX: y", "same"), (3, None, "same"), (9, "u", "same"), (4, "u", None), (8, "é", ""), (None, "u", "same")]
    rows += [(20 + i, f"http://h/{i}", f"<p>é🙂 {i}</p>" * (i * 7)) for i in range(1, 40)] + [(21, "http://h/1", "again"), (60, "", "big " * 90_000)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("first", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3)
    manifest = warc.write_archives(pages, f"{folder}/w")
    assert manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    read = numbered(warc.read_archives(spark, f"{folder}/w", range_bytes)).collect()
    assert all(r.intact for r in read)
    assert sum(r.type == "warcinfo" for r in read) == manifest.count()
    got = sorted((str(r.page), r.type, r.first, r.payload_bytes, r.payload_digest) for r in read if r.type != "warcinfo")
    want = []
    for page, _, html in rows:
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        again = page is None or page > min(same)
        want.append((str(page), "revisit" if again else "response", min(same) if again else None, len((html or "").encode()), sha(html)))
    assert got == sorted(want)
    payloads = sorted((str(r.page), r.payload.decode()) for r in read if r.type == "response")
    assert payloads == sorted((w[0], h or "") for w, (_, _, h) in zip(want, rows, strict=True) if w[1] == "response")
    assert {r.uri for r in read if r.page == 5} == {"http://a/b%20c%0D%0AX:%20y"}


def test_short_payloads_are_no_revisits(spark, folder):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], PAGES)
    warc.write_archives(pages, f"{folder}/w", min_bytes=3)
    read = numbered(warc.read_archives(spark, f"{folder}/w")).where("page IS NOT NULL").collect()
    assert {r.page: r.type for r in read} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_table(spark, folder):
    warc.write_archives(spark.createDataFrame([], PAGES), f"{folder}/w")
    assert warc.read_archives(spark, f"{folder}/w").where("type <> 'warcinfo'").count() == 0
    (__import__("pathlib").Path(folder) / "none").mkdir()
    assert warc.read_archives(spark, f"{folder}/none").count() == 0


def stored_member(data: bytes) -> bytes:
    """A gzip member that holds its bytes as they are, so that archives inside it keep their magic."""
    return gzip.compress(data, compresslevel=0, mtime=0)


def record(number: int, block: bytes) -> bytes:
    head = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x-page:%d>\r\nContent-Length: %d\r\n\r\n"
    return head % (number, len(block)) + block + b"\r\n\r\n"


@pytest.mark.parametrize("range_bytes", [50, 333, 1000, 5000])
def test_archives_inside_payloads_are_not_records(spark, folder, range_bytes):
    inner = b"".join(gzip.compress(record(100 + i, b"inner %d" % i), mtime=0) for i in range(40))
    twice = stored_member(record(300, inner)) + gzip.compress(record(301, b"x"), mtime=0)
    parts = [gzip.compress(record(1, b"first"), mtime=0), stored_member(record(2, inner)), stored_member(record(3, twice)),
             gzip.compress(record(4, b"last"), mtime=0)]
    with open(f"{folder}/a.warc.gz", "wb") as out:
        out.write(b"".join(parts))
    read = numbered(warc.read_archives(spark, folder, range_bytes)).orderBy("offset").collect()
    assert [r.page for r in read] == [1, 2, 3, 4] and all(r.intact for r in read)
    assert [r.payload for r in read] == [b"first", inner, twice, b"last"]


@pytest.mark.parametrize("range_bytes", [40, 1 << 20])
def test_damage_many_records_in_a_member_and_junk(spark, folder, range_bytes):
    good = gzip.compress(record(1, b"one"), mtime=0)
    many = gzip.compress(record(2, b"two") + record(3, b"") + record(4, b"four"), mtime=0)
    flipped = bytearray(stored_member(record(5, b"damaged here")))
    flipped[flipped.index(b"damaged")] ^= 1
    cut = gzip.compress(record(7, b"cut off " * 9), mtime=0)[:-20]
    with open(f"{folder}/a.warc.gz", "wb") as out:
        out.write(good + many + bytes(flipped) + b"junk\x1f\x8b\x08junk" + gzip.compress(b"no archive", mtime=0) + good + cut)
    read = numbered(warc.read_archives(spark, folder, range_bytes)).orderBy("offset", "page").collect()
    assert [(r.page, r.intact) for r in read][:6] == [(1, True), (2, True), (3, True), (4, True), (5, False), (1, True)]
    assert all(not r.intact and r.page == 7 for r in read[6:])


def test_pages_of_the_smallest_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    rows = warc.op13(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in rows) == sorted((i, len(h.encode()), sha(h)) for i, h in pages.items())
