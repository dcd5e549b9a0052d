"""Web archives: one gzip member per record, written in parallel and read back from any byte range."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Callable, Generator, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accessgraph.llm.common import query, shared_path, stored, table
from accessgraph.llm.token_files import _open

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
CAPTURED = "2000-01-01T00:00:00Z"
MIN_BYTES = 0
RANGE_BYTES = 1 << 23
MOST_TASKS = 1 << 15
PIECE = 1 << 14
LONGEST_HEADER = 1 << 16
BATCH_BYTES = 1 << 22
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:x-page:"

Headers = dict[str, str]


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(text: str) -> str:
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in text)


def make_record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as a gzip member of its own; headers without value are left out."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers if v is not None), b"Content-Length: %d" % len(block)]
    return gzip.compress(b"\r\n".join([*lines, b"", block, b"", b""]), compresslevel=6, mtime=0)


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, captured: str) -> bytes:
    """The response record of a page, or a revisit record where ``first`` names the page it equals."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = first is not None
    return make_record(
        [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<{PAGE}{'' if page_id is None else page_id}>"),
            ("WARC-Date", captured),
            ("WARC-Target-URI", None if url is None else _uri(url)),
            ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
            ("WARC-Profile", PROFILE if revisit else None),
            ("WARC-Refers-To", f"<{PAGE}{first}>" if revisit else None),
            ("Content-Type", "application/http;msgtype=response"),
        ],
        block if revisit else block + payload,
    )


def revisited(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, key, first) of the pages whose payload a page of a smaller id has too.

    ``key`` is the payload's SHA-256. Only ids and keys are shuffled; a payload
    that many pages share is one row on its side of the join, whose other side
    adaptive execution may split.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keys = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha2(payload, 256)).alias("key"), F.length(payload).alias("size")
    ).where(F.col("size") >= min_bytes)
    firsts = keys.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))
    pairs = keys.join(firsts.select("key", "first"), "key").where(F.col("first").isNotNull() & later)
    return pairs.select("page_id", "key", "first").distinct()


def write_archives(
    pages: DataFrame, path: str, captured: str = CAPTURED, min_bytes: int = MIN_BYTES
) -> DataFrame:
    """Write a record per page, one ``.warc.gz`` file per task; returns (file, n_records, n_bytes).

    The payload is ``html`` in UTF-8, null as an empty one. Of pages with equal
    payloads of ``min_bytes`` or more, those with the smallest ``page_id`` are
    responses and the others revisits of it; a null id is larger than any, and
    pages without id alone are all responses. A null ``url`` has no target URI;
    control characters and spaces in a URI are escaped. Repeated rows are
    written once each; other columns are ignored. Every file begins with a
    ``warcinfo`` record; an empty table leaves an empty folder or such files.

    A task writes under a name of its attempt and renames at the end, so a lost
    or repeated attempt leaves one whole file.
    """
    spark = pages.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.warc.gz"
        system, place = _open(path)
        draft = f"{place}/_draft-{context.taskAttemptId()}"
        records = written = 0
        with system.open_output_stream(draft, compression=None) as out:
            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{name}>"), ("WARC-Date", captured)]
            member = make_record([*info, ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            out.write(member)
            written += len(member)
            for batch in batches:
                for page_id, url, html, first in zip(*batch.columns, strict=True):
                    payload = (html.as_py() or "").encode()
                    member = page_record(page_id.as_py(), url.as_py(), payload, first.as_py(), captured)
                    out.write(member)
                    records, written = records + 1, written + len(member)
        system.move(draft, f"{place}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [records], "n_bytes": [written]})

    payload = F.coalesce("html", F.lit("")).cast("binary")
    narrow = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", F.unhex(F.sha2(payload, 256)).alias("key")
    )
    # Written first, so that its size is known and the pages need no shuffle where revisits are few.
    repeats = stored(revisited(pages, min_bytes), "revisits").toDF("again_id", "again", "first")
    same = (F.col("key") == F.col("again")) & F.col("page_id").eqNullSafe(F.col("again_id"))
    rows = narrow.join(repeats, same, "left").select("page_id", "url", "html", "first")
    return stored(rows.mapInArrow(write, "file string, n_records long, n_bytes long"), "archives")


def _headers(lines: bytes) -> Headers | None:
    first, *rest = lines.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        return None
    found: Headers = {}
    for line in rest:
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found if found.get("content-length", "").isdigit() else None


def _until_error(read: Callable[[int], bytes], start: int, at: int) -> bytes:
    """What the piece at ``at`` of the member at ``start`` gives before its decoding fails."""
    decoder, place, out = zlib.decompressobj(31), start, bytearray()
    while place < at:
        piece = read(place)[: at - place]
        decoder.decompress(piece)
        place += len(piece)
    try:
        for byte in read(at):
            out += decoder.decompress(bytes([byte]))
    except zlib.error:
        pass
    return bytes(out)


def member_records(read: Callable[[int], bytes], start: int) -> Generator[tuple[Headers, bytes, bool], None, int | None]:
    """Yield (headers, block, whole) of the records in the gzip member at ``start``.

    Returns where the member ends, or None if there is no member with a record
    header, or one that breaks off or fails its checksum. A record is yielded
    when the next one or the member's end is reached, so memory holds two
    records even of a member that has many.
    """
    decoder, held, at = zlib.decompressobj(31), bytearray(), start
    headers: Headers | None = None
    ready: tuple[Headers, bytes] | None = None
    broken = unlike = False
    while not (decoder.eof or broken or unlike):
        piece = read(at)
        try:
            held += decoder.decompress(piece)
        except zlib.error:
            held += _until_error(read, start, at)
            broken = True
        broken = broken or not piece
        at += len(piece)
        while held and not unlike:
            if headers is None:
                while held[:2] == b"\r\n":
                    del held[:2]
                end = held.find(b"\r\n\r\n")
                if held[:5] != b"WARC/"[: len(held)] or max(end, len(held) if end < 0 else 0) > LONGEST_HEADER:
                    unlike = True
                    break
                if end < 0:
                    break
                headers = _headers(bytes(held[:end]))
                unlike = headers is None
                del held[: end + 4]
            elif len(held) < int(headers["content-length"]):
                break
            else:
                if ready:
                    yield *ready, True
                size = int(headers["content-length"])
                ready, headers = (headers, bytes(held[:size])), None
                del held[:size]
    if ready:
        yield *ready, headers is not None or not broken
    if headers is not None:
        size = int(headers["content-length"])
        yield headers, bytes(held[:size]), not broken and len(held) >= size
    return None if broken or unlike else at - len(decoder.unused_data)


class ByteRange:
    """A range of a file in memory; what lies beyond it is read on demand."""

    def __init__(self, source, first: int, stop: int):
        self.source, self.first, self.stop = source, first, stop
        self.data = source.read_at(max(0, stop - first) + len(MAGIC) - 1, first)

    def read(self, at: int) -> bytes:
        if at - self.first < len(self.data):
            return self.data[at - self.first : at - self.first + PIECE]
        return self.source.read_at(PIECE, at)

    def candidate(self, at: int) -> int | None:
        found = self.data.find(MAGIC, at - self.first)
        return None if found < 0 or self.first + found >= self.stop else self.first + found

    def records(self) -> Iterator[tuple[int, int | None, tuple[Headers, bytes, bool] | None]]:
        """(start, None, record) of every record whose member starts in the range, then (start, end, None) per member."""
        at = self.candidate(self.first)
        while at is not None:
            decoding, any_record, end = member_records(self.read, at), False, None
            while True:
                try:
                    record = next(decoding)
                except StopIteration as done:
                    end = done.value if any_record else None
                    break
                any_record = True
                yield at, None, record
            if any_record:
                yield at, end, None
            at = self.candidate(at + 1 if end is None else end)


CHAIN = "path string, range long, lo long, hi long, begin long, first long, end long"


def member_chains(ranges: DataFrame) -> DataFrame:
    """For rows (path, range, lo, hi, begin): the first member that starts in [begin, hi), and where the last one ends."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = end = None
                if row["begin"] < row["hi"]:
                    system, name = _open(row["path"])
                    with system.open_input_file(name) as source:
                        for start, stop, _ in ByteRange(source, row["begin"], row["hi"]).records():
                            first = start if first is None else first
                            end = stop if stop is not None else end
                yield pa.RecordBatch.from_pylist(
                    [{**row, "first": first, "end": end}],
                    pa.schema([("path", pa.string())] + [(c, pa.int64()) for c in ("range", "lo", "hi", "begin", "first", "end")]),
                )

    return ranges.mapInArrow(scan, CHAIN)


def spread(ranges: DataFrame) -> DataFrame:
    """One task per range, up to ``MOST_TASKS``; by size alone these small rows would all be one task's."""
    return ranges.repartition(min(MOST_TASKS, max(1, ranges.count())))


def byte_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, range, lo, hi, begin): ranges of all archives below ``path``, each with the place its own records begin from.

    A payload may hold an archive itself, so a valid member may lie inside a
    record of the range before. Such a range is scanned again from where the
    earlier ranges' last record ends, until no range begins inside a record.
    Archives without such payloads are scanned once.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")
    last = F.floor((F.col("length") - 1) / range_bytes)
    ranges = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0), last)).alias("range"))
    lo = F.col("range") * range_bytes
    ranges = ranges.select("path", "range", lo.alias("lo"), F.least("length", lo + range_bytes).alias("hi"), lo.alias("begin"))
    chains = stored(member_chains(spread(ranges)), "chains")
    earlier = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    due = F.greatest("lo", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    while True:
        known = chains.withColumn("due", due)
        agrees = (F.col("begin") == F.col("due")) | (
            (F.col("begin") < F.col("due")) & (F.coalesce("first", "due") >= F.col("due"))
        )
        wrong = known.where(~agrees).select("path", "range", "lo", "hi", F.col("due").alias("begin"))
        if wrong.isEmpty():
            return known.select("path", "range", "lo", "hi", F.col("due").alias("begin"))
        right = known.where(agrees).drop("due")
        chains = stored(right.unionByName(member_chains(spread(wrong))), "chains")


RECORDS = (
    "path string, offset long, type string, record_id string, uri string, date string, refers_to string, "
    "stated_digest string, payload_digest string, payload_bytes long, intact boolean, payload binary"
)


def read_archives(
    spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, with_payload: bool = True
) -> DataFrame:
    """One row per record of the ``.warc.gz`` files below ``path``.

    Tasks take byte ranges, search them for gzip magic and take a place as a
    member if it decodes to a record header; the range in which a record's
    member starts owns it. ``offset`` is where that is; records that share a
    member share it. ``payload`` is the block, for HTTP messages without their
    header, and ``payload_digest`` and ``payload_bytes`` are made from it. For
    revisits, which have no payload, they are what the record states. A record
    that breaks off, fails its checksum or differs from its stated digest is
    not ``intact``. Files without any record give no rows.
    """

    def rows_of(file: str, offset: int, headers: Headers, block: bytes, whole: bool) -> dict:
        stated = headers.get("warc-payload-digest")
        http: Headers = {}
        if headers.get("content-type", "").replace(" ", "").startswith("application/http"):
            head, _, block = block.partition(b"\r\n\r\n")
            for line in head.decode("latin-1").split("\r\n")[1:]:
                name, _, value = line.partition(":")
                http.setdefault(name.strip().lower(), value.strip())
        kind = headers.get("warc-type")
        stated = stated.rpartition(":")[2] if stated and stated.lower().startswith("sha1:") else None
        if kind == "revisit":
            size = http.get("content-length", "")
            digest, size = stated, int(size) if size.isdigit() else None
        else:
            digest, size = payload_digest(block), len(block)
        return {
            "path": file,
            "offset": offset,
            "type": kind,
            "record_id": headers.get("warc-record-id"),
            "uri": headers.get("warc-target-uri"),
            "date": headers.get("warc-date"),
            "refers_to": headers.get("warc-refers-to"),
            "stated_digest": stated,
            "payload_digest": digest,
            "payload_bytes": size,
            "intact": whole and (stated is None or stated == digest),
            "payload": block if with_payload and kind != "revisit" else None,
        }

    kinds = {"offset": pa.int64(), "payload_bytes": pa.int64(), "intact": pa.bool_(), "payload": pa.binary()}
    names = [c.split()[0] for c in RECORDS.split(", ")]
    schema = pa.schema([(c, kinds.get(c, pa.string())) for c in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["begin"] >= row["hi"]:
                    continue
                system, name = _open(row["path"])
                rows, held = [], 0
                with system.open_input_file(name) as source:
                    for start, _, record in ByteRange(source, row["begin"], row["hi"]).records():
                        if record is not None:
                            rows.append(rows_of(row["path"], start, *record))
                            held += 1000 + len(record[1])
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    ranges = byte_ranges(spark, path, range_bytes).where("begin < hi").select("path", "begin", "hi")
    return spread(ranges).mapInArrow(read, RECORDS)


def page_number(uri: Column) -> Column:
    """The page id in a record id that :func:`write_archives` made; null if it has none."""
    number = F.regexp_extract(uri, f"^<{PAGE}(-?[0-9]+)>$", 1)
    return F.when(number != "", number).cast("long")


OP13_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS p, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), firsts AS (
  SELECT *, sha1(p) AS h, min(page_id) OVER (PARTITION BY p) AS first FROM payloads
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM firsts
"""


@query("op13_warc", OP13_SQL)
def op13(spark, sf):
    """Every page written to archives and read back from byte ranges."""
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf, "pages"), path)
    records = read_archives(spark, path, with_payload=False).where("type IN ('response', 'revisit')")
    return records.select(
        page_number(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        page_number(F.col("refers_to")).alias("refers_to"),
    )
