"""Fill-in-the-middle: documents cut into prefix, middle and suffix, written in training order."""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessgraph.llm.common import query, table
from accessgraph.llm.textbytes import run_hashes, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
PLAIN_PERCENT = 10
SPM_PERCENT = 20
WINDOW = 16
CHUNK_BITS = 9
LONGEST_CHUNK = 1 << 12
HASH_BLOCK = 1 << 19
CACHE_BYTES = 1 << 24
ENTRY_BYTES = 200

_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_CONTINUATION = bytes(range(0x80, 0xC0))


def chunk_borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted byte positions of the borders between chunks, ends of documents included.

    A chunk ends where the hash of the ``WINDOW`` bytes before has
    ``CHUNK_BITS`` leading zeros, so equal passages give equal chunks wherever
    they stand. A window lies in one document. Where no hash ends a chunk for
    ``LONGEST_CHUNK`` bytes, it ends there.
    """
    found = [offsets]
    for low in range(WINDOW, len(data) + 1, HASH_BLOCK):
        ends = np.arange(low, min(low + HASH_BLOCK, len(data) + 1))
        rolled = run_hashes(data[low - WINDOW : ends[-1]], ends - low, ends - low + WINDOW)
        ends = ends[rolled >> np.uint64(64 - CHUNK_BITS) == 0]
        found.append(ends[offsets[np.searchsorted(offsets, ends, "left") - 1] <= ends - WINDOW])
    borders = np.unique(np.concatenate(found))
    extra = np.maximum(np.diff(borders) - 1, 0) // LONGEST_CHUNK
    steps = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    return np.sort(np.concatenate([borders, np.repeat(borders[:-1], extra) + steps * LONGEST_CHUNK]))


class ChunkCache:
    """What is known of chunks, by their whole content, in two generations of bounded size.

    A chunk's summary is (code points that begin in it, whether it holds a
    marker). Together with its two outer bytes on each side it says all that
    joining chunks needs. What was dropped is counted again.
    """

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.held, self.hits = limit, 0, 0
        self.young: dict[bytes, tuple[int, bool]] = {}
        self.old: dict[bytes, tuple[int, bool]] = {}

    def summary(self, chunk: bytes) -> tuple[int, bool]:
        known = self.young.get(chunk)
        if known is not None:
            self.hits += 1
            return known
        known = self.old.get(chunk)
        if known is None:
            known = len(chunk.translate(None, _CONTINUATION)), any(m in chunk for m in _MARKS)
        else:
            self.hits += 1
        self.held += len(chunk) + ENTRY_BYTES
        if self.held > self.limit:
            self.old, self.young, self.held = self.young, {}, len(chunk) + ENTRY_BYTES
        self.young[chunk] = known
        return known


class Chunked:
    """A document as chunks: their running counts, and whether any marker is in it."""

    def __init__(self, text: bytes, ends: list[int], cache: ChunkCache):
        self.text, self.ends = text, ends
        counts, tail, self.marked, start = [], b"", False, 0
        for end in ends:
            chunk = text[start:end]
            count, marked = cache.summary(chunk)
            seam = tail + chunk[:2]
            self.marked = self.marked or marked or any(m in seam for m in _MARKS)
            tail = (tail + chunk[-2:])[-2:]
            counts.append(count)
            start = end
        self.running = list(accumulate(counts, initial=0))

    @property
    def length(self) -> int:
        return self.running[-1]

    def byte_at(self, point: int) -> int:
        """Where code point number ``point`` begins; the end of the text for its length."""
        if point >= self.length:
            return len(self.text)
        chunk = bisect_right(self.running, point) - 1
        start = self.ends[chunk - 1] if chunk else 0
        inside = np.frombuffer(self.text, np.uint8, self.ends[chunk] - start, start)
        return start + int(np.flatnonzero((inside & 0xC0) != 0x80)[point - self.running[chunk]])


MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document.

    Cuts are counted in code points of the whole text and drawn from the sha256
    of ``seed:doc_id``, so a rerun draws the same ones. A text that is empty,
    null or contains a marker stays ``plain``, and so do ``plain_percent`` of
    the others; ``spm`` puts the suffix first. Cuts are located by joining the
    counts of content-defined chunks; chunks that texts share are counted once
    per task while the cache holds them. A null id counts as an empty string,
    repeated rows give equal rows, an empty table none; other columns are
    ignored. No text moves between tasks.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkCache()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, end, data, offsets in slices(batch.column(1)):
                borders, whole = chunk_borders(data, offsets), data.tobytes()
                places = np.searchsorted(borders, offsets)
                rows = []
                for row in range(end - first):
                    low, high = int(offsets[row]), int(offsets[row + 1])
                    ends = (borders[places[row] + 1 : places[row + 1] + 1] - low).tolist()
                    rows.append(one(ids[first + row], Chunked(whole[low:high], ends, cache)))
                columns = zip(*rows, strict=True)
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    def one(doc_id: int | None, doc: Chunked) -> tuple:
        key = f"{seed}:{'' if doc_id is None else doc_id}".encode()
        h1, h2, h3, h4 = struct.unpack(">4I", hashlib.sha256(key).digest()[:16])
        n, text = doc.length, doc.text
        if not n or doc.marked or h3 % 100 >= 100 - plain_percent:
            return doc_id, n, "plain", None, None, text
        left, right = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = doc.byte_at(left), doc.byte_at(right)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        p, s, m = _MARKS
        if h4 % 100 < spm_percent:
            return doc_id, n, "spm", left, right - left, b"".join([s, suffix, p, prefix, m, middle])
        return doc_id, n, "psm", left, right - left, b"".join([p, prefix, s, suffix, m, middle])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, MADE)


def restored(form: Column, output: Column) -> Column:
    """The text that an output of :func:`fill_in_middle` was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


OP11_SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), draws AS (
  SELECT doc_id, t, n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c3,
         CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS c4
  FROM texts
), cut AS (
  SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c3 >= 90 THEN 'plain'
              WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM draws
), parts AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cut
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


@query("op11_fill_in_middle", OP11_SQL)
def op11(spark, sf):
    """Every document in its training form, and the text rebuilt from it."""
    made = fill_in_middle(table(spark, sf, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )
