"""Periodic runs of words, and texts with every run collapsed to its first period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessgraph.llm.common import query, table
from accessgraph.llm.textbytes import mix, slices, words

MIN_RUN = 12
LEAST_COUNT = 2
ANCHOR_BLOCK = 1 << 18


def surviving_segments(doc: np.ndarray, hashes: np.ndarray, min_run: int = MIN_RUN) -> tuple[np.ndarray, np.ndarray]:
    """(first word, length) of the stretches of one document that may hold a run.

    A run is at least two periods long, so each of its words occurs
    ``LEAST_COUNT`` times in it. A word that is rarer in its segment splits the
    segment, and counts are taken again inside the parts until none is rare.
    Equal hashes of unequal words can only keep a word too many.
    """
    at = np.arange(len(hashes))
    while True:
        opens = np.ones(len(at), bool)
        opens[1:] = (np.diff(at) != 1) | (doc[at[1:]] != doc[at[:-1]])
        segment = np.cumsum(opens) - 1
        sizes = np.bincount(segment)
        keys = hashes[at] ^ mix(segment.astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys)
        heads = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]) if len(at) else at
        counts = np.diff(np.r_[heads, len(at)])
        often = np.zeros(len(at), bool)
        often[order] = np.repeat(counts >= LEAST_COUNT, counts)
        keep = often & (sizes[segment] >= min_run)
        if keep.all():
            return at[opens], sizes
        at = at[keep]


class Extensions:
    """Longest common extensions in one word sequence, by exact names of its 2^k-grams."""

    def __init__(self, ids: np.ndarray):
        self.names = [ids]
        size = 1
        while 2 * size <= len(ids):
            last = self.names[-1]
            pairs = last[: len(last) - size] * (int(last.max()) + 1) + last[size:]
            kinds, named = np.unique(pairs, return_inverse=True)
            if len(kinds) == len(pairs):
                break
            self.names.append(named)
            size *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on; ``a`` < ``b``."""
        a, start = a.copy(), a
        b = b.copy()
        for level in range(len(self.names) - 1, -1, -1):
            name = self.names[level]
            inside = b < len(name)
            same = inside & (name[np.where(inside, a, 0)] == name[np.where(inside, b, 0)])
            a += same.astype(np.int64) << level
            b += same.astype(np.int64) << level
        return a - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` equal those before ``b``; ``a`` < ``b``."""
        a, start = a.copy(), a
        b = b.copy()
        for level in range(len(self.names) - 1, -1, -1):
            name, step = self.names[level], 1 << level
            inside = a >= step
            same = inside & (name[np.where(inside, a - step, 0)] == name[np.where(inside, b - step, 0)])
            a -= same.astype(np.int64) << level
            b -= same.astype(np.int64) << level
        return start - a


def lag_scan(ids: np.ndarray, min_run: int = MIN_RUN) -> np.ndarray:
    """Rows (start, length, period) of all runs of a word sequence, by start and period.

    A run of period q covers two neighbouring multiples of q, so lag q is
    tested at these only: n/q places, n log n over all lags. A run of a
    multiple of its smallest period has the same two ends, and the smallest
    lag is kept.
    """
    n = len(ids)
    extensions = Extensions(ids.astype(np.int64))
    found = [np.zeros((0, 3), np.int64)]
    lag = 1
    while lag <= n // 2:
        places = (n - 1) // np.arange(lag, min(n // 2, lag + ANCHOR_BLOCK) + 1)
        places = places[: max(1, int(np.searchsorted(np.cumsum(places), ANCHOR_BLOCK, "right")))]
        q = np.repeat(np.arange(lag, lag + len(places)), places)
        left = (np.arange(len(q)) - np.repeat(np.cumsum(places) - places, places)) * q
        lag += len(places)
        same = ids[left] == ids[left + q]
        q, left = q[same], left[same]
        start = left - extensions.backward(left, left + q)
        length = left + q + extensions.forward(left, left + q) - start
        run = length >= np.maximum(min_run, 2 * q)
        found.append(np.stack([start[run], length[run], q[run]], axis=1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
COLLAPSED = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def collapse_runs(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document.

    Words are what ASCII white space separates. A run is a stretch of at least
    ``min_run`` words and two periods that repeats with its smallest period and
    cannot be extended; ``runs`` has (start, length, period) by start and
    period. ``collapsed`` has the words that no run contains after its first
    period, joined by one space. A null or empty text has no words and an empty
    ``collapsed``. Repeated rows give equal rows, an empty table none; other
    columns are ignored. Nothing is shuffled.
    """

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                doc, _, hashes = words(data, offsets)
                opening = np.searchsorted(doc, np.arange(end - first))
                segments: dict[int, list[tuple[int, int]]] = {}
                for start, size in zip(*surviving_segments(doc, hashes, min_run), strict=True):
                    segments.setdefault(int(doc[start]), []).append((int(start - opening[doc[start]]), int(size)))
                whole = data.tobytes()
                n_words, runs, texts = [], [], []
                for row in range(end - first):
                    kept = whole[offsets[row] : offsets[row + 1]].split()
                    n_words.append(len(kept))
                    here = runs_of(kept, segments.get(row, ()))
                    if here:
                        drops = np.zeros(len(kept) + 1, np.int64)
                        for start, length, period in here:
                            drops[start + period] += 1
                            drops[start + length] -= 1
                        kept = [kept[i] for i in np.flatnonzero(np.cumsum(drops[:-1]) == 0)]
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in here])
                    texts.append(b" ".join(kept))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array(n_words, pa.int64()),
                        pa.array(runs, pa.list_(RUN)),
                        pa.array(texts, pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    def runs_of(tokens: list[bytes], parts) -> list[tuple[int, int, int]]:
        out = []
        for start, size in parts:
            names: dict[bytes, int] = {}
            ids = np.array([names.setdefault(w, len(names)) for w in tokens[start : start + size]], np.int64)
            found = lag_scan(ids, min_run)
            found[:, 0] += start
            out.extend(map(tuple, found.tolist()))
        return out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(collapse, COLLAPSED)


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text with a periodic tail for the tenth of the ids whose CRC-32 ends in zero, else the text."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    tokens = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(tokens)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(tokens, a + 1, p), F.ceil((n - a) / p).cast("int")))
    longer = F.concat_ws(" ", F.slice(tokens, F.lit(1), a), F.slice(tail, F.lit(1), n - a))
    return F.when((h % 10 == 0) & (n > 0), longer).otherwise(text)


@query("op12_periodic_runs")
def op12(spark, sf):
    """The periodic runs of all documents, a tenth of which get a periodic tail."""
    docs = table(spark, sf, "documents")
    found = collapse_runs(docs.withColumn("text", repeated_tail(F.col("doc_id"), F.col("text"))))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    length, period = F.col("longest")["length"], -F.col("longest")["col3"]
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest")["col2"]).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
