"""Benchmark passages in documents: fingerprints of item-sized windows, then exact similarity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessgraph.llm import textbytes as tb
from accessgraph.llm.common import fresh, query, table
from accessgraph.llm.near_dup import cells_of, weighted_cells

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BITS = 64
BLOCKS = 8
# Fingerprints sum over cells of (shingle, n-th occurrence), all of weight one,
# so a weighted similarity of 0.8 is a cosine of at least 0.889, an expected
# distance of 9.7 of 64 bits with a deviation of 2.9; the radius leaves 4.6
# deviations. Eight blocks of eight bits within two bits each cover it.
RADIUS = 23
BLOCK_RADIUS = RADIUS // BLOCKS
ITEM_BYTES = 1 << 23

MATCH = "doc_id long, item_id long, first_word long, n_words long, distance int, similarity double"


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """One 64-bit SimHash per row of signed bit sums; a sum of zero gives 0."""
    return np.packbits(sums > 0, axis=1).view(">u8").astype(np.uint64).ravel()


def bit_signs(hashes: np.ndarray) -> np.ndarray:
    """Rows of 64 values +1 or -1, one per bit of each hash."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


class WindowSums:
    """Bit sums over the cells of every window of one document.

    Sliding a window by one takes the highest cell of the shingle that leaves
    and adds the next cell of the one that enters. Both are cell 0 except at
    repeats inside the window, so one running sum over cells 0 serves all
    spans, and each span adds what its repeats change.
    """

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.sums = np.zeros((len(hashes) + 1, BITS), np.int32)
        self.signs = bit_signs(cells_of(hashes, np.zeros(len(hashes), np.int64)))
        np.cumsum(self.signs, axis=0, out=self.sums[1:])
        self.order = np.argsort(hashes, kind="stable")
        ordered = hashes[self.order]
        self.group = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        self.repeats = bool(len(hashes)) and int(self.group[-1]) + 1 < len(hashes)

    def _change(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of cells above 0, running sums of their signs less those of cell 0)."""
        at = np.flatnonzero(level)
        change = np.zeros((len(at) + 1, BITS), np.int32)
        np.cumsum(bit_signs(cells_of(self.hashes[at], level[at])) - self.signs[at], axis=0, out=change[1:])
        return at, change

    def over(self, starts: np.ndarray, span: int) -> np.ndarray:
        """The sums of the windows of ``span`` shingles from ``starts``."""
        sums = self.sums[starts + span] - self.sums[starts]
        if self.repeats:
            n = len(self.hashes)
            # Places of the same shingle are neighbours, and gaps between shingles exceed every span.
            place = self.group * (2 * n + 1) + self.order
            index = np.arange(n)
            entering, leaving = np.empty(n, np.int64), np.empty(n, np.int64)
            entering[self.order] = index - np.searchsorted(place, place - span + 1, "left")
            leaving[self.order] = np.searchsorted(place, place + span - 1, "right") - 1 - index
            at, change = self._change(entering)
            sums += change[np.searchsorted(at, starts + span)]
            at, change = self._change(leaving)
            sums -= change[np.searchsorted(at, starts)]
        return sums


@dataclass
class Item:
    item_id: int | None
    words: int
    shingles: np.ndarray
    counts: np.ndarray
    fingerprint: np.uint64


class SizeIndex:
    """Items of one word count: their shingles, and bit blocks that list the items near each value."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.fingerprints = np.array([i.fingerprint for i in items], np.uint64)
        values = np.arange(256, dtype=np.uint8)
        parts = self.fingerprints.astype(">u8").view(np.uint8).reshape(-1, BLOCKS)
        near = np.bitwise_count(parts[:, :, None] ^ values) <= BLOCK_RADIUS
        self.tables = [np.packbits(near[:, b, :].T, axis=1) for b in range(BLOCKS)]

    def within_radius(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all fingerprint pairs at most ``RADIUS`` bits apart.

        Such a pair has a block of at most ``RADIUS // BLOCKS`` differing bits,
        so looking every block up finds all of them.
        """
        parts = windows.astype(">u8").view(np.uint8).reshape(-1, BLOCKS)
        found = self.tables[0][parts[:, 0]]
        for b in range(1, BLOCKS):
            found = found | self.tables[b][parts[:, b]]
        window, item = np.nonzero(np.unpackbits(found, axis=1, count=len(self.items)))
        near = np.bitwise_count(windows[window] ^ self.fingerprints[item]) <= RADIUS
        return window[near], item[near]


class BenchmarkIndex:
    """All items of one bounded block, by shingle size and word count."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.sizes: dict[int, dict[int, SizeIndex]] = {}
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        grouped: dict[tuple[int, int], list[Item]] = {}
        for item_id, text in rows:
            data = np.frombuffer(text.encode(), np.uint8)
            doc, _, words = tb.words(data, np.array([0, len(data)]))
            if not len(words):
                continue
            size = min(SHINGLE_WORDS, len(words))
            _, hashes = tb.shingles(doc, words, size)
            _, cells = weighted_cells(np.zeros(len(hashes), np.int64), hashes)
            sums = bit_signs(cells).sum(axis=0, keepdims=True)
            item = Item(item_id, len(words), *np.unique(hashes, return_counts=True), fingerprints(sums)[0])
            grouped.setdefault((size, len(words)), []).append(item)
        for (size, words), items in grouped.items():
            self.sizes.setdefault(size, {})[words] = SizeIndex(items)
        for size, by_words in self.sizes.items():
            pairs = [(i.shingles, np.full(len(i.shingles), w)) for w, x in by_words.items() for i in x.items]
            hashes, words = (np.concatenate(p) for p in zip(*pairs, strict=True))
            order = np.lexsort((words, hashes))
            hashes, words = hashes[order], words[order]
            fresh = np.ones(len(hashes), bool)
            fresh[1:] = (hashes[1:] != hashes[:-1]) | (words[1:] != words[:-1])
            sieve = np.zeros(1 << 20, bool)
            sieve[hashes & np.uint64((1 << 20) - 1)] = True
            self.known[size] = hashes[fresh], words[fresh], sieve

    def matches(self, doc: np.ndarray, words: np.ndarray, threshold: float) -> Iterator[tuple[int, Item, int, int, int, float]]:
        """(document, item, first word, words, distance, similarity): the best window of each pair."""
        for size, by_words in self.sizes.items():
            at, hashes = tb.shingles(doc, words, size)
            known, lengths, sieve = self.known[size]
            maybe = np.flatnonzero(sieve[hashes & np.uint64((1 << 20) - 1)])
            first = np.searchsorted(known, hashes[maybe], "left")
            last = np.searchsorted(known, hashes[maybe], "right")
            hit, first, last = maybe[first < last], first[first < last], last[first < last]
            if not len(hit):
                continue
            owner = doc[at[hit]]
            for d in np.unique(owner):
                mine = owner == d
                low, high = np.searchsorted(doc[at], [d, d + 1])
                word_low, word_high = np.searchsorted(doc, [d, d + 1])
                own = hashes[low:high]
                spots = np.repeat(hit[mine] - low, (last - first)[mine])
                sizes = np.concatenate([lengths[a:b] for a, b in zip(first[mine], last[mine], strict=True)])
                yield from self._in_document(int(d), own, size, by_words, spots, sizes, int(word_high - word_low), threshold)

    @staticmethod
    def _in_document(d, hashes, size, by_words, spots, sizes, n_words, threshold):
        sums = WindowSums(hashes)
        for length in np.unique(sizes):
            index = by_words[int(length)]
            span = min(int(length) - size + 1, len(hashes))
            steps = np.zeros(len(hashes) + 2, np.int64)
            own = spots[sizes == length]
            np.add.at(steps, np.maximum(own - span + 1, 0), 1)
            np.add.at(steps, own + 1, -1)
            starts = np.flatnonzero(steps.cumsum()[: len(hashes) - span + 1] > 0)
            if not len(starts):
                continue
            windows = fingerprints(sums.over(starts, span))
            best: dict[int, tuple[float, int, int]] = {}
            for w, i in zip(*index.within_radius(windows), strict=True):
                item, start = index.items[i], int(starts[w])
                have, counts = np.unique(hashes[start : start + span], return_counts=True)
                _, a, b = np.intersect1d(have, item.shingles, assume_unique=True, return_indices=True)
                shared = int(np.minimum(counts[a], item.counts[b]).sum())
                similarity = shared / (span + int(item.counts.sum()) - shared)
                distance = int(np.bitwise_count(windows[w] ^ item.fingerprint))
                if similarity >= threshold and (int(i) not in best or similarity > best[int(i)][0]):
                    best[int(i)] = (similarity, start, distance)
            for i, (similarity, start, distance) in sorted(best.items()):
                yield d, index.items[i], start, min(int(length), n_words), distance, similarity


def _item_blocks(benchmark: DataFrame, limit: int = ITEM_BYTES) -> Iterator[BenchmarkIndex]:
    """Indexes over blocks of items, each of about ``limit`` bytes of text.

    A task holds one block at a time; a larger benchmark takes more passes over
    the documents instead of more memory.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // limit)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield BenchmarkIndex([tuple(r) for r in rows])


def _found(index: BenchmarkIndex, texts: pa.Array, threshold: float) -> Iterator[tuple]:
    for first, _, data, offsets in tb.slices(texts):
        doc, _, words = tb.words(data, offsets)
        for d, *rest in index.matches(doc, words, threshold):
            yield first + d, *rest


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and benchmark item that it contains, with the best window.

    A window has as many words as the item (all words of a shorter document).
    It matches if the weighted Jaccard similarity of the five-word shingles,
    weighted by their counts, is at least ``threshold``; shorter items are one
    shingle of all their words. Windows without any shingle of an item of their
    size have similarity 0 and are passed over; all others are fingerprinted,
    looked up in the multi-index, and the candidates verified exactly. Ties
    take the first window. Null and empty texts match nothing; repeated rows of
    either table give repeated rows; other columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = []
    for index in _item_blocks(benchmark):

        def find(batches: Iterator[pa.RecordBatch], index: BenchmarkIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (batch.column(0)[row].as_py(), item.item_id, start, size, distance, similarity)
                    for row, item, start, size, distance, similarity in _found(index, batch.column(1), threshold)
                ]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                types = [pa.int64()] * 4 + [pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    ["doc_id", "item_id", "first_word", "n_words", "distance", "similarity"],
                )

        parts.append(narrow.mapInArrow(find, MATCH))
    if not parts:
        return narrow.limit(0).mapInArrow(lambda batches: iter(()), MATCH)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no benchmark item; all columns and repeated rows stay."""
    copy = fresh(docs, "_text")
    for index in _item_blocks(benchmark):

        def clean(batches: Iterator[pa.RecordBatch], index: BenchmarkIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in _found(index, batch.column(batch.num_columns - 1), threshold):
                    keep[row] = False
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep))

        docs = docs.withColumn(copy, F.col("text")).mapInArrow(clean, docs.schema)
    return docs


@query("op10_benchmark_decontamination")
def op10(spark, sf):
    """Documents that contain a benchmark item."""
    return leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
