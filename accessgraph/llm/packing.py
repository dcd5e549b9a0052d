"""Sum-of-squares packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessgraph.llm.bpe import default_tokenizer, encoder
from accessgraph.llm.common import query, stored, table

CAPACITY = 2048
END_ID = 0
BLOCK_PIECES = 1 << 16
BLOCK_BINS = 1 << 12
BLOCK_BYTES = 1 << 26


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every length, longest first, each at most ``capacity``.

    An item goes where the sum over all gaps of (open bins with that gap)
    squared becomes smallest: into an open bin whose gap is large enough, or
    into a new bin. Ties take the smallest gap, and an open bin before a new
    one. Full bins do not count.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    counts = np.zeros(capacity + 1, np.int64)
    used = 0
    for item in np.argsort(-lengths, kind="stable"):
        size = int(lengths[item])
        choice, gap = -1, capacity
        if size < capacity:
            here = counts[size:capacity]
            change = 2 * (counts[: capacity - size] - here) + 2
            change[0] = 1 - 2 * here[0]
            change[here == 0] = np.iinfo(np.int64).max
            best = int(np.argmin(change))
            if here[best] and change[best] <= 2 * counts[capacity - size] + 1:
                gap = size + best
                choice = open_bins[gap].pop()
                counts[gap] -= 1
        if choice < 0:
            choice, used = used, used + 1
        bins[item], offsets[item] = choice, capacity - gap
        left = gap - size
        if left:
            open_bins[left].append(choice)
            counts[left] += 1
    return bins, offsets


def cut_pieces(total: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of a document's pieces; only the first may be shorter than ``capacity``."""
    head = total % capacity
    starts = np.arange(-((capacity - head) % capacity), total, capacity)
    return np.maximum(starts, 0), np.minimum(starts + capacity, total) - np.maximum(starts, 0)


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, block long, bin long, offset long"


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of every document, with the sequence and the offset it takes.

    A document is its ids and ``end_id``; a null or empty text is ``end_id``
    alone. Only a document longer than ``capacity`` is cut. Repeated rows are
    packed once each. An empty table gives no rows; other columns are ignored.

    Every task packs the pieces of its input split in blocks of at most
    ``BLOCK_PIECES``. The bins that stay open are then packed by the same rule
    in groups of ``BLOCK_BINS``, as if each were one piece, so the split of the
    input costs few sequences. ``with_ids`` adds the pieces' ids (little-endian
    unsigned 32 bits), from which :func:`sequences` makes the packed rows.
    """
    path = tokenizer or default_tokenizer()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        task, block, held = TaskContext.get().partitionId(), 0, 0
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            bins, offsets = sum_of_squares(np.array(columns[3], np.int64), capacity)
            columns += [np.full(len(rows), (task << 24) + block), bins, offsets]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "block", "bin", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py()), end_id).astype("<u4")
                for piece, (start, length) in enumerate(zip(*cut_pieces(len(ids), capacity), strict=True)):
                    data = ids[start : start + length].tobytes()
                    rows.append((doc_id.as_py(), piece, start, length, zlib.crc32(data), data if with_ids else None))
                held += with_ids * 4 * len(ids)
                if len(rows) >= BLOCK_PIECES or held >= BLOCK_BYTES:
                    yield flush()
                    rows, block, held = [], block + 1, 0
        if rows:
            yield flush()

    placed = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(place, PLACED), "placed")
    fills = placed.groupBy("block", "bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < capacity)
    groups = max(1, -(-fills.count() // BLOCK_BINS))

    def merge(part: pa.Table) -> pa.Table:
        part = part.sort_by([("block", "ascending"), ("bin", "ascending")])
        fill = part["fill"].to_numpy()
        bins, offsets = sum_of_squares(fill, capacity)
        block, number = part["block"].to_numpy(), part["bin"].to_numpy()
        first = np.zeros(int(bins.max(initial=-1)) + 1, np.int64)
        first[bins[offsets == 0]] = np.flatnonzero(offsets == 0)
        return pa.table(
            {"block": block, "bin": number, "to_block": block[first[bins]], "to_bin": number[first[bins]], "shift": offsets}
        )

    moved = (
        fills.withColumn("group", F.pmod(F.xxhash64("block", "bin"), F.lit(groups)))
        .groupBy("group")
        .applyInArrow(merge, "block long, bin long, to_block long, to_bin long, shift long")
    )
    sequence = F.shiftleft(F.coalesce("to_block", "block"), 20) + F.coalesce("to_bin", "bin")
    return placed.join(moved, ["block", "bin"], "left").select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        sequence.alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        *(["ids"] if with_ids else []),
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of pieces packed ``with_ids``; a sequence is bounded by the capacity."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.unhex(F.concat_ws("", F.transform(ordered, lambda p: F.hex(p["ids"])))).alias("ids"),
    )


@query("op6_best_fit_packing")
def op6(spark, sf):
    """All documents packed into sequences of 2048 tokens."""
    return pack(table(spark, sf, "documents"))
