"""Near-duplicate documents by DartMinHash signatures and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessgraph.llm import textbytes as tb
from accessgraph.llm.common import fresh, query, stored, table, text_key
from accessgraph.llm.components import components, roots_of

SHINGLE_WORDS = 5
THRESHOLD = 0.8
# 32 bands of 4 coordinates miss a pair of similarity 0.8 with probability 5e-8.
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
DARTS = math.ceil(COORDINATES * (math.log(COORDINATES) + 4))
# Two texts of similarity 0.8 agree in 115 of 128 one-bit coordinates with a
# deviation of 3.4; pairs over 36 differing bits are 6 deviations away.
SKETCH_BITS = 36
# Members of a unit: compared by sketches, and by texts.
SKETCH_CHUNK, TEXT_CHUNK = 1024, 512
# A group of more members than this part of a chunk is compared on its own.
SMALL = 4

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LEVEL, _SQUARE, _DART = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def cells_of(hashes: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The cell of each shingle's occurrence number ``level``, counted from 0."""
    return tb.mix(hashes + level.astype(np.uint64) * _LEVEL)


def weighted_cells(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, cell hash): the n-th occurrence of a shingle in a document is the cell of its n-th unit of weight."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    index = np.arange(len(doc))
    level = index - np.maximum.accumulate(np.where(fresh, index, 0))
    return doc, cells_of(hashes, level)


def dart_signatures(doc: np.ndarray, cells: np.ndarray, n_docs: int) -> np.ndarray:
    """A row of ``COORDINATES`` dart values per document; rows of documents without cells stay empty.

    Darts fall on the plane (unit of weight of an element) x (rank) as a Poisson
    process of rate one, drawn by hashes, so documents that share a region share
    its darts. A document of weight N looks at ranks below ``DARTS / N``, which
    gives it about ``DARTS`` darts whatever its weight. The earliest dart of each
    coordinate is kept; if a coordinate is still empty the rank limit doubles.
    """
    signatures = np.full((n_docs, COORDINATES), _EMPTY)
    weight = np.bincount(doc, minlength=n_docs)
    limit = DARTS / np.maximum(weight, 1)
    pending = weight > 0
    while pending.any():
        use = pending[doc]
        d, c = doc[use], cells[use]
        squares = np.ceil(limit[d]).astype(np.int64)
        owner = np.repeat(np.arange(len(d)), squares)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(squares) - squares, squares)
        square = tb.mix(c[owner] + (rank.astype(np.uint64) + np.uint64(1)) * _SQUARE)
        darts = np.searchsorted(_POISSON, (square >> np.uint64(11)) / float(1 << 53), "right")
        thrown = np.repeat(np.arange(len(owner)), darts)
        number = np.arange(len(thrown)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = tb.mix(square[thrown] + (number.astype(np.uint64) + np.uint64(1)) * _DART)
        row, floor = d[owner[thrown]], rank[thrown]
        hit = floor + (dart >> np.uint64(32)) / float(1 << 32) < limit[row]
        row, floor, dart = row[hit], floor[hit], dart[hit]
        coordinate = (dart & np.uint64(COORDINATES - 1)).astype(np.int64)
        value = (floor.astype(np.uint64) << np.uint64(52)) | (dart >> np.uint64(12))
        np.minimum.at(signatures.reshape(-1), row * COORDINATES + coordinate, value)
        limit = limit * 2
        pending &= (signatures == _EMPTY).any(axis=1)
    return signatures


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps = tb.mix(np.arange(1, ROWS + 1, dtype=np.uint64))
    for batch in batches:
        for first, end, data, offsets in tb.slices(batch.column(1)):
            doc, _, words = tb.words(data, offsets)
            at, hashes = tb.shingles(doc, words, SHINGLE_WORDS)
            values = dart_signatures(*weighted_cells(doc[at], hashes), end - first)
            filled = np.flatnonzero(values[:, 0] != _EMPTY)
            values = tb.mix(values[filled])
            bands = (values.reshape(len(filled), BANDS, ROWS) * (steps | np.uint64(1))).sum(axis=2, dtype=np.uint64)
            bands = tb.mix(bands + tb.mix(np.arange(BANDS, dtype=np.uint64)))
            bits = np.packbits((values >> np.uint64(63)).astype(np.uint8), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[first:end].take(pa.array(filled)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(0, len(filled) * BANDS + 1, BANDS, dtype=np.int32)),
                        pa.array(bands.view(np.int64).ravel()),
                    ),
                    pa.array(bits[:, 0] if len(filled) else np.zeros(0, np.int64)),
                    pa.array(bits[:, 1] if len(filled) else np.zeros(0, np.int64)),
                ],
                ["key", "bands", "low", "high"],
            )


def linked(doc: np.ndarray, cells: np.ndarray, n_docs: int, threshold: float) -> np.ndarray:
    """Matrix of the pairs whose weighted Jaccard similarity is at least ``threshold``.

    Shared weight is the number of shared cells, so it is a matrix product over
    the cells that occur in more than one document.
    """
    size = np.bincount(doc, minlength=n_docs).astype(np.float64)
    _, column, count = np.unique(cells, return_inverse=True, return_counts=True)
    common = np.cumsum(count > 1) - 1
    use = count[column] > 1
    row, column = doc[use], common[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n_docs, n_docs), np.float32)
    width = max(1, min(4096, (1 << 22) // max(n_docs, 1)))
    at = 0
    while at < len(column):
        low = column[at]
        end = np.searchsorted(column, low + width)
        part = np.zeros((n_docs, width), np.float32)
        part[row[at:end], column[at:end] - low] = 1
        shared += part @ part.T
        at = end
    found = shared / np.maximum(size[:, None] + size[None, :] - shared, 1) >= threshold
    np.fill_diagonal(found, False)
    return found


def _runs(part: pa.Table, names: list[str]) -> list[tuple[int, int]]:
    """(first, end) of the rows that agree in ``names``; the table is sorted by them."""
    fresh = np.zeros(part.num_rows, bool)
    fresh[:1] = True
    for name in names:
        values = part[name].to_numpy()
        fresh[1:] |= values[1:] != values[:-1]
    starts = np.flatnonzero(fresh)
    return list(zip(starts, np.r_[starts[1:], part.num_rows], strict=True))


def _forest(keys: list[bytes], found: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Edges from every linked node to the least node it reaches."""
    roots, _ = roots_of(found)
    moved = np.flatnonzero(roots != np.arange(len(roots)))
    return [keys[i] for i in moved], [keys[roots[i]] for i in moved]


def _alike(low: np.ndarray, high: np.ndarray, rows: int = 128) -> np.ndarray:
    """Matrix of the sketches that differ in at most ``SKETCH_BITS`` bits, made a few rows at a time."""
    out = np.zeros((len(low), len(low)), bool)
    for at in range(0, len(low), rows):
        part = slice(at, at + rows)
        bits = np.bitwise_count(low[part, None] ^ low) + np.bitwise_count(high[part, None] ^ high)
        out[part] = bits <= SKETCH_BITS
    return out


def in_units(members: DataFrame, group: str, size: Column, chunk: int, per_task: int, small: int) -> DataFrame:
    """Lay the members of groups out in units that are compared as a whole.

    A group of up to ``chunk`` members is one unit. A larger one is split by the
    hash of the key, and every two of its parts meet in one unit of about twice
    ``chunk`` rows, so that no unit grows with the group. Such a unit is a
    bundle of its own; the units of small groups share bundles of about
    ``per_task`` rows by hash; ``small`` is the number of their members. A
    bundle is what one task holds at a time, so its rows are bounded whatever
    the sizes of the groups are.
    """
    parts = F.ceil(size / F.lit(chunk)).cast("int")
    own = F.pmod(F.xxhash64("key"), F.col("_parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    alone = F.col("_size") > chunk // SMALL
    bundles = max(1, -(-small // per_task))
    laid = members.withColumns({"_parts": parts, "_size": size}).withColumn("_own", own).withColumn("_other", other)
    laid = laid.withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other")})
    unit = F.xxhash64(group, "i", "j")
    # Numbers below zero are bundles of one unit.
    bundle = F.when(alone, F.bitwise_not(F.shiftrightunsigned(unit, 1))).otherwise(F.pmod(unit, F.lit(bundles)))
    return laid.withColumn("bundle", bundle).drop("_parts", "_size", "_own", "_other")


def small_rows(members: DataFrame, chunk: int) -> int:
    return members.where(F.col("n") <= chunk // SMALL).count()


def plausible_families(signatures: DataFrame) -> DataFrame:
    """(key, family): texts joined, directly or through others, by pairs that may be similar enough.

    Texts that share a band's bucket are compared by their one-bit sketches, all
    with all inside bounded units; only the edges of a spanning forest leave a
    task.
    """
    bands = signatures.select("key", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(bands.join(buckets, "band").join(signatures.select("key", "low", "high"), "key"), "members")

    def compare(part: pa.Table) -> pa.Table:
        part = part.sort_by([("band", "ascending"), ("i", "ascending"), ("j", "ascending"), ("key", "ascending")])
        keys = part["key"].to_pylist()
        low, high = (part[c].to_numpy().view(np.uint64) for c in ("low", "high"))
        a, b = [], []
        for first, end in _runs(part, ["band", "i", "j"]):
            if end - first == 2:
                near = int(low[first] ^ low[first + 1]).bit_count() + int(high[first] ^ high[first + 1]).bit_count()
                if near <= SKETCH_BITS:
                    a.append(keys[first + 1])
                    b.append(keys[first])
                continue
            more = _forest(keys[first:end], _alike(low[first:end], high[first:end]))
            a += more[0]
            b += more[1]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())}).group_by(["a", "b"]).aggregate([])

    units = in_units(members, "band", F.col("n"), SKETCH_CHUNK, 8 * SKETCH_CHUNK, small_rows(members, SKETCH_CHUNK))
    edges = units.select("bundle", "band", "i", "j", "key", "low", "high").groupBy("bundle")
    return components(edges.applyInArrow(compare, "a binary, b binary")).select(
        F.col("node").alias("key"), F.col("component").alias("family")
    )


def near_duplicate_links(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) keys of texts in one class; the edges connect every class and no more.

    Candidates are the pairs that share a band. Their families are compared
    exactly, all with all inside bounded units, and a task returns the edges of
    a spanning forest, so a group of copies never becomes a list of pairs.
    """
    keyed = docs.select(text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    signed = keyed.mapInArrow(_signature_rows, "key binary, bands array<long>, low long, high long")
    families = plausible_families(stored(signed.dropDuplicates(["key"]), "signatures"))
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    members = stored(families.join(sizes, "family"), "families")
    texts = keyed.dropDuplicates(["key"]).join(members, "key").select("key", "family", "n", "text")

    def compare(part: pa.Table) -> pa.Table:
        part = part.sort_by([("unit", "ascending"), ("key", "ascending")])
        keys, runs = part["key"].to_pylist(), _runs(part, ["unit"])
        a, b = [], []
        docs, cells = [], []
        for first, _, data, offsets in tb.slices(part["text"]):
            doc, _, words = tb.words(data, offsets)
            at, hashes = tb.shingles(doc, words, SHINGLE_WORDS)
            d, c = weighted_cells(doc[at], hashes)
            docs.append(d + first)
            cells.append(c)
        doc, cell = np.concatenate(docs), np.concatenate(cells)
        for first, end in runs:
            low, high = np.searchsorted(doc, [first, end])
            more = _forest(keys[first:end], linked(doc[low:high] - first, cell[low:high], end - first, threshold))
            a += more[0]
            b += more[1]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    units = in_units(texts, "family", F.col("n"), TEXT_CHUNK, 2 * TEXT_CHUNK, small_rows(members, TEXT_CHUNK))
    named = units.select("bundle", F.xxhash64("family", "i", "j").alias("unit"), "key", "text")
    return named.groupBy("bundle").applyInArrow(compare, "a binary, b binary")


def duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id``, ``key`` of its text, ``class_id``, and ``kept``.

    Texts are linked if the weighted Jaccard similarity of their five-word
    shingles, weighted by their counts, is at least ``threshold``; equal texts
    always are. ``class_id`` is the least id of a document in the connected
    class, and that document is kept. Words are runs without ASCII white space;
    a text of fewer than five words is one shingle. Null texts count as empty,
    and all empty texts are one class. A null id never represents a class with
    other ids; repeated rows are repeated in the result. Other columns are
    ignored.
    """
    keyed = stored(docs.select("doc_id", text_key(F.col("text")).alias("key")), "keys")
    labels = components(near_duplicate_links(docs, threshold)).withColumnRenamed("node", "key")
    least = keyed.groupBy("key").agg(F.min("doc_id").alias("least"))
    classes = stored(
        least.join(labels, "key", "left").select("key", "least", F.coalesce("component", "key").alias("component")), "classes"
    )
    # Written, so that adaptive execution can split the rows of a large class in the join.
    ids = stored(classes.groupBy("component").agg(F.min("least").alias("class_id")), "class-ids")
    placed = keyed.join(classes.join(ids, "component").select("key", "class_id"), "key")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id"))
    return placed.select("doc_id", "key", "class_id", kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, all columns; rows that repeat id and text are one document."""
    classes = duplicate_classes(docs, threshold).where("kept")
    kept = stored(classes.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("_rows")), "kept").withColumnRenamed(
        "doc_id", "_kept_id"
    )
    name = fresh(docs, "_key")
    keyed = docs.withColumn(name, text_key(F.col("text")))

    def those(chosen: DataFrame) -> DataFrame:
        same = keyed["doc_id"].eqNullSafe(chosen["_kept_id"]) & (keyed[name] == chosen["key"])
        return keyed.join(chosen, same, "left_semi")

    repeated = kept.where("_rows > 1")
    if repeated.isEmpty():
        return those(kept).drop(name)
    once = those(kept.where("_rows = 1")).unionByName(those(repeated).dropDuplicates(["doc_id", name]))
    return once.drop(name)


@query("op7_minhash_near_dedup")
def op7(spark, sf):
    """The near-duplicate class of every document."""
    return duplicate_classes(table(spark, sf, "documents")).drop("key")
