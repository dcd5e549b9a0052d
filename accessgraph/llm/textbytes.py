"""Vectorised words, hashes and word shingles over Arrow string batches.

Texts are handled as UTF-8 bytes. Every function works on a *slice*: one byte
buffer with the offsets of the documents in it, kept to half a megabyte by
:func:`slices` so that the numpy temporaries of a task stay bounded. A document
longer than the slice size is a slice of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SHINGLE = 0xC2B2AE3D27D4EB4F
_POWERS: dict[str, np.ndarray] = {}


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) of consecutive rows; null texts are empty."""
    filled = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(filled, pa.ChunkedArray):
        filled = filled.combine_chunks()
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(filled):
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), len(filled))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def _powers(name: str, base: int, size: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < size:
        steps = np.full(max(size, SLICE_BYTES + 2), base, np.uint64)
        steps[0] = 1
        have = _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return have


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on every bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end), equal for equal bytes anywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    forward = _powers("forward", _BASE, len(data) + 1)
    back = _powers("back", _INVERSE, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * back[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    opens[offsets[:-1][filled]] |= inside[offsets[:-1][filled]]
    closes[offsets[1:][filled] - 1] |= inside[offsets[1:][filled] - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start byte, hash) of each maximal run without ASCII white space."""
    starts, ends = _runs(~_SPACE[data], offsets)
    return np.searchsorted(offsets, starts, "right") - 1, starts, run_hashes(data, starts, ends)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of runs of word bytes and of runs of other visible bytes, in text order."""
    word = _WORD[data]
    a, b = _runs(word, offsets)
    c, d = _runs(~word & ~_SPACE[data], offsets)
    starts, ends = np.concatenate([a, c]), np.concatenate([b, d])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return np.searchsorted(offsets, starts, "right") - 1, run_hashes(data, starts, ends)


def shingles(doc: np.ndarray, hashes: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every ``size`` words in a row of one document.

    A document with fewer words has one shingle of all its words; one without
    words has none.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total, scale = hashes.copy(), 1
    whole = np.ones(n, bool)
    for j in range(1, size):
        scale = scale * _SHINGLE % (1 << 64)
        same = np.zeros(n, bool)
        if j < n:
            same[: n - j] = doc[: n - j] == doc[j:]
            total[: n - j] += np.where(same[: n - j], hashes[j:] * np.uint64(scale), np.uint64(0))
        whole &= same
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    at = np.flatnonzero(whole | first)
    return at, mix(total[at])
