"""Secrets in texts: three fixed rules, and a battery of randomness tests for the rest."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessgraph.llm.common import fresh, query, table

# The base rules and their order.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PREFILTER = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "random": r"[A-Za-z0-9+/_-]{20}",
}

# The battery's candidates, encodings and error rate.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Name, alphabet, and the classes that a token must have symbols of.
ENCODINGS = (
    ("hex", DIGITS + LOWER[:6], (LOWER, DIGITS)),
    ("hex", DIGITS + UPPER[:6], (UPPER, DIGITS)),
    ("base32", UPPER + DIGITS[2:8], (UPPER,)),
    ("base36", DIGITS + LOWER, (LOWER, DIGITS)),
    ("base36", DIGITS + UPPER, (UPPER, DIGITS)),
    ("base62", UPPER + LOWER + DIGITS, (LOWER, UPPER)),
    ("base64", UPPER + LOWER + DIGITS + "+/", (LOWER, UPPER)),
    ("base64url", UPPER + LOWER + DIGITS + "-_", (LOWER, UPPER)),
)
# Stretches inside a candidate that may be a string of their own in a path or a joined name.
PARTS = tuple(re.compile(p) for p in ("[^/]+", "[^_-]+", "[^/_-]+"))
LENGTH_CLASSES = (20, 28, 40, 64, 128)
GRID = 200
FALSE_SHARE = 0.1
PLATEAU = 0.2
PLACEHOLDER = "[secret]"

Span = tuple[int, int, int]


def base_spans(text: str, kinds: tuple[str, ...] = KINDS) -> list[Span]:
    """(start, kind, end) of the fixed rules' matches, leftmost and non-overlapping per kind."""
    found = []
    if "assign" in kinds:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "access" in kinds:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if "hex" in kinds:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def infer_encoding(token: str) -> tuple[str, str] | None:
    """(name, alphabet) of the narrowest encoding that explains ``token``.

    Hexadecimal and base 36 need a digit and a letter, base 32 a capital letter,
    the mixed ones a small and a capital letter; small plain words have none.
    """
    body = token.rstrip("=")
    symbols = set(body)
    for name, alphabet, needed in ENCODINGS:
        if symbols <= set(alphabet) and all(symbols & set(c) for c in needed):
            return name, alphabet
    return None


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_squared_tail(x: float, df: int) -> float:
    """Wilson and Hilferty's approximation of P(X > x)."""
    spread = 2 / (9 * df)
    z = ((x / df) ** (1 / 3) - (1 - spread)) / math.sqrt(spread)
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str, alphabet: str) -> float:
    """Combined p-value of three tests of "uniformly random over ``alphabet``".

    Chi-squared uniformity over groups of symbols (five expected in each), runs
    above and below the middle of the alphabet, and lag-one serial correlation,
    combined by Fisher's method.
    """
    k = len(alphabet)
    lookup = {c: i for i, c in enumerate(alphabet)}
    v = np.array([lookup[c] for c in token.rstrip("=")])
    n = len(v)
    groups = min(k, max(2, n // 5))
    share = np.bincount(np.arange(k) * groups // k, minlength=groups) / k
    counts = np.bincount(v * groups // k, minlength=groups)
    uniform = _chi_squared_tail(float(((counts - n * share) ** 2 / (n * share)).sum()), groups - 1)
    upper = v >= k / 2
    runs = 1 + int((upper[1:] != upper[:-1]).sum())
    z_runs = (runs - (n + 1) / 2) / math.sqrt((n - 1) / 4)
    u = (v - (k - 1) / 2) / math.sqrt((k * k - 1) / 12)
    z_serial = float((u[1:] * u[:-1]).sum()) / math.sqrt(n - 1)
    tails = [max(p, 1e-300) for p in (uniform, _normal_tail(z_runs), _normal_tail(z_serial))]
    half = -sum(map(math.log, tails))
    return min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def stretches(start: int, end: int, base: list[Span]) -> Iterator[tuple[int, int]]:
    """What the base spans leave of [start, end)."""
    for low, _, high in base:
        if low < end and start < high:
            if start < low:
                yield start, low
            start = high
    if start < end:
        yield start, end


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, int, float]]:
    """(start, end, length class, p) of encoded-looking strings outside the base spans, by start and then longest first.

    The base spans are cut out of a string. What is left is tested as a whole
    and in its parts between slashes, between dashes or underscores, and
    between any of them.
    """
    out = []
    for m in CANDIDATE.finditer(text):
        for low, high in stretches(m.start(), m.end(), base):
            spots = {(low, high)}
            for part in PARTS:
                spots.update(p.span() for p in part.finditer(text, low, high))
            for start, end in sorted(spots, key=lambda x: (x[0], -x[1])):
                size = len(text[start:end].rstrip("="))
                level = sum(size >= least for least in LENGTH_CLASSES) - 1
                encoding = infer_encoding(text[start:end]) if level >= 0 else None
                if encoding:
                    out.append((start, end, level, battery(text[start:end], encoding[1])))
    return out


def cuts_from_histogram(rows: list[tuple[int, int, int]], false_share: float = FALSE_SHARE) -> dict[int, float]:
    """The least p-value that is reported, per length class.

    Random strings have uniform p-values, so their number follows from the
    values above ``PLATEAU``; what is more than that is structured. The cut is
    the smallest at which the estimated share of structured strings among the
    reported ones is at most ``false_share``. Long strings are told apart more
    sharply, so each length class has its own cut.
    """
    cuts = {}
    for level in {r[0] for r in rows}:
        counts = np.zeros(GRID + 1)
        for other, slot, n in rows:
            if other == level:
                counts[slot] += n
        above = counts[::-1].cumsum()[::-1]
        edge = int(PLATEAU * GRID)
        truly = above[edge] / (1 - PLATEAU)
        cuts[level] = PLATEAU
        for slot in range(edge + 1):
            if above[slot] and 1 - truly * (1 - slot / GRID) / above[slot] <= false_share:
                cuts[level] = slot / GRID
                break
    return cuts


def _texts(batch_texts: pa.Array) -> Iterator[tuple[int, str, tuple[str, ...]]]:
    """(row, text, kinds whose pattern occurs) of the rows with any."""
    filled = pc.fill_null(batch_texts, "")
    hits = {kind: np.asarray(pc.match_substring_regex(filled, p)) for kind, p in PREFILTER.items()}
    for row in np.flatnonzero(np.logical_or.reduce(list(hits.values()))):
        yield int(row), filled[int(row)].as_py(), tuple(k for k in KINDS if hits[k][row])


def fit_cuts(docs: DataFrame, false_share: float = FALSE_SHARE) -> dict[int, float]:
    """Cuts from the p-values of all candidates in all texts, counted on a grid."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(LENGTH_CLASSES), GRID + 1), np.int64)
        for batch in batches:
            for _, text, kinds in _texts(batch.column(0)):
                if "random" in kinds:
                    for _, _, level, p in candidates(text, base_spans(text, kinds)):
                        counts[level, int(p * GRID)] += 1
        level, slot = np.nonzero(counts)
        yield pa.record_batch(
            [pa.array(level.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(counts[level, slot])],
            ["level", "slot", "n"],
        )

    rows = (
        docs.select("text")
        .mapInArrow(count, "level int, slot int, n long")
        .groupBy("level", "slot")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    return cuts_from_histogram([tuple(r) for r in rows], false_share)


def all_spans(text: str, cuts: dict[int, float], kinds: tuple[str, ...] = KINDS) -> tuple[list[Span], list[Span]]:
    """(base spans, base and battery spans) of one text; a part of a string that is reported is not reported again."""
    base = base_spans(text, kinds)
    if "random" not in kinds:
        return base, base
    found, covered = [], 0
    for start, end, level, p in candidates(text, base):
        if end > covered and int(p * GRID) / GRID >= cuts.get(level, 0.0):
            found.append((start, 3, end))
            covered = end
    return base, sorted(base + found)


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with every stretch covered by spans replaced by the placeholder."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], PLACEHOLDER]
        at = max(at, end)
    return "".join([*out, text[at:]])


ADDED = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, redacted string"


def scan(
    docs: DataFrame, columns: list[str] | None = None, cuts: dict[int, float] | None = None, redact: bool = False
) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with the secrets of every whole text.

    ``spans`` lists ``kind:start:end`` by start and then kind, in code points,
    end exclusive; ``base_sha256`` digests the part that the fixed rules found.
    ``redact`` fills ``redacted`` with the text without its secrets, else it is
    null. A null text is empty and has no spans; repeated rows give repeated
    rows; columns named like the added ones are replaced. ``cuts`` come from
    :func:`fit_cuts` over the same documents unless given.
    """
    cuts = fit_cuts(docs) if cuts is None else cuts
    added = [part.split()[0] for part in ADDED.split(", ")]
    columns = [c for c in (columns or docs.columns) if c not in added]
    kept = len(columns)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        form = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        for batch in batches:
            counts = np.zeros((4, batch.num_rows), np.int64)
            digests, listed = [nothing] * batch.num_rows, [""] * batch.num_rows
            changed = pc.fill_null(batch.column(kept), "").to_pylist() if redact else [None] * batch.num_rows
            for row, text, kinds in _texts(batch.column(kept)):
                base, spans = all_spans(text, cuts, kinds)
                if not spans:
                    continue
                for _, kind, _ in spans:
                    counts[kind, row] += 1
                digests[row], listed[row] = hashlib.sha256(form(base).encode()).hexdigest(), form(spans)
                if redact:
                    changed[row] = redacted(text, spans)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], *map(pa.array, counts), *[pa.array(x, pa.string()) for x in (digests, listed, changed)]],
                [*columns, *added],
            )

    fields = docs.select(*columns).schema
    for part in ADDED.split(", "):
        name, kind = part.split()
        fields = fields.add(name, kind)
    return docs.select(*columns, F.col("text").alias(fresh(docs, "_text"))).mapInArrow(apply, fields)


@query("op8_secret_scans")
def op8(spark, sf):
    """Secrets in every document, by rule and by randomness."""
    return scan(table(spark, sf, "documents"), ["doc_id"]).drop("redacted")
