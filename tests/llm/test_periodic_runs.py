"""Runs against a search over all starts, ends and periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from accessgraph.llm import periodic_runs as pr


def all_runs(tokens, least=12):
    """By definition: every stretch, its smallest period, and no longer stretch with that period."""
    n, out = len(tokens), set()
    for q in range(1, n // 2 + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and tokens[end] == tokens[end + q]:
                end += 1
            length = end - start + q
            stretch = tokens[start : start + length]
            if length >= max(least, 2 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.add((start, length, q))
            start = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(tokens, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(tokens) if i not in gone)


def plainly(doc_id, text):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(tokens)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        tokens = [tokens[i] if i < a else tokens[a + (i - a) % p] for i in range(n)]
    runs = all_runs(tokens)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    exponent = None if best[0] is None else 1000 * best[1] // best[2]
    return doc_id, len(runs), *best, exponent, sha(lines), sha(collapsed(tokens, runs))


def repetitive(rng, n, kinds):
    out = []
    while len(out) < n:
        unit = [rng.choice("abcdefghijklmnopqrstuvwxyz"[:kinds]) for _ in range(rng.randrange(1, 9))]
        out += unit * rng.randrange(1, 6) + unit[: rng.randrange(len(unit))] + [str(rng.random())] * rng.randrange(2)
    return out[:n]


@pytest.mark.parametrize("kinds", [1, 2, 3, 8])
def test_lag_scan_equals_all_runs(kinds, monkeypatch):
    rng = random.Random(kinds)
    monkeypatch.setattr(pr, "ANCHOR_BLOCK", 64)
    for n in [12, 13, 24, 25, *[rng.randrange(12, 160) for _ in range(40)]]:
        tokens = repetitive(rng, n, kinds)
        names = {w: i for i, w in enumerate(dict.fromkeys(tokens))}
        ids = np.array([names[w] for w in tokens])
        assert list(map(tuple, pr.lag_scan(ids).tolist())) == all_runs(tokens), tokens


def test_lag_scan_of_square_free_and_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    assert list(map(tuple, pr.lag_scan(np.array(b)).tolist())) == all_runs(b)
    thue = [bin(i).count("1") % 2 for i in range(512)]
    assert list(map(tuple, pr.lag_scan(np.array(thue)).tolist())) == all_runs(thue)


def test_documents_equal_the_definition(spark, documents):
    rng = random.Random(9)
    docs = [(1, None), (2, ""), (3, " \n\t "), (None, "a b " * 9), (5, "x" * 5000), (6, "w " * 3000), (7, "a b " * 20)]
    docs += [(100 + i, rng.choice([" ", "\n", " \t"]).join(repetitive(rng, rng.randrange(1, 120), rng.randrange(1, 9)))) for i in range(80)]
    docs += docs[-3:] + [(900, " ".join(map(str, range(5000))) + " end" + " x y" * 50)]
    frame = documents(docs).repartition(3).withColumnRenamed("lang", "runs").withColumnRenamed("source", "collapsed")
    rows = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in pr.collapse_runs(frame).collect()}
    wanted = set()
    for doc_id, text in docs:
        tokens = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = all_runs(tokens) if doc_id != 900 else [(5001, 100, 2)]
        wanted.add((doc_id, len(tokens), tuple(runs), collapsed(tokens, runs)))
    assert rows == wanted
    assert pr.collapse_runs(documents([])).count() == 0


def test_query_equals_brute_force(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 4000)
    docs.write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in pr.op12(spark, folder).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert got == {i: plainly(i, t) for i, t in texts.items()}
    assert sum(r[1] > 0 for r in got.values()) > len(got) // 20


def test_segments_keep_every_run():
    rng = random.Random(4)
    for _ in range(60):
        tokens = repetitive(rng, 150, 6)
        hashes = np.array([hash(w) % (1 << 60) for w in tokens], np.uint64)
        starts, sizes = pr.surviving_segments(np.zeros(150, np.int64), hashes)
        for s, n, _ in all_runs(tokens):
            assert any(a <= s and s + n <= a + size for a, size in zip(starts, sizes, strict=True))
    starts, sizes = pr.surviving_segments(np.repeat([0, 1], 20), np.tile(np.arange(20, dtype=np.uint64), 2))
    assert len(starts) == len(sizes) == 0
