"""Cuts against plain string slicing, borders of chunks, and the way back."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from accessgraph.llm import fill_middle as fm
from accessgraph.llm.textbytes import slices


def plainly(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def texts():
    rng = random.Random(5)
    passage = "".join(rng.choice("aé日🙂 \n<PSM>") for _ in range(3000)).replace("<P>", "").replace("<S>", "").replace("<M>", "")
    out = [None, "", "a", "é", "🙂", "<", "<P", "<P>", "x<S>y", "<M", "<<", ">>", "<P" * 40, "\x00a\x00", "a" * 50_000, "é" * 30_000]
    out += [passage[: rng.randrange(3000)] for _ in range(60)]
    out += [passage + x for x in ("", "<P>", "1", passage)]
    out += ["é" * 4095 + "<M>" + "é" * 9, " ".join(str(rng.random()) for _ in range(20_000))]
    return out


def test_equals_plain_slicing(spark, documents):
    docs = [(i, t) for i, t in enumerate(texts())] * 2 + [(None, "no id at all"), (-7, "a negative id")]
    frame = documents(docs).repartition(3).withColumnRenamed("lang", "form").withColumnRenamed("source", "output")
    made = fm.fill_in_middle(frame)
    rows = made.withColumn("back", fm.restored(F.col("form"), F.col("output"))).collect()
    key = lambda r: (str(r[0]), r[5])
    assert sorted((tuple(r)[:6] for r in rows), key=key) == sorted((plainly(*d) for d in docs), key=key)
    whole = {i: t or "" for i, t in docs}
    assert all(r.back == whole[r.doc_id] for r in rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fm.fill_in_middle(documents([])).count() == 0


def test_percentages_are_parameters(documents):
    docs = documents([(i, f"text number {i}") for i in range(50)])
    assert {r.form for r in fm.fill_in_middle(docs, plain_percent=100).collect()} == {"plain"}
    assert {r.form for r in fm.fill_in_middle(docs, plain_percent=0, spm_percent=100).collect()} == {"spm"}
    assert fm.fill_in_middle(docs).collect() != fm.fill_in_middle(docs, seed=2).collect()


@pytest.mark.parametrize("block", [50, 1 << 19])
def test_chunks_follow_content(monkeypatch, block):
    monkeypatch.setattr(fm, "HASH_BLOCK", block)
    rng = random.Random(1)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    for _, _, data, offsets in slices(__import__("pyarrow").array(["head " + shared, "", "another head, longer " + shared, "a" * 10_000])):
        borders = fm.chunk_borders(data, offsets)
        assert set(offsets) <= set(borders) and (np.diff(borders) <= fm.LONGEST_CHUNK).all() and (np.diff(borders) > 0).all()
        whole = data.tobytes()
        chunks = [[whole[a:b] for a, b in zip(borders, borders[1:]) if lo <= a < hi] for lo, hi in zip(offsets, offsets[1:])]
        assert b"".join(map(b"".join, chunks)) == whole
        assert len(set(chunks[0]) & set(chunks[2])) >= len(chunks[0]) - 2 > 5


def test_cache_is_bounded_and_shared():
    cache = fm.ChunkCache(limit=3000)
    for i in range(200):
        assert cache.summary(b"%d\xc3\xa9<P>" % i) == (len(str(i)) + 4, True)
        assert len(cache.young) + len(cache.old) <= 2 * (3000 // fm.ENTRY_BYTES + 1)
    before = cache.hits
    assert cache.summary(b"199\xc3\xa9<P>") == (7, True) and cache.hits == before + 1


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_markers_across_chunk_borders(size):
    for text in ("<P>", "ab<S>cd", "ab<Sé", "é<M>", "<<P<M"):
        data = text.encode()
        ends = [*range(size, len(data), size), len(data)]
        doc = fm.Chunked(data, ends, fm.ChunkCache())
        assert doc.marked == any(m in text for m in ("<P>", "<S>", "<M>")) and doc.length == len(text)
        assert [doc.byte_at(i) for i in range(len(text) + 1)] == [len(text[:i].encode()) for i in range(len(text) + 1)]
