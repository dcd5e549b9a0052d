"""Benchmark leaks against a scan of every window."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from accessgraph.llm import decontamination as dc


def bag(words):
    size = 5
    if len(words) < size:
        return Counter([tuple(words)]) if words else Counter()
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(text, item, threshold=0.8):
    """Similarity of the best item-sized window, and its first word; None below the threshold."""
    words, own = (text or "").split(), (item or "").split()
    if not words or not own:
        return None
    wanted, best = bag(own), None
    for at in range(max(1, len(words) - len(own) + 1)):
        have = bag(words[at : at + len(own)])
        s = sum((have & wanted).values()) / sum((have | wanted).values())
        if s >= threshold and (best is None or s > best[0]):
            best = (s, at)
    return best


def compare(spark, docs, items, frame, bench):
    wanted = sorted(
        (str(d), str(i), hit[1], round(hit[0], 9)) for d, t in docs for i, x in items if (hit := brute(t, x)) is not None
    )
    got = dc.leaks(frame, bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id), r.first_word, round(r.similarity, 9)) for r in got) == wanted
    return wanted


def test_whole_table_against_every_window(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.where("n_chars < 6000").collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    small = docs.where("n_chars < 6000")
    near = [(d, t) for d, t in rows if any(set(bag(t.split())) & set(bag(x.split())) for _, x in items)]
    got = compare(spark, near, items, small, bench)
    assert len(got) > 10


def test_edits_ends_and_odd_rows(spark, documents):
    rng = np.random.default_rng(2)
    word = lambda: f"w{rng.integers(300)}"
    items = [(k, " ".join(word() for _ in range(int(rng.integers(3, 60))))) for k in range(25)]
    items += [(100, None), (101, ""), (102, "solo"), (103, items[3][1]), (None, "one two three four five six")]
    docs = [(1, None), (2, ""), (3, "solo"), (4, "a solo b"), (None, items[5][1])]
    for n in range(60):
        own = items[int(rng.integers(25))][1].split()
        for at in rng.integers(0, len(own), int(rng.integers(0, 3))):
            own[at] = word()
        docs.append((10 + n, " ".join([word() for _ in range(int(rng.integers(0, 30)))] + own + [word() for _ in range(int(rng.integers(0, 30)))])))
    docs += [(500, " ".join([word() for _ in range(50_000)] + items[0][1].split())), (10, docs[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = documents(docs).withColumnRenamed("lang", "item_id").withColumnRenamed("source", "similarity")
    compare(spark, docs, items, frame, bench)
    clean = dc.without_leaks(frame, bench)
    assert clean.columns == frame.columns
    dirty = {(d, t) for d, t in docs if any(brute(t, x) for _, x in items)}
    assert sorted(str((r.doc_id, r.text)) for r in clean.collect()) == sorted(str(x) for x in docs if x not in dirty)


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = documents([(1, "a b c d e f")])
    assert dc.leaks(docs, bench).count() == 0 and dc.without_leaks(docs, bench).count() == 1
    assert dc.leaks(documents([]), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_blocks_of_items_give_the_same(spark, documents, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(30)], "item_id long, text string")
    docs = documents([(i, "start " + " ".join(f"i{i}w{j}" for j in range(12)) + " end") for i in range(30)])
    whole = {(r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()}
    monkeypatch.setattr(dc._item_blocks, "__defaults__", (500,))
    parts = {(r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()}
    assert whole == parts == {(i, i) for i in range(30)}


@pytest.mark.parametrize("seed", range(3))
def test_multi_index_finds_all_within_the_radius(seed):
    rng = np.random.default_rng(seed)
    items = [dc.Item(i, 9, np.zeros(0, np.uint64), np.zeros(0), x) for i, x in enumerate(rng.integers(0, 1 << 64, 70, np.uint64))]
    index = dc.SizeIndex(items)
    windows = rng.integers(0, 1 << 64, 400, np.uint64)
    for i in range(200):
        flips = rng.choice(64, int(rng.integers(0, 30)), replace=False)
        windows[i] = items[i % 70].fingerprint ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)) if len(flips) else items[i % 70].fingerprint
    distance = np.bitwise_count(windows[:, None] ^ index.fingerprints)
    assert set(zip(*index.within_radius(windows), strict=True)) == set(zip(*np.nonzero(distance <= dc.RADIUS), strict=True))


def test_repeated_shingles_against_every_window(spark, documents):
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(10**6)}"
    items, docs = [], []
    for k, (common, run) in enumerate([(80, 10), (40, 5), (160, 20)] * 20):
        head, tail = [word() for _ in range(common + 4)], [word() for _ in range(run)]
        items.append((k, " ".join(head + ["_"] * (run + 4))))
        copy = head + ["_"] * 4 + tail if k % 2 else head + tail + ["_"] * 4
        docs.append((k, " ".join([word() for _ in range(9)] + copy + [word() for _ in range(9)])))
        docs.append((1000 + k, " ".join(head[: common // 2] + ["_"] * 60 + items[-1][1].split() + ["_"] * 30)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = compare(spark, docs, items, documents(docs), bench)
    assert len(got) >= 60


def test_window_sums_equal_the_cells_of_each_window():
    rng = np.random.default_rng(6)
    hashes = dc.tb.mix(rng.integers(0, 12, 200).astype(np.uint64))
    sums = dc.WindowSums(hashes)
    for span in (1, 2, 17, 200):
        starts = np.arange(len(hashes) - span + 1)
        for start, got in zip(starts, sums.over(starts, span), strict=True):
            _, cells = dc.weighted_cells(np.zeros(span, np.int64), hashes[start : start + span])
            assert (got == dc.bit_signs(cells).sum(axis=0)).all()
