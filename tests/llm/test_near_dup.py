"""Near-duplicate classes against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from accessgraph.llm import near_dup as nd
from accessgraph.llm import textbytes as tb

SF = "/root/testdata/sf0.01"
SPACE = "\t\n\x0b\x0c\r "


def shingle_counts(text):
    words = [w for w in "".join(" " if c in SPACE else c for c in text or "").split(" ") if w]
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similarity(a, b):
    shared = sum((a & b).values())
    total = sum((a | b).values())
    return shared / total if total else 0.0


def brute_classes(rows, threshold=0.8):
    """doc_id -> least doc_id of its class, by comparing all pairs that share a shingle."""
    texts = sorted({t or "" for _, t in rows})
    bags = [shingle_counts(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    having = defaultdict(set)
    for i, bag in enumerate(bags):
        near = set().union(*(having[s] for s in bag)) if bag else set()
        for j in near:
            if similarity(bags[i], bags[j]) >= threshold:
                parent[find(i)] = find(j)
        for s in bag:
            having[s].add(i)
    at = {t: i for i, t in enumerate(texts)}
    least = {}
    for doc_id, text in rows:
        root = find(at[text or ""])
        if doc_id is not None:
            least[root] = min(doc_id, least.get(root, doc_id))
    return {(doc_id, text): least.get(find(at[text or ""])) for doc_id, text in rows}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    wanted = brute_classes(rows)
    got = {r.doc_id: (r.class_id, r.kept) for r in nd.duplicate_classes(docs).collect()}
    assert got == {i: (c, c == i) for (i, _), c in wanted.items()}


def edited(words, rng, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"x{rng.integers(1 << 30)}"
    return " ".join(words)


def test_large_group_of_near_copies_and_bridges(spark, documents):
    rng = np.random.default_rng(5)
    base = [f"w{rng.integers(1 << 30)}" for _ in range(150)]
    rows = [(i, edited(base, rng, int(rng.integers(0, 5)))) for i in range(120)]
    rows += [(200 + i, " ".join(base)) for i in range(40)]
    chain = [f"v{i}" for i in range(100)]
    for i in range(6):
        rows.append((300 + i, " ".join(chain[4 * i :] + [f"z{j}" for j in range(4 * i)])))
    got = {(r.doc_id): r.class_id for r in nd.duplicate_classes(documents(rows)).collect()}
    assert got == {i: c for (i, _), c in brute_classes(rows).items()}


def test_edge_cases(spark, documents):
    long_text = " ".join(f"word{i}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, "  \n "), (4, "one two"), (5, "one two"), (6, "one  two"), (7, "one two three"),
        (None, "one two"), (None, "lonely text here"), (8, long_text), (9, long_text + " end"), (4, "one two"),
    ]
    docs = documents(rows).withColumnRenamed("lang", "class_id").withColumnRenamed("source", "key")
    got = sorted((str(r.doc_id), str(r.class_id), r.kept) for r in nd.duplicate_classes(docs).collect())
    wanted = [
        ("1", "1", True), ("2", "1", False), ("3", "3", True), ("4", "4", True), ("4", "4", True), ("5", "4", False),
        ("6", "4", False), ("7", "7", True), ("None", "4", False), ("None", "None", True), ("8", "8", True), ("9", "8", False),
    ]
    assert got == sorted(wanted)
    kept = nd.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "7", "8", "None"]
    assert nd.duplicate_classes(docs.limit(0)).count() == 0
    assert nd.without_near_duplicates(docs.limit(0)).count() == 0


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    a, b = np.r_[hashes[:300], hashes[:100]], np.r_[hashes[100:], hashes[200:300]]
    doc = np.r_[np.zeros(len(a), np.int64), np.ones(len(b), np.int64)]
    ca, cb = Counter(a.tolist()), Counter(b.tolist())
    with np.errstate(over="ignore"):
        found = []
        for salt in range(12):
            cells = nd.weighted_cells(doc, tb.mix(np.r_[a, b] + np.uint64(salt)))
            sig = nd.dart_signatures(*cells, 2)
            assert (sig != nd._EMPTY).all()
            found.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(found) - similarity(ca, cb)) < 0.04


@pytest.mark.parametrize("n", [1, 4, 5, 6])
def test_short_texts_have_one_shingle(n):
    data = np.frombuffer(" ".join("abcdefg"[:n]).encode(), np.uint8)
    doc, _, words = tb.words(data, np.array([0, len(data)]))
    assert len(tb.shingles(doc, words)[0]) == max(1, n - 4)


def test_groups_larger_than_a_unit(spark, documents, monkeypatch):
    monkeypatch.setattr(nd, "SKETCH_CHUNK", 16)
    monkeypatch.setattr(nd, "TEXT_CHUNK", 16)
    rng = np.random.default_rng(8)
    base = [f"w{rng.integers(1 << 30)}" for _ in range(146)]
    rows = [(i, edited(base, rng, int(rng.integers(0, 7)))) for i in range(150)]
    got = {r.doc_id: r.class_id for r in nd.duplicate_classes(documents(rows)).collect()}
    assert got == {i: c for (i, _), c in brute_classes(rows).items()}
    assert 1 < len(set(got.values())) < 150


@pytest.mark.parametrize("size", [20_000, 100_000])
def test_bundles_do_not_grow_with_a_family(spark, size):
    big = spark.range(size).select(F.col("id").cast("string").cast("binary").alias("key"), F.lit(1).alias("family"), F.lit(size).alias("n"))
    pairs = spark.range(6000).select(
        F.concat(F.lit("p"), "id").cast("binary").alias("key"), (2 + F.floor(F.col("id") / 2)).cast("int").alias("family"), F.lit(2).alias("n")
    )
    members = big.unionByName(pairs)
    units = nd.in_units(members, "family", F.col("n"), 512, 1024, nd.small_rows(members, 512))
    bundles = units.groupBy("bundle").agg(F.count("*").alias("rows"), F.count_distinct("family", "i", "j").alias("units"), F.min("n").alias("n"))
    most = bundles.groupBy("n").agg(F.max("rows").alias("rows"), F.max("units").alias("units"), F.sum("rows").alias("all")).collect()
    by_size = {r["n"]: r for r in most}
    parts = -(-size // 512)
    assert by_size[size]["units"] == 1 and by_size[size]["rows"] < 1400 and by_size[size]["all"] == size * parts
    assert by_size[2]["rows"] < 1300 and by_size[2]["all"] == 6000
