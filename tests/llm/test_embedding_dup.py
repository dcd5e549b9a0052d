"""Embedding links and components against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from accessgraph.llm import embedding_dup as ed
from accessgraph.llm.small_world import SmallWorld


def brute(rows, threshold=0.93):
    usable = []
    for _, vector, label in rows:
        ok = label is not None and vector is not None and len(vector) > 0 and all(x is not None and np.isfinite(x) for x in vector)
        usable.append(ok and any(vector))
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            a, b = rows[i], rows[j]
            if i != j and usable[i] and usable[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                link[i, j] = x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold
    root = np.arange(n)
    for _ in range(n):
        low = np.array([min([root[i], *root[link[i]]]) for i in range(n)])
        if (low == root).all():
            break
        root = low
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((str(rows[i][0]), int(link[i].sum()), str(least), rows[i][0] == least))
    return sorted(out)


def result(df):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in df.collect())


def test_odd_rows_and_many_shards(spark):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(12):
        centre = rng.normal(size=8)
        for _ in range(12):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.normal(size=8) * rng.choice([0.05, 0.35])], c % 2))
    rows += [
        (900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [1.0, None] + [0.0] * 6, 1), (904, [float("nan")] * 8, 1),
        (905, [float("inf")] * 8, 1), (906, rows[0][1], None), (907, rows[0][1], 1), (908, rows[0][1], 0), (None, rows[0][1], 0),
        (0, rows[0][1], 0), (909, rows[0][1][:4], 0), (910, [-0.0] * 7 + [1.0], 1), (911, [0.0] * 7 + [1.0], 1),
    ]
    frame = spark.createDataFrame([(i, v, x, "k") for i, v, x in rows], "vec_id long, embedding array<float>, label int, key string")
    got = result(ed.embedding_components(frame, shard=20))
    assert got == brute(rows)
    assert ed.embedding_components(frame.limit(0)).count() == 0


def test_one_large_clique_over_shards(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=16)
    rows = [(i, [float(np.float32(x)) for x in base + rng.normal(size=16) * 0.05], 1) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(50)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = result(ed.embedding_components(frame, shard=100))
    assert got == brute(rows)


@pytest.mark.parametrize("shape", ["spread", "clumped"])
def test_recall_of_a_shard(shape):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(1500 if shape == "spread" else 40, 32))
    vectors = centres[rng.integers(0, len(centres), 1500)] + rng.normal(size=(1500, 32)) * 0.2
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    graph = SmallWorld(vectors, rng.random(1500))
    graph = SmallWorld.load(vectors, graph.save())
    true = vectors @ vectors.T >= 0.93
    np.fill_diagonal(true, False)
    found = ed.links_between(vectors, vectors, (graph, graph), True, 0.93)
    assert not (found & ~true).any()
    assert found.sum() >= 0.97 * true.sum() and true.sum() > 0
    ids, sims = graph.search(vectors[:50].astype(np.float32), 64)
    assert (sims.max(axis=1) > 0.999).mean() > 0.95


def planted(rng, n=1500, links=8):
    """Two shards of unrelated vectors and ``links`` planted pairs between them."""
    left, right = rng.normal(size=(n, 32)), rng.normal(size=(n, 32))
    left[rng.choice(n, links, False)] = right[:links] + rng.normal(size=(links, 32)) * 0.1
    return [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (left, right)]


def crippled(graph):
    """Most nodes lose all their links and are linked by nobody."""
    cut = np.arange(len(graph.vectors)) % 4 != 0
    for links in graph.links:
        links[cut] = -1
        links[np.isin(links, np.flatnonzero(cut))] = -1
    return graph


def test_rare_links_between_shards():
    rng = np.random.default_rng(9)
    left, right = planted(rng)
    true = left @ right.T >= 0.93
    good = tuple(SmallWorld(x, rng.random(len(x))) for x in (left, right))
    assert ed.audited_beam(left, right, good[1], None) < len(right)
    assert (ed.links_between(left, right, good, False, 0.93) == true).all() and true.sum() >= 8
    bad = tuple(crippled(SmallWorld(x, rng.random(len(x)))) for x in (left, right))
    assert ed.audited_beam(left, right, bad[1], None) == len(right)
    assert ed.audited_beam(right, right, bad[1], np.arange(len(right))) == len(right)
    assert (ed.links_between(left, right, bad, False, 0.93) == true).all()


def test_recall_on_the_whole_table(spark):
    """At least 0.9 of the links that brute force finds."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = rows.toPandas()
    wanted = 0
    for _, part in data.groupby("label"):
        v = np.stack(part.embedding).astype(float)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        wanted += int((v @ v.T >= 0.93).sum()) - len(v)
    got = sum(r.n_links for r in ed.embedding_components(rows, shard=200).collect())
    assert 0.9 * wanted <= got <= wanted
