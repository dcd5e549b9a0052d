"""Importance resampling: held-out accuracy, exact top-k, edge cases."""

from __future__ import annotations

import numpy as np
import pytest

from accessgraph.llm import importance as imp

SF = "/root/testdata/sf0.1"


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in imp.resample(docs, rows.where("doc_id % 2 = 0"), columns=["doc_id"]).collect()}
    held = rows.where("doc_id % 2 = 1").collect()
    good = [r.doc_id in kept for r in held if r.quality == 1]
    poor = [r.doc_id in kept for r in held if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(poor) < 0.2


@pytest.mark.parametrize("k", [0, 1, 7, 40, 41, 100])
def test_kth_largest(spark, k):
    values = [float(x) for x in np.random.default_rng(1).integers(-20, 20, 40)] + [1e9]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    wanted = sorted(values, reverse=True)[k - 1] if 0 < k <= 41 else (None if k < 1 else min(values))
    assert imp.kth_largest(frame, "v", k, bins=4) == wanted
    assert imp.kth_largest(frame.limit(0), "v", 3) is None


def test_weights_are_the_log_ratio_of_the_models(spark, documents, labels):
    docs = documents([(1, "good text here"), (2, "bad ### text"), (3, None)])
    ratios = imp.fit_log_ratios(docs, labels([(1, 1, 0), (2, 0, 0)]), buckets=97)
    data = np.frombuffer(b"good text herebad ### text", np.uint8)
    doc, bucket = imp._features(data, np.array([0, 14, 26, 26]), 97)
    raw = np.bincount(bucket, minlength=97) + 1.0
    target = np.bincount(bucket[doc == 0], minlength=97) + 1.0
    assert np.allclose(ratios, np.log(target / target.sum()) - np.log(raw / raw.sum()))
    got = {r.doc_id: r.log_weight for r in imp.with_importance(docs, ratios).collect()}
    assert np.allclose([got[1], got[2], got[3]], np.bincount(doc, ratios[bucket], 3), atol=1e-6)


def test_edge_cases(spark, documents, labels):
    rows = [(1, "some good words"), (1, "some good words"), (2, None), (None, ""), (3, "x " * 100_000), (4, "### $$$ %%%")]
    docs = documents(rows).withColumnRenamed("lang", "log_weight")
    assert imp.resample(docs, labels([])).count() == 6
    assert imp.resample(docs, labels([(1, 0, 0), (None, 1, 0), (2, None, 0)])).count() == 6
    picked = imp.resample(docs, labels([(1, 1, 0), (1, 1, 0), (4, 0, 1)]), k=1)
    assert [r.doc_id for r in picked.collect()] in ([1, 1], [3], [2], [None], [4])
    assert imp.resample(docs.limit(0), labels([(1, 1, 0)])).count() == 0
    again = imp.resample(docs, labels([(1, 1, 0), (4, 0, 1)]), k=3).select("doc_id", "sampling_key").collect()
    assert sorted(map(str, again)) == sorted(map(str, imp.resample(docs.repartition(3), labels([(1, 1, 0), (4, 0, 1)]), k=3).select("doc_id", "sampling_key").collect()))
