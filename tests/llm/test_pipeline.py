"""The corpus pipeline stage by stage, against brute force on each stage's own input."""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pytest
from test_decontamination import bag, brute
from test_near_dup import brute_classes
from test_packing import check_packing
from test_secret_scan import plain_base
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from accessgraph.llm import textbytes as tb
from accessgraph.llm.common import stored

SF = "/root/testdata/sf0.01"
STAGES = dict(cp.STAGES)


@pytest.fixture(scope="module")
def tables(spark):
    """The input of every stage, and the last stage's rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in cp.STAGES:
        out.append(docs)
        docs = stored(stage(spark, docs, SF))
    return [*out, docs]


def rows_of(df):
    return {r.doc_id: tuple(r) for r in df.select(*cp.DOCUMENT).collect()}


def test_stage_names():
    assert [n for n, _ in cp.STAGES] == [
        "quality classifier", "minhash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing",
    ]
    assert entry.queries()["pipeline"] is cp.run


def plain_importance(docs, target, buckets=10_000):
    """log weights from counts in dictionaries; only the hash of a token is shared."""
    def features(text):
        parts = re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\t-\r ]+", (text or "").encode())
        data = b"".join(parts)
        ends = np.cumsum([len(p) for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        starts = np.r_[0, ends[:-1]].astype(np.int64) if parts else ends
        hashes = [int(h) for h in tb.run_hashes(np.frombuffer(data, np.uint8), starts, ends)]
        pairs = [int(tb.mix(np.array([(a * 31 + b) % (1 << 64)], np.uint64))[0]) for a, b in zip(hashes, hashes[1:])]
        return [h % buckets for h in hashes + pairs]

    bags = {i: features(t) for i, t in docs}
    raw, good = np.ones(buckets), np.ones(buckets)
    for i, bag_ in bags.items():
        np.add.at(raw, bag_, 1)
        if i in target:
            np.add.at(good, bag_, 1)
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    return {i: ratio[b].sum() for i, b in bags.items()}


def test_quality(spark, tables):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    docs = [(r.doc_id, r.text) for r in tables[0].collect()]
    weights = plain_importance(docs, {r.doc_id for r in labels if r.quality == 1})
    share = np.mean([r.quality == 1 for r in labels])
    kept = {r.doc_id for r in tables[1].collect()}
    assert len(kept) == round(share * len(docs))
    # Gumbel noise moves a key by more than 12 with a probability of 6e-6.
    cut = sorted(weights.values(), reverse=True)[len(kept) - 1]
    assert {i for i, w in weights.items() if w > cut + 24} <= kept
    assert not {i for i, w in weights.items() if w < cut - 24} & kept
    assert rows_of(tables[1]).items() <= rows_of(tables[0]).items()


def test_near_duplicates(tables):
    classes = brute_classes([(r.doc_id, r.text) for r in tables[1].collect()])
    assert {r.doc_id for r in tables[2].collect()} == set(classes.values())
    assert rows_of(tables[2]).items() <= rows_of(tables[1]).items()


def test_decontamination(spark, tables):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    known = set().union(*(bag(x.split()) for x in items))
    before = rows_of(tables[2])
    wanted = {
        i: row for i, row in before.items() if not (set(bag(row[1].split())) & known and any(brute(row[1], x) for x in items))
    }
    assert rows_of(tables[3]) == wanted and len(wanted) < len(before)


def test_secrets(tables):
    before, after = rows_of(tables[3]), rows_of(tables[4])
    assert before.keys() == after.keys()
    changed = 0
    for i, row in before.items():
        base = plain_base(row[1])
        if not base and row[1] == after[i][1]:
            assert row == after[i]
            continue
        changed += 1
        assert after[i][4] == len(after[i][1]) and (row[0], row[2], row[3]) == (after[i][0], after[i][2], after[i][3])
        assert not plain_base(after[i][1])
    assert 0 < changed < len(before) / 2


def test_packing(tables):
    docs = [(r.doc_id, r.text) for r in tables[4].collect()]
    check_packing(tables[5].collect(), docs, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 2048)


def test_odd_documents_pass_every_stage(spark, documents):
    long_text = "The long one. " * 20_000
    docs = documents([(None, None), (1, ""), (2, "a"), (2, "a"), (3, long_text), (4, "token=abcdefgh12345 and more")])
    docs = docs.selectExpr("*", *[f"1 AS {c}" for c in ("key", "spans", "_text", "log_weight", "_id", "_key", "component")])
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, SF), "odd")
        assert docs.columns == (cp.DOCUMENT if name != "best-fit packing" and name != "benchmark decontamination" else docs.columns)
    assert {r.doc_id for r in docs.collect()} <= {None, 1, 2, 3, 4}
    empty = documents([])
    for _, stage in cp.STAGES:
        empty = stored(stage(spark, empty, SF), "empty")
    assert empty.count() == 0


def test_run_gives_the_last_stage(spark):
    rows = cp.run(spark, "/root/testdata/sf0.001")
    assert rows.columns[:4] == ["doc_id", "piece", "start", "length"] and rows.count() > 0
