"""Packing and token files against the tokenizer itself."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from accessgraph.llm import packing, token_files
from accessgraph.llm.bpe import Encoder, default_tokenizer

ODD = [
    "a  b\n\n c\t\td  ", "x y z 　!\x1c?", "it's  we'll\r\n 12 3a", "   ", "\n", "", " ' s 's", "été\u0085 ok",
    "ab" * 4000, "日本語 テスト \U0001f642", "a<|endoftext|> b",
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizer(spark, plain):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    encoder, ordinary = Encoder(default_tokenizer()), Encoder(default_tokenizer(), special=False)
    for text in texts:
        assert encoder.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert 50256 in encoder.encode("a<|endoftext|>") and 50256 not in ordinary.encode("a<|endoftext|>")
    other = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert len(other.encode("some words")) > 0


def check_packing(rows, docs, plain, capacity):
    """Every document is there whole, in pieces at their places, and no sequence overflows or has gaps."""
    wanted = defaultdict(int)
    for doc_id, text in docs:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        starts, lengths = packing.cut_pieces(len(ids), capacity)
        assert lengths.sum() == len(ids) and (lengths[1:] == capacity).all()
        for piece, (start, length) in enumerate(zip(starts, lengths, strict=True)):
            wanted[doc_id, piece, int(start), int(length), zlib.crc32(ids[start : start + length].tobytes())] += 1
    got = defaultdict(int)
    places = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert got == wanted
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pack_edge_cases(spark, documents, plain):
    long_text = " ".join(f"w{i}" for i in range(4000))
    docs = [(1, None), (2, ""), (None, "a b c"), (4, long_text), (4, long_text), *[(10 + i, t) for i, t in enumerate(ODD)]]
    frame = documents(docs).withColumnRenamed("lang", "block").withColumnRenamed("source", "offset")
    rows = packing.pack(frame).collect()
    check_packing(rows, docs, plain, 2048)
    assert packing.pack(documents([])).count() == 0


def test_whole_table_is_packed_tightly(spark, plain):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    rows = packing.pack(table.repartition(5), with_ids=True)
    sequences = check_packing(rows.collect(), docs, plain, 2048)
    total = sum(len(plain.encode(t, add_special_tokens=False).ids) + 1 for _, t in docs)
    assert sequences <= -(-total // 2048) + 4
    packed = packing.sequences(rows).collect()
    assert len(packed) == sequences and all(len(r.ids) == 4 * r.length for r in packed)


@pytest.mark.parametrize("order", [1, -1])
def test_sum_of_squares_choices(order):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 20, 200)[::order]
    bins, offsets = packing.sum_of_squares(lengths, 20)
    counts, fill = np.zeros(21, int), {}
    for item in np.argsort(-lengths, kind="stable"):
        size, b = lengths[item], bins[item]
        gap = 20 - fill.get(b, 0)
        assert offsets[item] == fill.get(b, 0)

        def cost(g, size=size):
            after = counts.copy()
            if g < 20:
                after[g] -= 1
            if g > size:
                after[g - size] += 1
            return (after[1:20] ** 2).sum()

        options = [g for g in range(size, 20) if counts[g]] + [20]
        assert cost(gap) == min(map(cost, options))
        if gap < 20:
            counts[gap] -= 1
        if gap > size:
            counts[gap - size] += 1
        fill[b] = fill.get(b, 0) + size


def test_token_files_count_every_document(spark, documents, plain, folder):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "a"), (90, None), (91, " ".join(map(str, range(3000))))]
    frame = documents(docs).repartition(3).withColumnRenamed("lang", "file").withColumnRenamed("source", "ordinal")
    manifest = token_files.write_token_files(frame, f"{folder}/tokens")
    lengths = token_files.document_lengths(spark, f"{folder}/tokens", block_tokens=64)
    named = lengths.selectExpr("element_at(split(path, '/'), -1) AS file", "ordinal", "n_tokens", "start", "ended")
    got = sorted((str(r.doc_id), r.n_tokens) for r in manifest.join(named, ["file", "ordinal"]).collect())
    plain.encode_special_tokens = True
    wanted = sorted((str(i), len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in docs)
    plain.encode_special_tokens = False
    assert got == wanted
    none = token_files.write_token_files(documents([]), f"{folder}/none")
    assert none.count() == 0


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_boundaries_across_blocks(spark, folder, block, monkeypatch):
    monkeypatch.setattr(token_files, "SCAN_GROUP", 4)
    rng = np.random.default_rng(block)
    wanted = []
    for name in "ab":
        ids = rng.integers(0, 5, 200).astype("<u2")
        if name == "a":
            ids[-1] = 0
        ids.tofile(f"{folder}/{name}.bin")
        ends = np.flatnonzero(ids == 0)
        starts = np.r_[0, ends[:-1] + 1]
        wanted += [(name, k, int(s), int(e - s), True) for k, (s, e) in enumerate(zip(starts, ends, strict=True))]
        if ends[-1] < 199:
            wanted.append((name, len(ends), int(ends[-1]) + 1, 199 - int(ends[-1]), False))
    np.zeros(0, "<u2").tofile(f"{folder}/empty.bin")
    got = token_files.document_lengths(spark, folder, end_id=0, block_tokens=block).collect()
    assert sorted((r.path[-5], r.ordinal, r.start, r.n_tokens, r.ended) for r in got) == sorted(wanted)


def test_ids_wider_than_the_files_are_an_error(spark, documents, folder):
    frame = documents([(1, "some words")])
    with pytest.raises(Exception, match="does not fit into <u2"):
        token_files.write_token_files(frame, f"{folder}/narrow", end_id=1 << 16)
    token_files.write_token_files(frame, f"{folder}/wide", end_id=1 << 16, dtype="<u4")
    counted = token_files.document_lengths(spark, f"{folder}/wide", end_id=1 << 16, dtype="<u4").collect()
    assert [(r.n_tokens, r.ended) for r in counted] == [(2, True)]
