"""Snapshot collapse and rendering against lists in Python."""

from __future__ import annotations

import random

from accessgraph.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, position string"


def brute(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn if turn is not None else -(10**9), role or "", text or "", role is not None))
    talks = {c: [(r, t) for _, r, t, _ in sorted(x, key=lambda y: (y[0], y[3], y[1]))] for c, x in talks.items()}
    order = lambda c: (c is None, c or 0)
    kept = {}
    for c, x in talks.items():
        if any(len(y) > len(x) and y[: len(x)] == x for y in talks.values()):
            continue
        if any(y == x and order(d) < order(c) for d, y in talks.items() if d != c):
            continue
        kept[c] = x
    return sorted(
        (str(c), i, len(x), f"<|im_start|>{r}\n{t}<|im_end|>\n") for c, x in kept.items() for i, (r, t) in enumerate(x, 1)
    )


def result(df):
    return sorted((str(r.conv_id), r.position, r.n_turns, r.rendered) for r in df.collect())


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert result(chat.render(frame)) == brute(rows)


def test_snapshots_copies_and_branches(spark, monkeypatch):
    rng = random.Random(2)
    rows, conv = [], 0
    for _ in range(12):
        whole = [("user" if i % 2 == 0 else "assistant", f"t{rng.randrange(3)}") for i in range(rng.randrange(1, 9))]
        for _ in range(4):
            cut = whole[: rng.randrange(1, len(whole) + 1)]
            if rng.random() < 0.3:
                cut[-1] = (cut[-1][0], "other end")
            first = rng.randrange(3)
            rows += [(conv, first + i, r, t) for i, (r, t) in enumerate(cut)]
            conv += 1
    check(spark, rows)
    monkeypatch.setattr(chat, "CHUNK", 2)
    check(spark, rows)


def test_many_rows_without_id_are_numbered_in_chunks(spark, monkeypatch):
    rng = random.Random(5)
    roles = ["user", "assistant", None]
    rows = [(None, rng.choice([0, 1, 2, 40, None]), rng.choice(roles), f"text {i}") for i in range(900)]
    rows += [(1, i, "user", f"long {i}") for i in range(150)] + [(2, 0, "user", "same")] * 20
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    whole = result(chat.render(frame))
    expected = brute(rows)
    # Turns of one number and role are ordered by content hash, in the lists as they came.
    assert [r[:3] for r in whole] == [r[:3] for r in expected]
    assert sorted(r[3] for r in whole) == sorted(r[3] for r in expected)
    blocks = [(turn is not None, turn or 0, role is not None, role or "") for conv, turn, role, _ in rows if conv is None]
    marks = {f"{r or ''}\n{t}": (n is not None, n or 0, r is not None, r or "") for c, n, r, t in rows if c is None}
    shown = sorted((p, text) for conv, p, _, text in whole if conv == "None")
    assert [marks[text[len("<|im_start|>") : -len("<|im_end|>\n")]] for _, text in shown] == sorted(blocks)

    sizes = []
    plain = chat.numbered

    def counted(df, keys, order, chunk, out):
        sizes.append(df.groupBy(*keys, chunk).count().agg({"count": "max"}).first()[0])
        return plain(df, keys, order, chunk, out)

    monkeypatch.setattr(chat, "numbered", counted)
    monkeypatch.setattr(chat, "CHUNK", 16)
    monkeypatch.setattr(chat, "CROWDED", 64)
    assert result(chat.render(frame)) == whole
    assert max(sizes) < 64


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, None, None), (2, 0, "user", "hi"), (2, 1, "", ""), (2, 2, "user", "more"), (3, None, "user", "hi"),
        (None, 0, "user", "lonely"), (None, 1, "user", "x"), (4, 0, "user", "lonely"), (5, 0, "a", "z" * 200_000), (6, 0, "user", "hi"),
        (6, 0, "user", "hi"),
    ]
    check(spark, rows)
    assert chat.render(spark.createDataFrame([], SCHEMA)).count() == 0


def test_form_is_a_parameter(spark):
    frame = spark.createDataFrame([(1, 0, "user", "hi {role}", "")], SCHEMA)
    assert [r.rendered for r in chat.render(frame, "[{role}] {text}!").collect()] == ["[user] hi {role}!"]
