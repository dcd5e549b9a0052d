import math
import random

from pyspark.sql import functions as F

from accessgraph.operators.windows import nearest_rank, numbered, previous_row


def skewed(n=3000, seed=5):
    """One key holds a third of the rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(200)}"
        rows.append((key, i, round(rng.uniform(0, 100), 2) if rng.random() > 0.05 else None))
    return rows


def test_numbering_and_previous_row_across_chunks(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, i long, v double")
    chunk = F.floor(F.col("i") / 97)
    by_key = {}
    for key, i, v in rows:
        by_key.setdefault(key, []).append((i, v))
    got = numbered(df, ["k"], ["i"], chunk).collect()
    assert {(r["k"], r["i"], r["n"]) for r in got} == {
        (k, i, n + 1) for k, items in by_key.items() for n, (i, _) in enumerate(items)
    }
    seen = previous_row(df, ["k"], ["i"], chunk, ["i", "v"]).collect()
    assert len(seen) == len(rows)
    want = {(k, items[n][0]): items[n - 1] if n else None for k, items in by_key.items() for n in range(len(items))}
    for r in seen:
        expected = want[(r["k"], r["i"])]
        assert (None if r["prev"] is None else tuple(r["prev"])) == expected


def test_nearest_rank_is_exact(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, i long, v double")
    got = {r["k"]: r for r in nearest_rank(df, ["k"], "v", {"p50": 0.5, "p90": 0.9}).collect()}
    values = {}
    for key, _, v in rows:
        if v is not None:
            values.setdefault(key, []).append(v)
    assert set(got) == set(values)
    for key, items in values.items():
        items.sort()
        for label, q in (("p50", 0.5), ("p90", 0.9)):
            assert got[key][label] == items[max(0, math.ceil(q * len(items)) - 1)]
