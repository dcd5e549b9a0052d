"""Contour lines against segments found square by square and chained in plain Python."""

from __future__ import annotations

import math
import random

import pytest

from accessgraph.operators import contours

LEVELS = (0.0, 0.5, -0.5)


def frame(spark, grid):
    rows = [(r, c, v) for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "row int, col int, elev double")


def crossings(grid, level):
    """Every grid side with an end at or above the level and one below, with the place."""
    out = set()
    for r, line in enumerate(grid):
        for c, v in enumerate(line):
            for dr, dc in ((0, 1), (1, 0)):
                if r + dr < len(grid) and c + dc < len(line) and v is not None and grid[r + dr][c + dc] is not None:
                    w = grid[r + dr][c + dc]
                    if (v >= level) != (w >= level):
                        t = (level - v) / (w - v)
                        out.add((round(c + dc * t, 9), round(r + dr * t, 9)))
    return out


def check(spark, grid, levels=LEVELS):
    rows = contours.contour_lines(frame(spark, grid), levels).collect()
    segments = contours.contour_segments(frame(spark, grid), levels).collect()
    lines = {}
    for r in rows:
        lines.setdefault((r["level"], r["line"]), []).append(r)
    walked = []
    for (level, _), spots in lines.items():
        spots.sort(key=lambda r: r["position"])
        assert [r["position"] for r in spots] == list(range(len(spots))) and len({r["closed"] for r in spots}) == 1
        places = [(r["x"], r["y"]) for r in spots]
        if spots[0]["closed"]:
            assert places[0] == places[-1]
        else:
            # Open lines end at the border of the grid (of whole squares).
            assert len(spots) > 1
        walked += [(level, *a, *b) for a, b in zip(places, places[1:])]
    assert sorted(walked) == sorted((s["level"], s["x1"], s["y1"], s["x2"], s["y2"]) for s in segments)
    for level in levels:
        got = [(round(r["x"], 9), round(r["y"], 9)) for r in rows if r["level"] == level and not (r["closed"] and r["position"] == 0)]
        assert set(got) <= crossings(grid, level)
    return rows, lines


def test_a_round_hill_gives_closed_rings(spark):
    hill = [[1.2 - math.hypot(r - 10, c - 9) / 5 for c in range(20)] for r in range(21)]
    rows, lines = check(spark, hill)
    assert len(lines) == 3 and all(v[0]["closed"] for v in lines.values())
    for (level, _), spots in lines.items():
        radius = (1.2 - level) * 5
        assert all(abs(math.hypot(r["x"] - 9, r["y"] - 10) - radius) < 0.1 for r in spots)
        # The higher ground is on the same side of every ring.
        area = sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(spots, spots[1:]))
        assert area < 0


@pytest.mark.parametrize("seed", [1, 2])
def test_noise_with_saddles_ties_and_holes(spark, seed):
    rng = random.Random(seed)
    grid = [[rng.choice([rng.uniform(-1, 1), 0.0, 0.5, -0.5]) for _ in range(17)] for _ in range(15)]
    rows, lines = check(spark, grid)
    for level in LEVELS:
        inside = {(round(r["x"], 9), round(r["y"], 9)) for r in rows if r["level"] == level}
        assert inside == crossings(grid, level)
    assert {v[0]["closed"] for v in lines.values()} == {True, False}
    grid[7][7] = grid[3][12] = None
    check(spark, grid)


def test_long_straight_line_and_nothing(spark):
    for sign in (1, -1):
        slope = [[sign * float(c) for c in range(3)] for _ in range(300)]
        rows, lines = check(spark, slope, (sign * 0.5,))
        assert len(lines) == 1 and len(rows) == 300 and not rows[0]["closed"]
    assert contours.contour_lines(frame(spark, slope), (99.0,)).count() == 0


def test_rounds_go_on_from_tables(spark):
    """Ten rounds over one line: no round's partitions or plan are carried on to the next."""
    n = 600
    nodes = spark.range(n).selectExpr("id", "if(id > 0, id - 1, null) prev")
    ranked, rings = contours._ranked(nodes)
    assert "LogicalRDD" not in ranked._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.head, r.steps) for r in ranked.collect()) == [(i, 0, i) for i in range(n)] and rings.isEmpty()
