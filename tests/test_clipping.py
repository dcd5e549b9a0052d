"""Lines cut at shores: slivers, holes, shared shores, and dense sampling on random shapes."""

from __future__ import annotations

import math
import random

import pytest
from test_space import on_land, polygons, stars

from accessgraph.operators import clipping

LINES = "contour_id string, coordinates array<struct<lon:double,lat:double>>"


def lines(spark, shapes):
    return spark.createDataFrame([(k, [{"lon": float(x), "lat": float(y)} for x, y in v]) for k, v in shapes.items()], LINES)


def parts_of(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["contour_id"], r["part"], r["hop"], r["t"])):
        out.setdefault((r["contour_id"], r["part"]), []).append((round(r["longitude"], 9), round(r["latitude"], 9)))
    found = {}
    for (line, _), spots in sorted(out.items()):
        found.setdefault(line, []).append(spots)
    return found


def test_slivers_and_parts(spark):
    sliver = [[(0.5, -1), (0.5001, -1), (0.5001, 1), (0.5, 1)]]
    square = [[(2, -1), (4, -1), (4, 1), (2, 1)], [(2.5, -0.5), (3.5, -0.5), (3.5, 0.5), (2.5, 0.5)]]
    land = polygons(spark, [sliver, square])
    drawn = {"through": [(0, 0), (1, 0), (5, 0)], "inside": [(2.1, 0.6), (2.2, 0.7)], "away": [(0, 3), (1, 3), (2, 4)],
             "shore": [(1.5, 1), (4.5, 1)], "dot": [(1, 2), (1, 2)]}
    kept = clipping.clip_lines(lines(spark, drawn), land)
    parts = parts_of(clipping.line_vertices(kept).collect())
    assert parts["through"] == [[(0, 0), (0.5, 0)], [(0.5001, 0), (1, 0), (2, 0)], [(2.5, 0), (3.5, 0)], [(4, 0), (5, 0)]]
    assert parts["away"] == [[(0, 3), (1, 3), (2, 4)]] and "inside" not in parts and "dot" not in parts
    assert parts["shore"][0][0] == (1.5, 1) and parts["shore"][-1][-1] == (4.5, 1)
    dry = {r["contour_id"]: r["on_land_m"] for r in clipping.land_lengths(lines(spark, drawn), land).collect()}
    assert set(dry) - {"shore"} == {"through", "inside"} and abs(dry["through"] - 1.0001 * 111194.93) < 2


def test_random_lines_equal_dense_samples(spark, monkeypatch):
    monkeypatch.setattr(clipping, "HOP_CHUNK", 3)
    shapes, rng = stars(11, 8), random.Random(12)
    drawn = {str(i): [(rng.uniform(-4, 4), rng.uniform(-4, 4)) for _ in range(9)] for i in range(12)}
    land = polygons(spark, shapes)
    pieces = clipping.cut_pieces(lines(spark, drawn), land.unionByName(land)).collect()
    for r in pieces:
        for k in range(1, 20):
            t = k / 20
            spot = r["x1"] + (r["x2"] - r["x1"]) * t, r["y1"] + (r["y2"] - r["y1"]) * t
            assert on_land(*spot, shapes) == r["on_land"]
    for line, spots in drawn.items():
        length = sum(math.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(spots, spots[1:]))
        mine = sum(math.hypot(r["x2"] - r["x1"], r["y2"] - r["y1"]) for r in pieces if r["contour_id"] == line)
        assert mine == pytest.approx(length, abs=1e-6)
    parts = parts_of(clipping.line_vertices(clipping.clip_lines(lines(spark, drawn), land)).collect())
    kept = sum(math.hypot(b[0] - a[0], b[1] - a[1]) for p in parts.values() for v in p for a, b in zip(v, v[1:]))
    assert kept == pytest.approx(sum(math.hypot(r["x2"] - r["x1"], r["y2"] - r["y1"]) for r in pieces if not r["on_land"]), abs=1e-6)
