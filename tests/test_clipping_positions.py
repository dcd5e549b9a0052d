"""Hops in the same place are cut once, and every line gets its pieces."""

from __future__ import annotations

import pytest

from accessgraph.operators import clipping
from accessgraph.sources.features import polygon_rows

SQUARE = [[{"lon": 0.0, "lat": 0.0}, {"lon": 1.0, "lat": 0.0}, {"lon": 1.0, "lat": 1.0}, {"lon": 0.0, "lat": 1.0}]]


@pytest.fixture
def land(spark):
    return polygon_rows(spark.createDataFrame([(1, SQUARE)], "polygon_id long, rings array<array<struct<lon:double,lat:double>>>"))


@pytest.fixture
def drawn(spark):
    """Five lines there, five lines there and back: 20 hops in two places, and a line without coordinates."""
    there, back = [(-0.5, 0.5), (1.5, 0.5)], [(-0.5, 0.5), (1.5, 0.5), (-0.5, 0.5)]
    rows = [(i, back if i % 2 else there) for i in range(10)] + [(10, [(None, 0.5), (0.5, 0.5)])]
    return spark.createDataFrame(rows, "contour_id int, coordinates array<struct<lon:double,lat:double>>")


@pytest.fixture
def listed(monkeypatch):
    seen, plain = [], clipping._listed
    monkeypatch.setattr(clipping, "_listed", lambda df, cell: seen.append((df.columns, df.count())) or plain(df, cell))
    return lambda: [n for columns, n in seen if clipping.LINE in columns]


def test_equal_hops_are_cut_once(spark, land, drawn, listed):
    kept = clipping.clip_lines(drawn, land).collect()
    found = sorted((r.contour_id, r.hop, round(r.x1, 9), round(r.x2, 9)) for r in kept)
    there = [(0, -0.5, 0.0), (0, 1.0, 1.5)]
    back = [(1, 0.0, -0.5), (1, 1.5, 1.0)]
    assert found == [(i, *p) for i in range(10) for p in ([*there, *back] if i % 2 else there)]
    # Out of the land and back on it is one part.
    assert [len({r.part for r in kept if r.contour_id == i}) for i in (0, 1)] == [2, 3]
    # The two places, and the hop without coordinates.
    assert listed() == [3]


def test_lengths_are_summed_per_place(spark, land, drawn, listed, monkeypatch):
    """Metres are added up per place before they meet the lines."""
    frame, grouped = type(drawn), []
    monkeypatch.setattr(frame, "groupBy", lambda self, *c, real=frame.groupBy: grouped.append(c) or real(self, *c))
    got = {r.contour_id: r.on_land_m for r in clipping.land_lengths(drawn, land).collect()}
    assert got.keys() == set(range(10)) and listed() == [3]
    assert len({round(got[i], 6) for i in range(0, 10, 2)}) == 1
    assert all(got[i] == pytest.approx(2 * got[0]) for i in range(1, 10, 2))
    assert grouped.index((clipping.LINE,)) < grouped.index(("contour_id",))
