"""Rows that share a place are searched once, and every one of them gets its answer."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from accessgraph.functions import geo
from accessgraph.operators import grids, spatial
from accessgraph.sources.features import polygon_rows

SQUARE = [[{"lon": 0.0, "lat": 0.0}, {"lon": 1.0, "lat": 0.0}, {"lon": 1.0, "lat": 1.0}, {"lon": 0.0, "lat": 1.0}]]


@pytest.fixture
def land(spark):
    return polygon_rows(spark.createDataFrame([(1, SQUARE)], "polygon_id long, rings array<array<struct<lon:double,lat:double>>>"))


@pytest.fixture
def rows_into(monkeypatch):
    """Count the rows that a function of a module is given."""

    def watch(module, name):
        seen, plain = [], getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, *a, **k: seen.append(df.count()) or plain(df, *a, **k))
        return seen

    return watch


def test_equal_segments_are_sampled_once(spark, land, rows_into):
    sampled = rows_into(spatial, "segment_samples")
    segments = spark.createDataFrame(
        [(i, -0.5, 0.5, 0.5 if i % 2 else -0.1, 0.5) for i in range(10)], "segment_id int, x1 double, y1 double, x2 double, y2 double"
    )
    got = spatial.segments_on_land(segments, spatial.index_polygons(land)).collect()
    assert sorted((r.segment_id, r.crosses_land) for r in got) == [(i, i % 2 == 1) for i in range(10)]
    paths = spark.createDataFrame(
        [(i, [(-0.5, 0.5), (0.5 if i % 2 else -0.1, 0.5)]) for i in range(10)], "path_id int, coordinates array<struct<lon:double,lat:double>>"
    )
    got = spatial.paths_on_land(paths, spatial.index_polygons(land), exempt_ends=False).collect()
    assert sorted((r.path_id, r.crosses_land) for r in got) == [(i, i % 2 == 1) for i in range(10)]
    assert sampled == [2, 2]


def test_offshore_positions_are_measured_once(spark, land, rows_into):
    measured = rows_into(spatial, "distance_to_edges")
    spots = [(f"g{i}", True, 2.0 if i % 2 else 0.5, 0.5) for i in range(10)]
    places = spark.createDataFrame(spots, "global_id string, is_locality boolean, longitude double, latitude double")
    got = {r.global_id: r.km for r in spatial.offshore_localities(places, land).collect()}
    assert got == {f"g{i}": pytest.approx(111.0) for i in range(1, 10, 2)}
    assert measured == [1]


def test_audited_positions_are_searched_once(spark, land, rows_into):
    searched = rows_into(grids, "close_to_edges")
    line = [(0.5, 0.5), (0.5, 0.6)]
    contours = spark.createDataFrame([(i, line) for i in range(10)], "contour_id int, coordinates array<struct<lon:double,lat:double>>")
    audit = grids.clip_audit(contours, land, epsilon_m=600.0)
    assert "leftHint=(strategy=merge)" in audit._jdf.queryExecution().optimizedPlan().toString()
    bad = audit.groupBy("contour_id").count().collect()
    per_line = grids.contour_samples(contours.limit(1), "contour_id").count()
    assert sorted(map(tuple, bad)) == [(i, per_line) for i in range(10)]
    assert searched == [per_line]


def test_water_is_searched_once_per_position(spark, land, rows_into):
    searched = rows_into(spatial, "depth_inside")
    spots = [(i, 0.05 if i % 2 else -0.5, 0.5) for i in range(10)] + [(10, None, 0.5)]
    points = spark.createDataFrame(spots, "point_id int, longitude double, latitude double")
    got = {r.point_id: r.water_lon for r in spatial.nearest_water(points, land).collect()}
    assert len(got) == 11 and got[10] is None
    assert {got[i] for i in range(0, 10, 2)} == {-0.5}
    assert len({got[i] for i in range(1, 10, 2)}) == 1 and got[1] < 0.0
    assert searched == [1]


def test_circle_rows_are_the_ring(spark):
    rows = spark.createDataFrame([(1, -50.0, 64.0, 300.0), (2, 179.999, 70.0, 0.0)], "k int, lon double, lat double, r double")
    made = spatial.circle_vertices(rows, F.col("lat"), F.col("lon"), F.col("r"))
    ring = rows.select("k", F.posexplode(geo.circle_ring(F.col("lat"), F.col("lon"), F.col("r"))).alias("i", "_v"))
    flat = lambda df: sorted((r.k, r.i, round(r._v.longitude, 9), round(r._v.latitude, 9)) for r in df.select("k", "i", "_v").collect())
    assert flat(made) == flat(ring) and made.count() == 2 * 65
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_rounded_is_round(spark):
    rows = spark.range(20_000).select(((F.col("id") * 7919 - 70_000_000) / 1_000_003.0).alias("v")).unionByName(
        spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (3e15,), (0.0,), (-0.0000004,), (-73.999999,)], "v double")
    )
    same = geo.rounded(F.col("v"), 6).eqNullSafe(F.round("v", 6))
    assert rows.where(~same).select("v", geo.rounded(F.col("v"), 6)).collect() == []
