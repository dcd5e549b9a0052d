"""Sides that grow by an explode are merged: Catalyst takes them for one row per row and would broadcast them."""

from __future__ import annotations

from pyspark.sql import functions as F

from accessgraph.operators import clipping, gazetteer, search, spatial
from accessgraph.sources.features import polygon_rows


def test_shadow_forms_are_not_broadcast(spark):
    rows = spark.createDataFrame(
        [("a", 21, 956, -50.0, 64.0, "Nuuk"), ("b", 49, 956, -40.0, 70.0, "Nuuk"), ("c", 49, 957, -50.01, 64.01, "Nuk"), ("d", 49, 957, -20.0, 80.0, "Nuuk")],
        "global_id string, type_code int, municipality_code int, longitude double, latitude double, official_name string",
    )
    flagged = gazetteer.flag_shadows(gazetteer.classify_features(rows))
    forms = flagged._jdf.queryExecution().optimizedPlan().toString()
    assert forms.count("LeftSemi") == 2 and forms.count("rightHint=(strategy=merge)") == 2
    found = flagged.where(F.col("is_locality_shadow")).select("global_id").collect()
    assert {r[0] for r in found} == {"b", "c"}


def test_hits_are_scored_per_query_text(spark):
    """Rows, which compress well, are merged, and the queries join after the hits are cut."""
    places = spark.createDataFrame(
        [("a", "Nuuk", True), ("b", "Nuuk Fjord", False)], "global_id string, official_name string, is_locality boolean"
    ).selectExpr(
        "*", "cast(null as string) danish_name", "cast(null as string) old_official_name", "false is_locality_shadow",
        "if(is_locality, 'town', 'other') feature_kind", "500 importance",
    )
    asked = spark.createDataFrame([(i, "nuuk") for i in range(5)], "query_id int, q string")
    hits = search.rank_search(places, asked, 1)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 2
    assert "windowspecdefinition(q#" in plan
    assert sorted((r.query_id, r.global_id, r.position) for r in hits.collect()) == [(i, "a", 1) for i in range(5)]


def test_cover_does_not_grow_with_repeated_land(spark):
    """Many polygons over each other: a cell wholly on land counts once, and the answer stays."""
    box = lambda w, s: [[{"lon": w, "lat": s}, {"lon": w + 2.1, "lat": s}, {"lon": w + 2.1, "lat": s + 2.1}, {"lon": w, "lat": s + 2.1}]]

    def land(n):
        rows = [(i, box(-50.0 + 0.05 * i, 60.0 + 0.05 * i)) for i in range(n)]
        return polygon_rows(spark.createDataFrame(rows, "polygon_id long, rings array<array<struct<lon:double,lat:double>>>"))

    points = spark.createDataFrame([(i, -50.5 + i * 0.07, 61.0) for i in range(60)], "i int, longitude double, latitude double")
    index = spatial.index_polygons(land(20))
    cover = spatial.land_cover(index)
    assert cover.count() < index.count()
    whole = cover.where("forall(rings, r -> size(r.edges) = 0)")
    assert whole.count() == whole.select("scale", "cx", "cy").distinct().count()
    found = {r.i for r in spatial.points_on_land(points, index).collect()}
    assert found == {i for i in range(60) if -50.0 < -50.5 + i * 0.07 < -50.0 + 0.95 + 2.1}


def test_shore_cells_are_not_broadcast(spark, monkeypatch):
    joined = []
    plain = clipping._listed
    monkeypatch.setattr(clipping, "_listed", lambda *a: joined.append(plain(*a)) or joined[-1])
    rows = [(1, [[{"lon": -50.0, "lat": 60.0}, {"lon": -49.0, "lat": 60.0}, {"lon": -49.0, "lat": 61.0}, {"lon": -50.0, "lat": 61.0}]])]
    land = polygon_rows(spark.createDataFrame(rows, "polygon_id long, rings array<array<struct<lon:double,lat:double>>>"))
    line = spark.createDataFrame(
        [(1, [{"lon": -50.5, "lat": 60.3}, {"lon": -48.5, "lat": 60.3}])], "contour_id int, coordinates array<struct<lon:double,lat:double>>"
    )
    hints = []
    frame = type(line)
    monkeypatch.setattr(frame, "hint", lambda self, name, real=frame.hint: hints.append((name, "_cx" in self.columns)) or real(self, name))
    pieces = clipping.cut_pieces(line, land)
    assert ("merge", True) in hints and len(joined) == 2
    assert [(r.on_land) for r in pieces.orderBy("t0").collect()] == [False, True, False]
