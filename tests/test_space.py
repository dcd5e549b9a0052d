import heapq
import math
import random

from pyspark.sql import functions as F

from accessgraph.operators import grids, spatial, watergrid
from accessgraph.sources.features import polygon_rows, read_land_polygons

RINGS = "polygon_id string, rings array<array<struct<lon:double,lat:double>>>"


def polygons(spark, shapes):
    rows = [(str(i), [[{"lon": float(x), "lat": float(y)} for x, y in ring] for ring in rings]) for i, rings in enumerate(shapes)]
    return polygon_rows(spark.createDataFrame(rows, RINGS))


def in_ring(x, y, ring):
    odd = False
    for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]]):
        if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi + 2.220446049250313e-16) + xi:
            odd = not odd
    return odd


def on_land(x, y, shapes):
    return any(in_ring(x, y, rings[0]) and not any(in_ring(x, y, h) for h in rings[1:]) for rings in shapes)


def stars(seed=2, n=12):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        cx, cy = rng.uniform(-3, 3), rng.uniform(-3, 3)
        ring = [
            (cx + rng.uniform(0.3, 1.2) * math.cos(a * math.pi / 6), cy + rng.uniform(0.3, 1.2) * math.sin(a * math.pi / 6))
            for a in range(12)
        ]
        hole = [(cx + 0.2 * math.cos(a * math.pi / 2), cy + 0.2 * math.sin(a * math.pi / 2)) for a in range(4)]
        out.append([ring, hole])
    return out


def test_points_match_ray_casting(spark):
    shapes, rng = stars(), random.Random(4)
    spots = [(i, rng.uniform(-4, 4), rng.uniform(-4, 4)) for i in range(3000)]
    points = spark.createDataFrame(spots, "id int, longitude double, latitude double")
    index = spatial.index_polygons(polygons(spark, shapes))
    got = {r["id"] for r in spatial.points_on_land(points, index).collect()}
    assert got == {i for i, x, y in spots if on_land(x, y, shapes)}
    off = {r["id"] for r in spatial.points_on_land(points, index, off=True).collect()}
    assert off == {i for i, _, _ in spots} - got


def test_nearest_water_matches_ring_search(spark):
    shapes, rng = stars(7, 6), random.Random(8)
    spots = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(60)]
    points = spark.createDataFrame(spots, "point_id int, longitude double, latitude double")
    got = {r["point_id"]: (r["water_lon"], r["water_lat"]) for r in spatial.nearest_water(points, polygons(spark, shapes)).collect()}
    assert set(got) == {i for i, _, _ in spots}
    for i, x, y in spots:
        want = (x, y)
        if on_land(x, y, shapes):
            want = next(
                (
                    (x + math.cos(a) * ring * 0.008, y + math.sin(a) * ring * 0.008)
                    for ring in range(1, 44)
                    for n in [max(12, math.ceil(2 * math.pi * ring))]
                    for a in [k / n * 2 * math.pi for k in range(n)]
                    if not on_land(x + math.cos(a) * ring * 0.008, y + math.sin(a) * ring * 0.008, shapes)
                ),
                (None, None),
            )
        assert got[i] == want or all(abs(p - q) < 1e-9 for p, q in zip(got[i], want)), i


def test_distance_to_far_edges_is_exact(spark):
    shapes = [[[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]]]
    spots = [("near", 1.1, 0.5), ("far", 30.0, 0.5), ("corner", -3.0, -4.0)]
    points = spark.createDataFrame(spots, "k string, longitude double, latitude double")
    edges = spatial.polygon_edges(polygons(spark, shapes))
    got = {r["k"]: r["distance_deg"] for r in spatial.distance_to_edges(points, edges, "k").collect()}
    assert all(abs(got[k] - v) < 1e-9 for k, v in {"near": 0.1, "far": 29.0, "corner": 5.0}.items())


def test_segments_and_paths(spark):
    index = spatial.index_polygons(polygons(spark, [[[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]]]))
    segments = spark.createDataFrame([("a", -1.0, 0.5, 2.0, 0.5), ("b", -1.0, 2.0, 2.0, 2.0)], "segment_id string, x1 double, y1 double, x2 double, y2 double")
    got = {r["segment_id"]: r["crosses_land"] for r in spatial.segments_on_land(segments, index).collect()}
    assert got == {"a": True, "b": False}
    path = [{"lon": x, "lat": y} for x, y in ((0.5, 0.5), (2.0, 2.0), (3.0, 2.0), (0.5, 0.5))]
    paths = spark.createDataFrame([("p", path)], "path_id string, coordinates array<struct<lon:double,lat:double>>")
    assert not spatial.paths_on_land(paths, index).first()["crosses_land"]
    assert spatial.paths_on_land(paths, index, exempt_ends=False).first()["crosses_land"]


def test_cost_distance_and_routes(spark):
    wall = [[[(0.9, -0.5), (1.1, -0.5), (1.1, 1.5), (0.9, 1.5), (0.9, -0.5)]]]
    land = polygons(spark, wall)
    index = spatial.index_polygons(land)
    grid = watergrid.grid_over((0, 0, 2, 1), 0.04, pad=0.8)
    cells = watergrid.cut_lineage(watergrid.water_cells(spark, grid, index).select("row", "col"))
    links = watergrid.cut_lineage(watergrid.water_links(cells, grid, index))
    blocks = watergrid.cut_lineage(watergrid.grid_blocks(cells, links))
    sources = spark.createDataFrame([("n", 5, 5, 0.5, "north"), ("s", 5, 70, 0.5, "shortest")], "route_id string, row int, col int, mid_lat double, bias string")
    state = watergrid.water_cost_distance(blocks, sources, grid)
    got = {(r["route_id"], r["row"], r["col"]): r["cost"] for r in watergrid.cell_costs(state).collect()}
    near = {}
    for r in links.collect():
        a, b = (r["row"], r["col"]), (r["to_row"], r["to_col"])
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    want = {}
    for route, start, bias in (("n", (5, 5), "north"), ("s", (5, 70), "shortest")):
        best, heap = {start: 0}, [(0, start)]
        while heap:
            c, at = heapq.heappop(heap)
            if c > best[at]:
                continue
            for n in near.get(at, []):
                lat = grid.south + n[0] * grid.dlat
                step = 100 if bias == "shortest" else (155 if lat - 0.5 < 0 else 92)
                if c + step < best.get(n, math.inf):
                    best[n] = c + step
                    heapq.heappush(heap, (c + step, n))
        want.update({(route, *k): v for k, v in best.items()})
    assert got == want

    pairs = spark.createDataFrame([("a", 0.2, 0.5, 1.8, 0.5), ("b", 1.0, 0.5, 1.9, 0.2)], "od_id string, from_lon double, from_lat double, to_lon double, to_lat double")
    routes = watergrid.plan_routes(pairs, grid, cells, blocks, land).collect()
    first = [r for r in routes if r["od_id"] == "a"]
    assert len(first) == 2 and all(r["mode"] == "water" for r in routes)
    lats = [[c["lat"] for c in r["coordinates"]] for r in first]
    assert any(max(v) > 1.4 for v in lats) and any(min(v) < -0.45 for v in lats)


def test_no_water_gives_the_straight_line(spark):
    land = polygons(spark, [[[(-5, -5), (5, -5), (5, 5), (-5, 5), (-5, -5)]]])
    grid = watergrid.grid_over((0, 0, 1, 1), 0.1)
    cells = watergrid.water_cells(spark, grid, spatial.index_polygons(land)).select("row", "col")
    blocks = watergrid.grid_blocks(cells, watergrid.water_links(cells, grid, spatial.index_polygons(land)))
    pairs = spark.createDataFrame([("a", 0.2, 0.5, 0.8, 0.5)], "od_id string, from_lon double, from_lat double, to_lon double, to_lat double")
    got = watergrid.plan_routes(pairs, grid, cells, blocks, land).collect()
    assert [r["mode"] for r in got] == ["straight-fallback"]


def test_connected_patches_match_flood_fill(spark):
    rng = random.Random(6)
    cells = {(r, c) for r in range(25) for c in range(25) if rng.random() < 0.6}
    got = grids.connected_patches(spark.createDataFrame(sorted(cells), "row int, col int")).collect()
    label, left = {}, set(cells)
    while left:
        root = min(left)
        stack, seen = [root], {root}
        while stack:
            r, c = stack.pop()
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left and n not in seen:
                    seen.add(n)
                    stack.append(n)
        left -= seen
        label.update({s: min(seen) for s in seen})
    assert {(r["row"], r["col"]): tuple(r["patch"]) for r in got} == label


def test_elevation_quadrants_and_peaks(spark):
    def pixels(x, *values):
        return [(5, x, 0, float(v)) for v in values]

    df = spark.createDataFrame(pixels(0, 100, 400, 600, 2600) + pixels(1, 10, 499), "z int, x int, y int, elev double")
    assert [r["x"] for r in grids.peak_tiles(df).collect()] == [0]
    bands = [r[0]["band"] if r[0] else None for r in df.where("x = 0").orderBy("elev").select(grids.peak_band(F.col("elev"))).collect()]
    assert bands == [None, None, 500, 2500]
    pyramid = grids.peak_pyramid(df, 5, 6)
    assert {tuple(r) for r in pyramid.collect()} == {(5, 0, 0), (6, 0, 0), (6, 0, 1), (6, 1, 0), (6, 1, 1)}


def test_land_feature_texts(spark):
    square = "[[0,0],[1,0],[1,1],[0,1],[0,0]]"
    rows = [
        f'{{"properties":{{"kind":"land"}},"geometry":{{"type":"Polygon","coordinates":[{square}]}}}}',
        f'{{"properties":{{"kind":"lake"}},"geometry":{{"type":"Polygon","coordinates":[{square}]}}}}',
        '{"properties":{},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,1],[0,0]]]}}',
        f'{{"properties":null,"geometry":{{"type":"GeometryCollection","geometries":[{{"type":"MultiPolygon","coordinates":[[{square}],[{square}]]}}]}}}}',
    ]
    got = read_land_polygons(spark.createDataFrame([(r,) for r in rows], "value string"))
    assert got.count() == 3


def check_points(spark, shapes, land, seed=4, n=3000, **settings):
    rng = random.Random(seed)
    spots = [(i, rng.uniform(-4, 4), rng.uniform(-4, 4)) for i in range(n)]
    points = spark.createDataFrame(spots, "id int, longitude double, latitude double")
    index = spatial.index_polygons(land, **settings)
    got = {r["id"] for r in spatial.points_on_land(points, index).collect()}
    assert got == {i for i, x, y in spots if on_land(x, y, shapes)}
    return index


def test_repeated_and_overlapping_polygons(spark):
    shapes = stars(3, 8)
    land = polygons(spark, shapes)
    check_points(spark, shapes, land.unionByName(land).unionByName(land))
    shifted = [[[(x + 0.2, y + 0.1) for x, y in ring] for ring in rings] for rings in shapes]
    check_points(spark, shapes + shifted, polygons(spark, shapes + shifted))
    # One id with two shapes is land where either is.
    check_points(spark, shapes + shifted, land.unionByName(polygons(spark, shifted)))


def test_dense_cells_are_split_and_full_cells_merged(spark):
    coast = [(3 * math.cos(a / 400 * math.pi) * (1 + 0.02 * (a % 2)), 3 * math.sin(a / 400 * math.pi)) for a in range(800)]
    lakes = [[(x + 0.01 * math.cos(a), y + 0.01 * math.sin(a)) for a in range(6)] for x in (0.5, 0.53, 0.56) for y in (0.5, 0.53)]
    shapes = [[coast, *lakes], *stars(5, 3)]
    index = check_points(spark, shapes, polygons(spark, shapes), max_edges=6)
    edges = F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r["edges"]))
    most, finest, coarsest = index.agg(F.max(edges), F.max("scale"), F.min("scale")).first()
    assert most <= 6 and finest > 1 and coarsest < 1
    plain = check_points(spark, shapes, polygons(spark, shapes), max_edges=10_000, coarsest=0)
    assert plain.agg(F.max(edges)).first()[0] > 6 and plain.select("scale").distinct().count() == 1


def test_many_edges_in_one_point_stop_at_the_finest_cells(spark):
    fan = [(0.0, 0.0) if i % 2 else (math.cos(i * 0.05), math.sin(i * 0.05)) for i in range(60)]
    index = check_points(spark, [[fan]], polygons(spark, [[fan]]), max_edges=8, finest=3)
    assert index.agg(F.max("scale")).first()[0] == 8.0


def test_no_polygons_are_no_land(spark):
    empty = spatial.index_polygons(polygons(spark, []))
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id int, longitude double, latitude double")
    assert spatial.points_on_land(points, empty).count() == 0 and spatial.points_on_land(points, empty, off=True).count() == 1


def test_collections_open_to_any_depth(spark):
    square = lambda x: f'{{"type": "Polygon", "coordinates": [[[{x}, 0], [{x + 1}, 0], [{x + 1}, 1], [{x}, 1], [{x}, 0]]]}}'
    collect = lambda *parts: '{"type": "GeometryCollection", "geometries": [' + ", ".join(parts) + "]}"
    deep = collect(square(0), collect(square(2), collect(square(4), collect())))
    wide = collect(*[collect(square(10 + 2 * i)) for i in range(60)])
    texts = [f'{{"type": "Feature", "properties": {{"note": "GeometryCollection"}}, "geometry": {g}}}' for g in (deep, wide, square(200))]
    rows = read_land_polygons(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    assert sorted(r["west"] for r in rows) == sorted([0, 2, 4, 200, *range(10, 130, 2)])
