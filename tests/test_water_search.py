"""Search for water among polygons that lie over each other."""

from __future__ import annotations

import math
import random

from accessgraph.operators import open_squares, spatial, watergrid
from accessgraph.sources.features import polygon_rows

RINGS = "polygon_id long, rings array<array<struct<lon:double,lat:double>>>"


def shapes(n, seed=3):
    """Slanted quadrilaterals with a hole, shifted by less than their size."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        w, s = rng.uniform(0.0, 1.2), rng.uniform(0.0, 1.2)
        outer = [(w, s + 0.1), (w + 1.2, s), (w + 1.1, s + 0.8), (w + 0.2, s + 0.9)]
        out.append([outer, [(w + 0.4, s + 0.3), (w + 0.7, s + 0.24), (w + 0.8, s + 0.6)]])
    return out


def land(spark, made):
    rows = [(i, [[{"lon": x, "lat": y} for x, y in ring] for ring in rings]) for i, rings in enumerate(made)]
    return polygon_rows(spark.createDataFrame(rows, RINGS))


def in_ring(x, y, ring):
    odd = False
    for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]]):
        if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi + 2.220446049250313e-16) + xi:
            odd = not odd
    return odd


def on_land(x, y, made):
    return any(in_ring(x, y, rings[0]) and not any(in_ring(x, y, h) for h in rings[1:]) for rings in made)


def nearest(x, y, made):
    if not on_land(x, y, made):
        return x, y
    for ring in range(1, 44):
        n = max(12, math.ceil(2 * math.pi * ring))
        for k in range(n):
            a = k / n * 2 * math.pi
            spot = x + math.cos(a) * (ring * 0.008), y + math.sin(a) * (ring * 0.008)
            if not on_land(*spot, made):
                return spot
    return None, None


def search(spark, made, spots, **options):
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots)], "point_id int, longitude double, latitude double")
    return {r.point_id: (r.water_lon, r.water_lat) for r in spatial.nearest_water(points, land(spark, made), **options).collect()}


def agree(got, spots, made):
    for i, (x, y) in enumerate(spots):
        want = nearest(x, y, made)
        assert got[i] == want or all(abs(p - q) < 1e-9 for p, q in zip(got[i], want)), i


def test_samples_on_land_of_several_polygons_are_passed_over(spark, monkeypatch):
    made, rng = shapes(14), random.Random(5)
    spots = [(rng.uniform(0.2, 2.0), rng.uniform(0.2, 1.8)) for _ in range(80)]
    met, plain = [], spatial.points_on_cover
    monkeypatch.setattr(spatial, "points_on_cover", lambda df, *a, **k: met.append(df.count()) or plain(df, *a, **k))
    agree(search(spark, made, spots), spots, made)
    dry = sum(on_land(x, y, made) for x, y in spots)
    assert dry > 40 and sum(met[1:]) < 40 * dry


def test_a_search_goes_on_until_no_sample_is_left(spark):
    """One sample a round at first, and land that leaves squares open without any water in them."""
    box = lambda w, s, e, n: [[(w, s), (e, s), (e, n), (w, n)]]
    made = [box(-0.5 + i * 0.0137, -0.5, -0.5 + (i + 1) * 0.0137, 0.5) for i in range(73)] + [box(-0.51, 0.13, 0.51, 0.133)]
    spots = [(0.0, 0.0), (0.003, 0.2), (0.3, 0.0), (-0.41, 0.44), (0.7, 0.0)]
    agree(search(spark, made, spots, most=1), spots, made)


def test_closed_squares_lie_wholly_in_a_polygon(spark):
    made = shapes(9)
    for options in ({}, {"max_edges": 2, "finest": 3}):
        cover = spatial.land_cover(spatial.index_polygons(land(spark, made), **options))
        rows = open_squares.closed_squares(cover, spatial.CELL_DEG).collect()
        size, rng, closed = spatial.CELL_DEG / open_squares.SIDE, random.Random(6), 0
        for r in rows:
            for bit in range(open_squares.SIDE**2):
                if r.words[bit // 64] >> (bit % 64) & 1:
                    closed += 1
                    x = (r.cx * open_squares.SIDE + bit % open_squares.SIDE + rng.random()) * size
                    y = (r.cy * open_squares.SIDE + bit // open_squares.SIDE + rng.random()) * size
                    assert on_land(x, y, made)
        assert len({(r.cx, r.cy) for r in rows}) == len(rows) and closed > 0.7 * 2.0 / size**2


def sea_of(spark, wet):
    """Blocks of a grid with water at ``wet`` (row, col), all links open."""
    cells = spark.createDataFrame(sorted(wet), "row int, col int")
    links = [(r, c, r + a, c + b) for r, c in wet for a, b in ((1, 0), (0, 1)) if (r + a, c + b) in wet]
    return cells, watergrid.grid_blocks(cells, spark.createDataFrame(links, "row int, col int, to_row int, to_col int"))


def test_seas_reach_over_blocks(spark):
    """A snake over several blocks is one sea, and what only touches it at a corner is another."""
    last = 3 * watergrid.BLOCK - 1
    wet = {(r, c) for r in range(0, last, 4) for c in range(last)}
    wet |= {(r + d, 0 if r % 8 else last - 1) for r in range(0, last - 4, 4) for d in (1, 2, 3)}
    alone = {(2, 2), (2, 3)}
    _, blocks = sea_of(spark, wet | alone)
    found = {(r.row, r.col): r.sea for r in watergrid.water_parts(blocks).collect()}
    assert found.keys() == wet | alone
    assert len({found[c] for c in wet}) == 1 and len({found[c] for c in alone}) == 1
    assert found[2, 2] != found[0, 0]


def test_routes_without_a_way_are_not_spread(spark, monkeypatch):
    """Only ends in one sea are routed, and rows of routes are dealt over the tasks."""
    grid = watergrid.grid_over((0.0, 0.0, 4.0, 4.0), 0.1)
    box = lambda w, s, e, n: [[(w, s), (e, s), (e, n), (w, n)]]
    polygons = land(spark, [box(1.95, -1.0, 2.05, 5.0)])
    index = spatial.index_polygons(polygons)
    cells = watergrid.water_cells(spark, grid, index).select("row", "col")
    blocks = watergrid.grid_blocks(cells, watergrid.water_links(cells, grid, index))
    pairs = spark.createDataFrame(
        [("over", 1.0, 1.0, 3.0, 1.0), ("west", 0.5, 0.5, 1.5, 2.5)], "od_id string, from_lon double, from_lat double, to_lon double, to_lat double"
    )
    spread, plain = [], watergrid.water_cost_distance
    monkeypatch.setattr(watergrid, "water_cost_distance", lambda b, sources, g: spread.append(sources.count()) or plain(b, sources, g))
    got = {(r.od_id, r.bias): r["mode"] for r in watergrid.plan_routes(pairs, grid, cells, blocks, polygons).collect()}
    assert got["over", "shortest"] == "straight-fallback" and got["west", "shortest"] == "water"
    assert spread == [len(watergrid.BIASES)]


def test_sizes_do_not_grow_with_the_rounds(spark):
    """A checkpoint keeps a guessed size; guesses of each round would multiply."""
    wet = {(r, c) for r in range(4) for c in range(6 * watergrid.BLOCK)}
    _, blocks = sea_of(spark, wet)
    grid = watergrid.WaterGrid(0.0, 0.0, 0.1, 0.1, 4, 6 * watergrid.BLOCK)
    sources = spark.createDataFrame([("a", 0, 0, 0.0, "shortest")], "route_id string, row int, col int, mid_lat double, bias string")
    state = watergrid.water_cost_distance(blocks, sources, grid)
    assert state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200
    assert watergrid.cell_costs(state).agg({"cost": "max"}).first()[0] == 100 * (6 * watergrid.BLOCK - 1 + 3)
