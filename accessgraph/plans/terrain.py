"""Queries over land polygons, routes, grids and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from accessgraph.functions import geo
from accessgraph.operators import clipping, contours, gazetteer, grids, spatial, watergrid
from accessgraph.plans.movement import sql_haversine
from accessgraph.plans.registry import query
from accessgraph.plans.views import base, view
from accessgraph.sources.features import polygon_rows

BOX = (-60.0, 62.0, -40.0, 76.0)


def _land(spark, sf):
    """A slanted four-sided polygon with a three-sided hole per supplier."""
    at = lambda dx, dy: F.struct((F.col("w") + dx).alias("lon"), (F.col("s") + dy).alias("lat"))
    ring = lambda *corners: F.array(*[at(dx, dy) for dx, dy in corners])
    outer = ring((0.0, 0.1), (1.2, 0.0), (1.1, 0.8), (0.2, 0.9))
    hole = ring((0.4, 0.3), (0.7, 0.24), (0.8, 0.6))
    return polygon_rows(view(spark, sf, "v_land").select("polygon_id", F.array(outer, hole).alias("rings")))


def _index(spark, sf):
    return spatial.index_polygons(_land(spark, sf))


def _spots(spark, sf):
    k = F.col("event_id")
    return base(spark, sf, "events").select(
        "event_id",
        (F.lit(-74.0) + ((k * 7919) % 60000).cast("double") / 1000.0).alias("longitude"),
        (F.lit(59.0) + ((k * 104729) % 24000).cast("double") / 1000.0).alias("latitude"),
    )


SQL_SPOTS = """SELECT event_id, -74.0 + CAST((event_id * 7919) % 60000 AS DOUBLE) / 1000.0 AS longitude,
    59.0 + CAST((event_id * 104729) % 24000 AS DOUBLE) / 1000.0 AS latitude FROM events"""


def sql_land(rows: str, keys: str, lon: str = "longitude", lat: str = "latitude") -> str:
    """Distinct keys of the rows whose point is on land: crossings counted per point, polygon and ring."""
    return f"""SELECT DISTINCT {keys} FROM (
        SELECT {keys}, nth, polygon_id, bool_or(side = 0 AND n % 2 = 1) AND NOT bool_or(side = 1 AND n % 2 = 1) AS inside FROM (
          SELECT {', '.join('p.' + k.strip() for k in keys.split(','))}, p.nth, e.polygon_id, e.ring AS side, count(*) AS n
          FROM (SELECT *, row_number() OVER () AS nth FROM ({rows})) p
          JOIN v_land l ON p.{lon} BETWEEN l.w AND l.w + 1.2 AND p.{lat} BETWEEN l.s AND l.s + 0.9
          JOIN v_land_edges e ON e.polygon_id = l.polygon_id AND (e.y1 > p.{lat}) <> (e.y2 > p.{lat})
               AND p.{lon} < (e.x2 - e.x1) * (p.{lat} - e.y1) / (e.y2 - e.y1 + 2.220446049250313e-16) + e.x1
          GROUP BY ALL) GROUP BY ALL) WHERE inside"""


@query(
    "i1_i3_distance_and_bearing",
    f"""SELECT record_id, round({sql_haversine('latitude', 'longitude', '64.18', '-51.72')}, 2) AS metres,
          round((degrees(atan2(sin(radians(-51.72 - longitude)) * cos(radians(64.18)), cos(radians(latitude)) * sin(radians(64.18))
            - sin(radians(latitude)) * cos(radians(64.18)) * cos(radians(-51.72 - longitude)))) + 360) % 360, 6) AS bearing FROM v_features""",
)
def _(spark, sf):
    lat, lon = F.lit(64.18), F.lit(-51.72)
    a = (F.col("latitude"), F.col("longitude"), lat, lon)
    return view(spark, sf, "v_features").select(
        "record_id", F.round(geo.haversine_m(*a), 2).alias("metres"), F.round(geo.bearing_deg(*a), 6).alias("bearing")
    )


SQL_RING_Y = "asin(sin(radians(latitude)) * cos(d) + cos(radians(latitude)) * sin(d) * cos(radians(b)))"


@query(
    "i2_accuracy_circles",
    f"""SELECT record_id, i, round(degrees(y), 6) AS y, round(longitude + degrees(atan2(sin(radians(b)) * sin(d) * cos(radians(latitude)),
             cos(d) - sin(radians(latitude)) * sin(y))), 6) AS x
        FROM (SELECT *, {SQL_RING_Y} AS y FROM (SELECT *, greatest(record_id % 500, 1) / 6371000.0::DOUBLE AS d, i * 360.0::DOUBLE / 64 AS b
              FROM v_features, (SELECT unnest(range(0, 65))::INT AS i)))""",
)
def _(spark, sf):
    """All vertices of the ring around every feature."""
    features = view(spark, sf, "v_features").withColumn("_radius", (F.col("record_id") % 500).cast("double"))
    rows = spatial.circle_vertices(features, F.col("latitude"), F.col("longitude"), F.col("_radius"))
    return rows.select("record_id", "i", geo.rounded(F.col("_v.latitude"), 6).alias("y"), geo.rounded(F.col("_v.longitude"), 6).alias("x"))


@query(
    "i4_near_localities",
    """SELECT record_id FROM v_features f WHERE type_code NOT IN (21, 23) AND EXISTS (SELECT 1 FROM v_features l WHERE l.type_code IN (21, 23)
         AND (f.longitude - l.longitude) * (f.longitude - l.longitude) + (f.latitude - l.latitude) * (f.latitude - l.latitude) <= 0.2 * 0.2)""",
)
def _(spark, sf):
    rows = view(spark, sf, "v_features")
    local = gazetteer.is_locality_type(F.col("type_code"))
    return spatial.near_points(rows.where(~local), rows.where(local), 0.2).select("record_id")


@query(
    "i5_boxes",
    f"""SELECT 'points' AS t, count(*) AS n FROM v_features WHERE longitude BETWEEN {BOX[0]} AND {BOX[2]} AND latitude BETWEEN {BOX[1]} AND {BOX[3]}
        UNION ALL SELECT 'polygons', count(*) FROM v_land WHERE w + 1.2 >= {BOX[0]} AND w <= {BOX[2]} AND s + 0.9 >= {BOX[1]} AND s <= {BOX[3]}""",
)
def _(spark, sf):
    n = F.count(F.lit(1)).alias("n")
    inside = view(spark, sf, "v_features").where(geo.in_bbox(F.col("longitude"), F.col("latitude"), BOX))
    met = spatial.polygons_in_bbox(_land(spark, sf), BOX)
    return inside.agg(n).select(F.lit("points").alias("t"), "n").unionByName(met.agg(n).select(F.lit("polygons").alias("t"), "n"))


@query(
    "i6_polygon_cells",
    """WITH box AS (SELECT polygon_id, unnest(range(CAST(floor(w / 0.25) AS BIGINT), CAST(floor((w + 1.2) / 0.25) AS BIGINT) + 1)) AS cx, s FROM v_land),
         cell AS (SELECT polygon_id, cx, cy FROM box, LATERAL (SELECT unnest(range(CAST(floor(s / 0.25) AS BIGINT), CAST(floor((s + 0.9) / 0.25) AS BIGINT) + 1)) AS cy)),
         crossed AS (SELECT c.polygon_id, cx, cy FROM cell c JOIN v_land_edges e ON e.polygon_id = c.polygon_id
           AND cx BETWEEN floor(least(x1, x2) / 0.25) AND floor(greatest(x1, x2) / 0.25)
           AND cy BETWEEN floor(least(y1, y2) / 0.25) AND floor(greatest(y1, y2) / 0.25)),
         filled AS (SELECT c.polygon_id, cx, cy FROM cell c JOIN v_land_edges e ON e.polygon_id = c.polygon_id AND e.ring = 0
           AND (y1 > (cy + 0.5) * 0.25) <> (y2 > (cy + 0.5) * 0.25)
           AND (cx + 0.5) * 0.25 < (x2 - x1) * ((cy + 0.5) * 0.25 - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)
       SELECT polygon_id, count(*) AS cells FROM (SELECT * FROM crossed UNION SELECT * FROM filled) GROUP BY polygon_id""",
)
def _(spark, sf):
    """Cells of one size."""
    return spatial.index_polygons(_land(spark, sf), coarsest=0).groupBy("polygon_id").agg(F.count("*").alias("cells"))


@query(
    "i6_cells_wholly_on_land",
    f"""WITH box AS (SELECT polygon_id, unnest(range(CAST(floor(w / 0.25) AS BIGINT), CAST(floor((w + 1.2) / 0.25) AS BIGINT) + 1)) AS cx, s FROM v_land),
         cell AS (SELECT polygon_id, cx, cy FROM box, LATERAL (SELECT unnest(range(CAST(floor(s / 0.25) AS BIGINT), CAST(floor((s + 0.9) / 0.25) AS BIGINT) + 1)) AS cy)),
         crossed AS (SELECT c.polygon_id, cx, cy FROM cell c JOIN v_land_edges e ON e.polygon_id = c.polygon_id
           AND cx BETWEEN floor(least(x1, x2) / 0.25) AND floor(greatest(x1, x2) / 0.25)
           AND cy BETWEEN floor(least(y1, y2) / 0.25) AND floor(greatest(y1, y2) / 0.25)),
         mid AS (SELECT polygon_id, cx, cy, (cx + 0.5) * 0.25 AS longitude, (cy + 0.5) * 0.25 AS latitude FROM cell)
       SELECT cx, cy, count(*) AS polygons FROM (SELECT polygon_id, cx, cy FROM cell EXCEPT SELECT * FROM crossed) c
       WHERE (polygon_id, cx, cy) IN (SELECT m.polygon_id, cx, cy FROM mid m JOIN v_land_edges e ON e.polygon_id = m.polygon_id AND e.ring = 0
           AND (y1 > latitude) <> (y2 > latitude) AND longitude < (x2 - x1) * (latitude - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)
         AND (polygon_id, cx, cy) NOT IN (SELECT m.polygon_id, cx, cy FROM mid m JOIN v_land_edges e ON e.polygon_id = m.polygon_id AND e.ring = 1
           AND (y1 > latitude) <> (y2 > latitude) AND longitude < (x2 - x1) * (latitude - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)
       GROUP BY cx, cy""",
)
def _(spark, sf):
    """Merged squares of the quadtree, spread to the cells they fill."""
    squares = _index(spark, sf).where((F.col("scale") <= 1) & ~F.exists("rings", lambda r: F.size(r["edges"]) > 0))
    side = (1 / F.col("scale")).cast("long")
    cells = lambda c: F.explode(F.sequence(F.col(c) * side, F.col(c) * side + side - 1))
    spread = squares.select("scale", cells("cx").alias("_x"), "cy").select("_x", cells("cy").alias("_y"))
    return spread.groupBy(F.col("_x").alias("cx"), F.col("_y").alias("cy")).agg(F.count("*").alias("polygons"))


def _repeated_land(spark, sf):
    """Every third polygon twice, every sixth once more with another id."""
    land = _land(spark, sf)
    again = land.where("polygon_id % 3 = 0")
    return land.unionByName(again).unionByName(again.where("polygon_id % 6 = 0").withColumn("polygon_id", -F.col("polygon_id")))


@query("i7_points_on_repeated_land", sql_land(SQL_SPOTS, "event_id"))
def _(spark, sf):
    return spatial.points_on_land(_spots(spark, sf), spatial.index_polygons(_repeated_land(spark, sf))).select("event_id")


@query("i7_points_on_split_land", sql_land(SQL_SPOTS, "event_id"))
def _(spark, sf):
    """The same from cells of two edges at most, where they can be split so far."""
    return spatial.points_on_land(_spots(spark, sf), spatial.index_polygons(_land(spark, sf), max_edges=2, finest=4)).select("event_id")


@query("i7_points_on_land", sql_land(SQL_SPOTS, "event_id"))
def _(spark, sf):
    return spatial.points_on_land(_spots(spark, sf), _index(spark, sf)).select("event_id")


def _segments(spark, sf):
    return view(spark, sf, "v_features").select(
        F.col("record_id").alias("segment_id"),
        F.col("longitude").alias("x1"),
        F.col("latitude").alias("y1"),
        (F.col("longitude") + 0.3).alias("x2"),
        (F.col("latitude") + 0.11).alias("y2"),
    )


SQL_SAMPLES = """SELECT record_id, x1 + (x2 - x1) * (i / steps) AS longitude, y1 + (y2 - y1) * (i / steps) AS latitude FROM (
    SELECT *, unnest(range(0, CAST(steps AS BIGINT) + 1)) AS i FROM (SELECT *, greatest(2, ceil(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) / 0.004)) AS steps
    FROM ({0})))"""
SQL_SEGMENTS = "SELECT record_id, longitude AS x1, latitude AS y1, longitude + 0.3 AS x2, latitude + 0.11 AS y2 FROM v_features"


@query(
    "i8_segments_on_land",
    f"""SELECT record_id AS segment_id, record_id IN ({sql_land(SQL_SAMPLES.format(SQL_SEGMENTS), 'record_id')}) AS crosses_land FROM v_features""",
)
def _(spark, sf):
    return spatial.segments_on_land(_segments(spark, sf), _index(spark, sf)).select("segment_id", "crosses_land")


# Four hops in a stair; the first and last one are exempt.
STAIR = ((0.0, 0.0), (0.3, 0.05), (0.5, 0.25), (0.9, 0.3), (1.2, 0.5))


def _paths(spark, sf, dx: float = 0.0):
    corners = F.array(
        *[F.struct((F.col("longitude") + x + dx).alias("lon"), (F.col("latitude") + y).alias("lat")) for x, y in STAIR]
    )
    return view(spark, sf, "v_features").select(F.col("record_id").alias("path_id"), corners.alias("coordinates"))


SQL_STAIR = " UNION ALL ".join(
    f"SELECT record_id, longitude + {a[0]} AS x1, latitude + {a[1]} AS y1, longitude + {b[0]} AS x2, latitude + {b[1]} AS y2 FROM v_features"
    for a, b in zip(STAIR[1:-2], STAIR[2:-1])
)


@query(
    "i9_paths_on_land",
    f"SELECT record_id AS path_id, record_id IN ({sql_land(SQL_SAMPLES.format(SQL_STAIR), 'record_id')}) AS crosses_land FROM v_features",
)
def _(spark, sf):
    return spatial.paths_on_land(_paths(spark, sf), _index(spark, sf))


@query(
    "i10_path_lengths",
    "SELECT record_id AS path_id, round("
    + " + ".join(
        sql_haversine(f"latitude + {a[1]}", f"longitude + {a[0]}", f"latitude + {b[1]}", f"longitude + {b[0]}") for a, b in zip(STAIR, STAIR[1:])
    )
    + ", 2) AS length_m FROM v_features",
)
def _(spark, sf):
    return spatial.path_length(_paths(spark, sf)).withColumn("length_m", F.round("length_m", 2))


SQL_RINGS = f"""SELECT event_id, rg, i, longitude + cos(i / n * 2 * pi()) * (rg * 0.008) AS lon2, latitude + sin(i / n * 2 * pi()) * (rg * 0.008) AS lat2
    FROM (SELECT *, unnest(range(0, CAST(n AS BIGINT))) AS i FROM (SELECT *, CAST(greatest(12, ceil(2 * pi() * rg)) AS DOUBLE) AS n FROM (
      SELECT s.event_id, s.longitude, s.latitude, unnest(range(1, 44)) AS rg FROM ({SQL_SPOTS}) s JOIN ({sql_land(SQL_SPOTS, 'event_id')}) l ON l.event_id = s.event_id)))"""


@query(
    "i11_nearest_water",
    f"""WITH samples AS MATERIALIZED ({SQL_RINGS}), dry AS MATERIALIZED ({sql_land('SELECT * FROM samples', 'event_id, rg, i', 'lon2', 'lat2')}),
          wet AS (SELECT event_id, arg_min(lon2, rg * 1000 + i) AS x, arg_min(lat2, rg * 1000 + i) AS y FROM samples
                  WHERE (event_id, rg, i) NOT IN (SELECT event_id, rg, i FROM dry) GROUP BY event_id),
          land AS ({sql_land(SQL_SPOTS, 'event_id')})
        SELECT s.event_id, round(CASE WHEN l.event_id IS NULL THEN s.longitude ELSE w.x END, 6) AS x,
               round(CASE WHEN l.event_id IS NULL THEN s.latitude ELSE w.y END, 6) AS y
        FROM ({SQL_SPOTS}) s LEFT JOIN land l ON l.event_id = s.event_id LEFT JOIN wet w ON w.event_id = s.event_id""",
)
def _(spark, sf):
    found = spatial.nearest_water(_spots(spark, sf), _land(spark, sf), "event_id")
    return found.select("event_id", F.round("water_lon", 6).alias("x"), F.round("water_lat", 6).alias("y"))


@query(
    "i12_distinct_paths",
    """SELECT record_id AS path_id, record_id % 11 <> 0 AND greatest(gap(1), gap(2), gap(3)) > 0.08 AS apart FROM v_features""".replace(
        "gap(1), gap(2), gap(3)",
        ", ".join(f"sqrt(power((record_id + {3 * i}) % 5 * 0.017, 2) + power((record_id + {i}) % 7 * 0.0105, 2))" for i in (1, 2, 3)),
    ),
)
def _(spark, sf):
    """Every vertex moves by its own amount; every eleventh path keeps one vertex only."""
    k = F.col("path_id")
    moved = F.transform(
        "coordinates",
        lambda c, i: F.struct((c["lon"] + (k + i * 3) % 5 * 0.017).alias("lon"), (c["lat"] + (k + i) % 7 * 0.0105).alias("lat")),
    )
    other = F.when(k % 11 == 0, F.slice(moved, 1, 1)).otherwise(moved)
    return _paths(spark, sf).select("path_id", spatial.paths_distinct(F.col("coordinates"), other).alias("apart"))


SQL_EDGE_DISTANCE = """sqrt(power(longitude - (x1 + t * (x2 - x1)), 2) + power(latitude - (y1 + t * (y2 - y1)), 2))"""
SQL_NEAREST = f"""SELECT record_id, min({SQL_EDGE_DISTANCE}) AS d FROM (SELECT f.*, e.*, least(1, greatest(0, ((longitude - x1) * (x2 - x1) + (latitude - y1) * (y2 - y1))
        / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM v_features f, v_land_edges e WHERE f.type_code IN (21, 23)) GROUP BY record_id"""


@query(
    "i13_offshore_localities",
    f"""SELECT record_id, round(d * 111.0, 4) AS km FROM ({SQL_NEAREST}) WHERE d > 0.005
          AND record_id NOT IN ({sql_land('SELECT * FROM v_features', 'record_id')})""",
)
def _(spark, sf):
    rows = gazetteer.classify_features(view(spark, sf, "v_features"))
    return spatial.offshore_localities(rows, _land(spark, sf)).select("record_id", F.round("km", 4).alias("km"))


@query(
    "i14_straight_routes",
    f"""SELECT record_id, round({sql_haversine('latitude', 'longitude', 'latitude + 1', 'longitude + 2')}, 2) AS distance_m, 'straight-fallback' AS mode FROM v_features""",
)
def _(spark, sf):
    pairs = view(spark, sf, "v_features").select(
        "record_id", F.col("longitude").alias("from_lon"), F.col("latitude").alias("from_lat"),
        (F.col("longitude") + 2).alias("to_lon"), (F.col("latitude") + 1).alias("to_lat"),
    )
    return spatial.straight_routes(pairs).select("record_id", F.round("distance_m", 2).alias("distance_m"), "mode")


# One grid over the whole land box, about a quarter degree wide.
SEA = watergrid.grid_over((-74.0, 59.0, -13.0, 84.0), 0.25)
DLON, DLAT = f"{SEA.dlon!r}::DOUBLE", f"{SEA.dlat!r}::DOUBLE"
SQL_SEA = f"""SELECT r AS row, c AS col, {SEA.west}::DOUBLE + c * {DLON} AS longitude, {SEA.south}::DOUBLE + r * {DLAT} AS latitude
    FROM (SELECT unnest(range(0, {SEA.rows})) AS r), (SELECT unnest(range(0, {SEA.cols})) AS c)"""


SQL_WATER = f"SELECT row, col FROM ({SQL_SEA}) EXCEPT SELECT row, col FROM ({sql_land(SQL_SEA, 'row, col')})"


@query("i15_water_cells", SQL_WATER)
def _(spark, sf):
    return watergrid.water_cells(spark, SEA, _index(spark, sf)).select("row", "col")


SQL_LINKS = """SELECT a.row, a.col, b.row AS to_row, b.col AS to_col FROM water a JOIN water b
    ON (b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col)"""
X0, X1 = (f"({SEA.west}::DOUBLE + {c} * {DLON})" for c in ("col", "to_col"))
Y0, Y1 = (f"({SEA.south}::DOUBLE + {r} * {DLAT})" for r in ("row", "to_row"))
SQL_LINK_SAMPLES = f"""SELECT *, {X0} + ({X1} - {X0}) * t AS longitude, {Y0} + ({Y1} - {Y0}) * t AS latitude
    FROM (SELECT *, unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS t FROM links)"""


@query(
    "i15_water_links",
    f"""WITH water AS MATERIALIZED ({SQL_WATER}), links AS MATERIALIZED ({SQL_LINKS}) SELECT * FROM links EXCEPT
        SELECT row, col, to_row, to_col FROM ({sql_land(SQL_LINK_SAMPLES, 'row, col, to_row, to_col')})""",
)
def _(spark, sf):
    index = _index(spark, sf)
    return watergrid.water_links(watergrid.water_cells(spark, SEA, index), SEA, index)


def _sea(spark, sf):
    index = _index(spark, sf)
    cover = spatial.land_cover(index)
    cells = watergrid.cut_lineage(watergrid.water_cells(spark, SEA, index, cover).select("row", "col"))
    return index, cover, cells, watergrid.cut_lineage(watergrid.grid_blocks(cells, watergrid.water_links(cells, SEA, index, cover)))


SNAP = max(watergrid.SNAP_CELLS, int(-(-watergrid.SNAP_DEG // max(SEA.dlon, SEA.dlat))))
SQL_ENTER = f"""CASE bias WHEN 'shortest' THEN {watergrid.STEP_COST}
    WHEN 'north' THEN CASE WHEN {SEA.south}::DOUBLE + to_row * {DLAT} - 70.0 < 0 THEN {watergrid.AWAY_COST} ELSE {watergrid.TOWARDS_COST} END
    ELSE CASE WHEN {SEA.south}::DOUBLE + to_row * {DLAT} - 70.0 > 0 THEN {watergrid.AWAY_COST} ELSE {watergrid.TOWARDS_COST} END END"""


@query(
    "i16_water_cost_distance",
    f"""WITH RECURSIVE water AS MATERIALIZED ({SQL_WATER}), links AS MATERIALIZED ({SQL_LINKS}), clear AS MATERIALIZED (
          SELECT row, col, to_row, to_col FROM links EXCEPT SELECT row, col, to_row, to_col FROM ({sql_land(SQL_LINK_SAMPLES, 'row, col, to_row, to_col')})
        ), steps AS MATERIALIZED (SELECT * FROM clear UNION ALL SELECT to_row, to_col, row, col FROM clear),
        home AS (SELECT CAST(n_nationkey AS STRING) AS route_id, ['shortest', 'north', 'south'][1 + n_nationkey % 3] AS bias,
            greatest(0, least({SEA.rows - 1}, CAST(round((60.0 + n_nationkey * 0.9 - {SEA.south}::DOUBLE) / {DLAT}) AS INT))) AS r,
            greatest(0, least({SEA.cols - 1}, CAST(round((-73.0 + n_nationkey * 2.3 - {SEA.west}::DOUBLE) / {DLON}) AS INT))) AS c FROM nation),
        src AS (SELECT DISTINCT ON (route_id) route_id, bias, row, col FROM home JOIN water ON abs(row - r) <= {SNAP} AND abs(col - c) <= {SNAP}
            ORDER BY route_id, greatest(abs(row - r), abs(col - c)), (row - r) * (row - r) + (col - c) * (col - c), row, col),
        reach(route_id, bias, row, col, cost) USING KEY (route_id, row, col) AS (
          SELECT route_id, bias, row, col, 0 FROM src UNION
          SELECT f.route_id, f.bias, s.to_row, s.to_col, min(f.cost + {SQL_ENTER}) FROM reach f JOIN steps s ON s.row = f.row AND s.col = f.col
          LEFT JOIN recurring.reach k ON k.route_id = f.route_id AND k.row = s.to_row AND k.col = s.to_col
          WHERE k.cost IS NULL OR f.cost + {SQL_ENTER.replace("bias WHEN", "f.bias WHEN")} < k.cost GROUP BY f.route_id, f.bias, s.to_row, s.to_col)
        SELECT route_id, count(*) AS cells, sum(cost)::BIGINT AS total_cost, max(cost) AS farthest FROM reach GROUP BY route_id""".replace(
        "min(f.cost + CASE bias", "min(f.cost + CASE f.bias"
    ),
)
def _(spark, sf):
    """Cost from one snapped spot per nation to all water cells it reaches, among the land of all suppliers."""
    _, _, cells, blocks = _sea(spark, sf)
    spots = base(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("route_id"),
        (F.lit(-73.0) + F.col("n_nationkey") * 2.3).alias("longitude"),
        (F.lit(60.0) + F.col("n_nationkey") * 0.9).alias("latitude"),
    )
    bias = F.element_at(F.array(*[F.lit(b) for b in watergrid.BIASES]), (F.col("route_id").cast("int") % 3 + 1))
    sources = watergrid.snap_to_grid(spots, cells, SEA, "route_id").select(
        "route_id", "row", "col", F.lit(70.0).alias("mid_lat"), bias.alias("bias")
    )
    state = watergrid.water_cost_distance(blocks, sources, SEA)
    return watergrid.cell_costs(state).groupBy("route_id").agg(
        F.count("*").alias("cells"), F.sum("cost").alias("total_cost"), F.max("cost").alias("farthest")
    )


@query("i17_route_alternatives")
def _(spark, sf):
    """Routes between the supplier polygons' corners and points two degrees on."""
    index, cover, cells, blocks = _sea(spark, sf)
    pairs = view(spark, sf, "v_land").select(
        F.col("polygon_id").cast("string").alias("od_id"), F.col("w").alias("from_lon"), F.col("s").alias("from_lat"),
        F.least(F.lit(-13.5), F.col("w") + 2.0).alias("to_lon"), (F.col("s") + 0.5).alias("to_lat"),
    )
    routes = watergrid.plan_routes(pairs, SEA, cells, blocks, _land(spark, sf), index=index, cover=cover)
    return routes.select("od_id", "bias", F.round("distance_m", 1).alias("distance_m"), "cell_count", "mode")


# --- tiles --------------------------------------------------------------------------

SQL_TILE_Y = "CAST(trunc((1 - asinh(tan(radians({0}))) / pi()) / 2 * power(2, {1})) AS BIGINT)"
SQL_TILE_X = "CAST(trunc(({0} + 180.0) / 360.0 * power(2, {1})) AS BIGINT)"
SQL_TILES = f"""SELECT record_id, CAST(3 + record_id % 9 AS INT) AS z, {SQL_TILE_X.format('longitude', '(3 + record_id % 9)')} AS x,
    {SQL_TILE_Y.format('latitude', '(3 + record_id % 9)')} AS y FROM v_features"""


def _tiles(spark, sf):
    z = (F.col("record_id") % 9 + 3).cast("int")
    return view(spark, sf, "v_features").select(
        "record_id", z.alias("z"), geo.tile_x(F.col("longitude"), z).alias("x"), geo.tile_y(F.col("latitude"), z).alias("y")
    )


@query(
    "j1_tiles_and_bounds",
    f"""SELECT record_id, x, y, round(x / power(2, z) * 360 - 180, 6) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * y / power(2, z))))), 6) AS north
        FROM ({SQL_TILES})""",
)
def _(spark, sf):
    rows = _tiles(spark, sf).withColumn("b", geo.tile_bounds(F.col("x"), F.col("y"), F.col("z")))
    return rows.select("record_id", "x", "y", F.round("b.west", 6).alias("west"), F.round("b.north", 6).alias("north"))


@query(
    "j2_tiles_of_polygons",
    f"""SELECT polygon_id, z, count(*) AS n FROM (SELECT polygon_id, z, unnest(range({SQL_TILE_X.format('w', 'z')}, {SQL_TILE_X.format('w + 1.2', 'z')} + 1)) AS x,
          {SQL_TILE_Y.format('s + 0.9', 'z')} AS y0, {SQL_TILE_Y.format('s', 'z')} AS y1 FROM v_land, (SELECT unnest([4, 7, 10]) AS z)),
        LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y) GROUP BY polygon_id, z""",
)
def _(spark, sf):
    tiles = grids.bbox_tiles(_land(spark, sf).drop("rings"), [4, 7, 10])
    return tiles.groupBy("polygon_id", "z").agg(F.count("*").alias("n"))


@query(
    "j3_tile_children",
    f"""SELECT CAST(z + 2 AS INT) AS z, x * 4 + a AS x, y * 4 + b AS y FROM (SELECT DISTINCT z, x, y FROM ({SQL_TILES}) WHERE z = 7),
        (SELECT unnest(range(0, 4)) AS a), (SELECT unnest(range(0, 4)) AS b)""",
)
def _(spark, sf):
    parents = _tiles(spark, sf).where("z = 7").select("z", "x", "y").distinct()
    return grids.tile_children(parents, 9).select("z", "x", "y")


def _grid(spark, sf):
    """Rows from the vectors, columns from their positions, elevation in metres."""
    return base(spark, sf, "embeddings").select(
        F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "_e")
    ).select("row", "col", (F.col("_e").cast("double") * 1000.0).alias("elev"))


SQL_GRID = """SELECT CAST(vec_id AS INT) AS row, CAST(i - 1 AS INT) AS col, CAST(embedding[i] AS DOUBLE) * 1000.0 AS elev
    FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"""


@query(
    "j4_elevation_colours",
    f"""SELECT row, col, CAST(floor(s / 256.0) AS INT) AS r, CAST(floor(s % 256.0) AS INT) AS g, CAST(floor((s * 256.0) % 256.0) AS INT) AS b,
          floor(s / 256.0) * 256.0 + floor(s % 256.0) + floor((s * 256.0) % 256.0) / 256.0 - 32768.0 AS back
        FROM (SELECT row, col, greatest(0.0, least(65535.0, elev + 32768.0)) AS s FROM ({SQL_GRID}))""",
)
def _(spark, sf):
    rows = _grid(spark, sf).withColumn("c", grids.elev_to_rgb(F.col("elev")))
    return rows.select("row", "col", "c.*", grids.rgb_to_elev(F.col("c.r"), F.col("c.g"), F.col("c.b")).alias("back"))


def _two_grids(spark, sf):
    g = _grid(spark, sf)
    hole = lambda n: F.when((F.col("row") + F.col("col")) % n == 0, F.lit(grids.NODATA))
    primary = g.where(F.col("row") % 11 != 0).withColumn("elev", F.coalesce(hole(7), F.col("elev")))
    fallback = g.where(F.col("row") % 13 != 0).withColumn("elev", F.coalesce(hole(5), F.col("elev") * 2))
    return primary, fallback


SQL_MERGED = f"""SELECT row, col, coalesce(CASE WHEN row % 11 <> 0 AND (row + col) % 7 <> 0 THEN elev END,
    CASE WHEN row % 13 <> 0 AND (row + col) % 5 <> 0 THEN elev * 2 END, 0.0) AS elev FROM ({SQL_GRID}) WHERE row % 11 <> 0 OR row % 13 <> 0"""


@query("j5_merged_grid", f"SELECT row, col, round(elev, 6) AS elev FROM ({SQL_MERGED})")
def _(spark, sf):
    return grids.merge_grids(*_two_grids(spark, sf)).withColumn("elev", F.round("elev", 6))


@query(
    "j6_depth_grid",
    f"""SELECT row, col, round(CASE WHEN col % 9 = 4 THEN 0.0 ELSE least(0.0, elev) END, 6) + 0.0 AS display,
          round(CASE WHEN col % 9 = 4 THEN -32768.0 ELSE greatest(0.0, -least(0.0, elev)) END, 6) AS depth FROM ({SQL_GRID})""",
)
def _(spark, sf):
    g = _grid(spark, sf)
    d = grids.depth_grid(g, g.where(F.col("col") % 9 == 4))
    return d.select("row", "col", (F.round("display", 6) + 0.0).alias("display"), (F.round("depth", 6) + 0.0).alias("depth"))


def _spec(spark, sf, dlon: float = 0.9) -> grids.GridSpec:
    """All rows of the grid spread over 25 degrees of latitude."""
    rows = base(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    return grids.GridSpec(-74.0, 83.0, dlon, 25.0 / rows, rows, 64)


SQL_ROWS = "(SELECT max(vec_id) + 1 FROM embeddings)"
SQL_DLAT = f"(25.0::DOUBLE / {SQL_ROWS})"
SQL_CENTERS = f"SELECT row, col, -74.0 + (col + 0.5) * 0.9 AS longitude, 83.0 - (row + 0.5) * {SQL_DLAT} AS latitude FROM ({SQL_GRID})"


@query("j7_land_cells", sql_land(SQL_CENTERS, "row, col"))
def _(spark, sf):
    return grids.land_cells(_grid(spark, sf), _spec(spark, sf), _land(spark, sf))


@query(
    "j7_land_share",
    f"""SELECT round(100.0 * (SELECT count(*) FROM ({sql_land(SQL_CENTERS, 'row, col')})) / (SELECT count(*) FROM ({SQL_GRID})), 6) AS land_percent""",
)
def _(spark, sf):
    g = _grid(spark, sf)
    return grids.land_share(g, grids.land_cells(g, _spec(spark, sf), _land(spark, sf))).select(F.round("land_percent", 6).alias("land_percent"))


@query(
    "j8_sampled_tiles",
    f"""WITH t AS (SELECT DISTINCT z, x, y FROM ({SQL_TILES}) WHERE z IN (4, 6)), b AS (SELECT *, x / power(2, z) * 360.0 - 180.0 AS w, (x + 1) / power(2, z) * 360.0 - 180.0 AS e,
            degrees(atan(sinh(pi() * (1 - 2 * y / power(2, z))))) AS n, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / power(2, z))))) AS s FROM t),
          p AS (SELECT z, x, y, i, j, w + (i + 0.5) * (e - w) / 8 AS lon, n - (j + 0.5) * (n - s) / 8 AS lat
                FROM b, (SELECT unnest(range(0, 8)) AS i), (SELECT unnest(range(0, 8)) AS j)),
          o AS (SELECT {SQL_ROWS} AS n_rows, {SQL_DLAT} AS dlat, 83.0::DOUBLE - {SQL_ROWS} * {SQL_DLAT} AS south),
          q AS (SELECT *, greatest(0, least(n_rows - 1, CAST(n_rows - floor((lat - south) / dlat) - 1 AS INT))) AS row, greatest(0, least(63, CAST(floor((lon + 74.0) / 0.9) AS INT))) AS col,
                lon BETWEEN -74.0 AND -74.0 + 0.9 * 64 AND lat BETWEEN south AND 83.0 AS inside FROM p, o)
        SELECT q.z, q.x, q.y, q.i, q.j, round(CASE WHEN inside THEN coalesce(g.elev, 0.0) ELSE 0.0 END, 6) AS elev FROM q
        LEFT JOIN ({SQL_GRID}) g ON g.row = q.row AND g.col = q.col""",
)
def _(spark, sf):
    tiles = _tiles(spark, sf).where(F.col("z").isin(4, 6)).select("z", "x", "y").distinct()
    pixels = grids.sample_tiles(_grid(spark, sf), _spec(spark, sf), tiles, 8)
    return pixels.withColumn("elev", F.round("elev", 6))


SQL_BREAKS = ("CASE WHEN d < 5 THEN {0} WHEN d < 10 THEN {1} WHEN d < 20 THEN {2} WHEN d < 50 THEN {3} WHEN d < 100 THEN {4} "
              "WHEN d < 200 THEN {5} WHEN d < 500 THEN {6} ELSE 1000 END")


@query(
    "j9_depth_bands",
    f"""SELECT band, coded, count(*) AS n FROM (SELECT {SQL_BREAKS.format(5, 10, 20, 50, 100, 200, 500)} AS band,
          {SQL_BREAKS.format(10, 20, 50, 100, 200, 500, 1000)} AS coded FROM (SELECT greatest(0.0, -elev * 5) AS d FROM ({SQL_GRID}))) GROUP BY band, coded""",
)
def _(spark, sf):
    depth = F.greatest(F.lit(0.0), -F.col("elev") * 5)
    rows = _grid(spark, sf).select(grids.depth_band(depth).alias("band"), grids.depth_band(depth, True).alias("coded"))
    return rows.groupBy("band", "coded").agg(F.count("*").alias("n"))


@query(
    "j10_contour_levels",
    """SELECT p_partkey, CASE WHEN d IN (200, 500, 1000) THEN 'index' WHEN d IN (50, 100) THEN 'intermediate' ELSE 'shallow' END AS rank
       FROM (SELECT p_partkey, [5, 10, 20, 50, 100, 200, 500, 1000][1 + p_partkey % 8] AS d FROM part WHERE p_size % 5 <> 0) WHERE d >= 50""",
)
def _(spark, sf):
    d = F.element_at(F.array(*[F.lit(v) for v in grids.DEPTH_BREAKS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    rows = base(spark, sf, "part").select(
        "p_partkey", d.alias("depth_abs_m"), F.when(F.col("p_size") % 5 == 0, "ft").when(F.col("p_size") % 5 == 1, "m").alias("sys")
    )
    return grids.contour_levels(rows, 6.5).select("p_partkey", grids.contour_rank(F.col("depth_abs_m")).alias("rank"))


@query(
    "j11_peak_bands",
    f"""SELECT CASE WHEN e >= 2500 THEN 2500 WHEN e >= 2000 THEN 2000 WHEN e >= 1500 THEN 1500 WHEN e >= 1250 THEN 1250 WHEN e >= 1000 THEN 1000
          WHEN e >= 750 THEN 750 ELSE 500 END AS band, count(*) AS n FROM (SELECT elev * 10 AS e FROM ({SQL_GRID})) WHERE e >= 500 GROUP BY band""",
)
def _(spark, sf):
    rows = _grid(spark, sf).select(grids.peak_band(F.col("elev") * 10).alias("p")).where(F.col("p").isNotNull())
    return rows.groupBy("p.band").agg(F.count("*").alias("n"))


CONTOURS = (-250.0, 0.0, 250.0)
SQL_CROSSED = f"""SELECT level, x, y FROM (
      SELECT l.level, a.col + CASE WHEN b.col > a.col THEN (level - a.elev) / (b.elev - a.elev) ELSE 0.0 END AS x,
             a.row + CASE WHEN b.row > a.row THEN (level - a.elev) / (b.elev - a.elev) ELSE 0.0 END AS y
      FROM g a JOIN g b ON (b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col)
      JOIN (SELECT unnest({list(CONTOURS)}::DOUBLE[]) AS level) l ON (a.elev >= level) <> (b.elev >= level))"""


@query("j10_contour_vertices", f"WITH g AS MATERIALIZED ({SQL_GRID}) SELECT level, round(x, 6) AS x, round(y, 6) AS y FROM ({SQL_CROSSED})")
def _(spark, sf):
    """Every vertex of every contour line once; closed lines repeat their first one at the end."""
    vertices = contours.contour_lines(_grid(spark, sf), CONTOURS).where(~(F.col("closed") & (F.col("position") == 0)))
    return vertices.select("level", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _pixels(spark, sf):
    return _grid(spark, sf).select(
        F.lit(5).alias("z"), F.floor(F.col("col") / 4).alias("x"), F.floor(F.col("row") / 4).alias("y"), (F.col("elev") * 2).alias("elev")
    )


SQL_PEAKS = f"SELECT col // 4 AS x, row // 4 AS y FROM ({SQL_GRID}) GROUP BY 1, 2 HAVING max(elev * 2) >= 500"


@query(
    "j12_peak_pyramid",
    f"""SELECT 5 AS z, x, y FROM ({SQL_PEAKS}) UNION ALL SELECT 6, x * 2 + a, y * 2 + b FROM ({SQL_PEAKS}), (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)""",
)
def _(spark, sf):
    return grids.peak_pyramid(_pixels(spark, sf), 5, 6)


SQL_SIGN = f"SELECT row, col, elev > 0 AS land FROM ({SQL_GRID})"


@query(
    "j13_cell_edges",
    f"""SELECT b.col AS x0, b.row AS y0, b.col + 1 AS x1, b.row AS y1 FROM ({SQL_SIGN}) a JOIN ({SQL_SIGN}) b ON b.col = a.col AND b.row = a.row + 1 AND a.land <> b.land
        UNION ALL SELECT b.col, b.row, b.col, b.row + 1 FROM ({SQL_SIGN}) a JOIN ({SQL_SIGN}) b ON b.row = a.row AND b.col = a.col + 1 AND a.land <> b.land""",
)
def _(spark, sf):
    return grids.cell_edges(_grid(spark, sf).withColumn("land", F.col("elev") > 0), "land")


@query(
    "j14_dilated_land",
    f"""SELECT DISTINCT row + a AS row, col + b AS col FROM ({SQL_GRID}), (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b) WHERE elev > 250""",
)
def _(spark, sf):
    return grids.dilate(grids.raised_cells(_grid(spark, sf), 250))


SQL_EDGE_TILES = f"""SELECT x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, x / 1024.0 * 360 - 180 AS w, (x + 1) / 1024.0 * 360 - 180 AS e,
      degrees(atan(sinh(pi() * (1 - 2 * y / 1024.0)))) AS n, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 1024.0)))) AS s
    FROM (SELECT *, unnest(range({SQL_TILE_X.format('least(x1, x2)', 10)}, {SQL_TILE_X.format('greatest(x1, x2)', 10)} + 1)) AS x,
          {SQL_TILE_Y.format('greatest(y1, y2)', 10)} AS ya, {SQL_TILE_Y.format('least(y1, y2)', 10)} AS yb FROM v_land_edges), LATERAL (SELECT unnest(range(ya, yb + 1)) AS y)"""


@query(
    "j15_coastal_tiles",
    f"""SELECT DISTINCT x + a AS x, y + b AS y FROM (SELECT DISTINCT x, y FROM ({SQL_EDGE_TILES}) WHERE
          greatest(0, least((w - x1) / dx, (e - x1) / dx), least((s - y1) / dy, (n - y1) / dy))
          <= least(1, greatest((w - x1) / dx, (e - x1) / dx), greatest((s - y1) / dy, (n - y1) / dy))),
        (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)""",
)
def _(spark, sf):
    return grids.coastal_tiles(_land(spark, sf), 10)


@query(
    "j16_land_tiles",
    f"""SELECT record_id FROM (SELECT *, x / power(2, z) * 360 - 180 AS w, (x + 1) / power(2, z) * 360 - 180 AS e,
          degrees(atan(sinh(pi() * (1 - 2 * y / power(2, z))))) AS n, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / power(2, z))))) AS s FROM ({SQL_TILES})) t
        WHERE EXISTS (SELECT 1 FROM v_land l WHERE t.e >= l.w AND t.w <= l.w + 1.2 AND t.n >= l.s AND t.s <= l.s + 0.9)""",
)
def _(spark, sf):
    return grids.land_tiles(_land(spark, sf), _tiles(spark, sf)).select("record_id")


# Cells are numbered row by row, so the least number of a patch is its least (row, col).
SQL_MISSED = f"""raised AS MATERIALIZED (
      SELECT DISTINCT row + a AS row, col + b AS col FROM ({SQL_GRID}), (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)
      WHERE elev - 280 > {grids.LAND_ELEV_M} AND row + a BETWEEN 0 AND {SQL_ROWS} - 1 AND col + b BETWEEN 0 AND 63),
    spots AS MATERIALIZED (SELECT row, col, -74.0 + (col + 0.5) * 0.9 AS longitude, 83.0 - (row + 0.5) * {SQL_DLAT} AS latitude FROM raised),
    missed AS MATERIALIZED (SELECT row, col, row * 64 + col AS cell FROM (SELECT row, col FROM raised EXCEPT {sql_land('SELECT * FROM spots', 'row, col')})),
    steps AS MATERIALIZED (SELECT m.cell, n.cell AS next FROM missed m JOIN missed n ON abs(m.row - n.row) + abs(m.col - n.col) = 1
      AND n.row BETWEEN m.row - 1 AND m.row + 1)"""


@query(
    "j17_extra_land",
    f"""WITH RECURSIVE {SQL_MISSED}, patches(cell, label) USING KEY (cell) AS (
          SELECT cell, cell FROM missed UNION
          SELECT s.next, min(p.label) FROM patches p JOIN steps s ON s.cell = p.cell JOIN recurring.patches k ON k.cell = s.next
          WHERE p.label < k.label GROUP BY s.next),
        sized AS (SELECT label, count(*) AS cells,
            sum(0.9::DOUBLE * {SQL_DLAT} * 111320.0 ** 2 * abs(cos(radians(83.0 - (cell // 64 + 0.5) * {SQL_DLAT})))) AS area FROM patches GROUP BY label)
        SELECT CAST(label // 64 AS INT) AS patch_row, CAST(label % 64 AS INT) AS patch_col, cells, round(area, 0) AS area_m2
        FROM sized WHERE area >= {grids.MIN_PATCH_M2}""",
)
def _(spark, sf):
    """Patches of raised cells outside the polygons, by their least cell, with their sizes."""
    high = _grid(spark, sf).withColumn("elev", F.col("elev") - 280)
    cells = grids.extra_land(high, _spec(spark, sf), _land(spark, sf))
    sizes = cells.groupBy("patch").agg(F.count("*").alias("cells"), F.round(F.max("area_m2"), 0).alias("area_m2"))
    return sizes.select(F.col("patch.row").alias("patch_row"), F.col("patch.col").alias("patch_col"), "cells", "area_m2")


SQL_LINE_SAMPLES = f"""SELECT record_id, pos, x1 + (x2 - x1) * t AS longitude, y1 + (y2 - y1) * t AS latitude FROM (
      SELECT record_id, pos, longitude + xs[h + 1] AS x1, longitude + xs[h + 2] AS x2, latitude + ys[h + 1] AS y1, latitude + ys[h + 2] AS y2, pos - h AS t
      FROM (SELECT *, least(3, CAST(floor(pos) AS INT)) AS h, {[c[0] for c in STAIR]}::DOUBLE[] AS xs, {[c[1] for c in STAIR]}::DOUBLE[] AS ys
            FROM v_features, (SELECT unnest(range(0, 17)) / 4.0::DOUBLE AS pos)))"""


@query(
    "j18_clip_audit",
    f"""WITH s AS MATERIALIZED ({SQL_LINE_SAMPLES}), wet AS MATERIALIZED ({sql_land('SELECT * FROM s', 'record_id, pos')}),
          near AS (SELECT record_id, pos, min({SQL_EDGE_DISTANCE}) AS d FROM (SELECT p.*, e.*, least(1, greatest(0, ((longitude - x1) * (x2 - x1) + (latitude - y1) * (y2 - y1))
                / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM (SELECT s.* FROM s JOIN wet ON wet.record_id = s.record_id AND wet.pos = s.pos) p, v_land_edges e)
              GROUP BY record_id, pos)
        SELECT record_id AS contour_id, count(*) AS bad FROM near WHERE d > 600.0 / 111320.0 GROUP BY record_id""",
)
def _(spark, sf):
    contours = _paths(spark, sf).withColumnRenamed("path_id", "contour_id")
    bad = grids.clip_audit(contours, _land(spark, sf), epsilon_m=600.0)
    return bad.groupBy("contour_id").agg(F.count("*").alias("bad"))


SQL_LINE_HOPS = " UNION ALL ".join(
    f"SELECT record_id, {h} AS hop, longitude + {a[0]} AS hx1, latitude + {a[1]} AS hy1, longitude + {b[0]} AS hx2, latitude + {b[1]} AS hy2 FROM v_features"
    for h, (a, b) in enumerate(zip(STAIR, STAIR[1:]))
)
SQL_CUTS = """SELECT record_id, hop, t FROM (
        SELECT record_id, hop, ((x1 - hx1) * (y2 - y1) - (y1 - hy1) * (x2 - x1)) / ((hx2 - hx1) * (y2 - y1) - (hy2 - hy1) * (x2 - x1)) AS t,
               ((x1 - hx1) * (hy2 - hy1) - (y1 - hy1) * (hx2 - hx1)) / ((hx2 - hx1) * (y2 - y1) - (hy2 - hy1) * (x2 - x1)) AS u
        FROM hops JOIN v_land_edges ON least(x1, x2) <= greatest(hx1, hx2) AND greatest(x1, x2) >= least(hx1, hx2)
             AND least(y1, y2) <= greatest(hy1, hy2) AND greatest(y1, y2) >= least(hy1, hy2)) WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1
    UNION SELECT record_id, hop, unnest([0.0, 1.0]::DOUBLE[]) FROM hops"""
SQL_PIECES = f"""hops AS MATERIALIZED ({SQL_LINE_HOPS}), cuts AS ({SQL_CUTS}),
    spans AS (SELECT record_id, hop, t AS t0, lead(t) OVER (PARTITION BY record_id, hop ORDER BY t) AS t1 FROM cuts),
    pieces AS MATERIALIZED (SELECT s.record_id, s.hop, t0, t1, hx1 + (hx2 - hx1) * t0 AS px1, hy1 + (hy2 - hy1) * t0 AS py1, hx1 + (hx2 - hx1) * t1 AS px2,
           hy1 + (hy2 - hy1) * t1 AS py2, hx1 + (hx2 - hx1) * (t0 + t1) / 2 AS longitude, hy1 + (hy2 - hy1) * (t0 + t1) / 2 AS latitude
         FROM spans s JOIN hops h ON h.record_id = s.record_id AND h.hop = s.hop WHERE t1 IS NOT NULL AND sqrt(power((hx2 - hx1) * (t1 - t0), 2) + power((hy2 - hy1) * (t1 - t0), 2)) > 1e-9),
    dry AS MATERIALIZED ({sql_land('SELECT * FROM pieces', 'record_id, hop, t0')})"""


@query(
    "j18_clipped_contours",
    f"""WITH {SQL_PIECES}, wet AS (SELECT * FROM pieces ANTI JOIN dry USING (record_id, hop, t0)),
          begun AS (SELECT *, coalesce(sqrt(power(px1 - lag(px2) OVER w, 2) + power(py1 - lag(py2) OVER w, 2)) > 2e-9, TRUE) AS begins
                    FROM wet WINDOW w AS (PARTITION BY record_id ORDER BY hop, t0))
        SELECT record_id AS contour_id, count(*) FILTER (WHERE begins) AS parts, count(*) AS pieces,
               round(sum(sqrt(power(px2 - px1, 2) + power(py2 - py1, 2))), 6) AS degrees FROM begun GROUP BY record_id""",
)
def _(spark, sf):
    """Lines split at every shore they meet, without their parts on land."""
    contours = _paths(spark, sf).withColumnRenamed("path_id", "contour_id")
    kept = clipping.clip_lines(contours, _land(spark, sf))
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return kept.groupBy("contour_id").agg(
        F.count_distinct("part").alias("parts"), F.count("*").alias("pieces"), F.round(F.sum(length), 6).alias("degrees")
    )


@query(
    "j18_metres_on_land",
    f"""WITH {SQL_PIECES} SELECT record_id AS contour_id, round(sum({sql_haversine('py1', 'px1', 'py2', 'px2')}), 2) AS on_land_m
        FROM pieces SEMI JOIN dry USING (record_id, hop, t0) GROUP BY record_id""",
)
def _(spark, sf):
    contours = _paths(spark, sf).withColumnRenamed("path_id", "contour_id")
    return clipping.land_lengths(contours, _land(spark, sf)).withColumn("on_land_m", F.round("on_land_m", 2))


@query(
    "j18_band_audit",
    f"SELECT row, col FROM ({sql_land(SQL_CENTERS, 'row, col')}) WHERE row % 2 = 0",
)
def _(spark, sf):
    g = _grid(spark, sf)
    bands = g.select("row", "col", F.when(F.col("row") % 2 == 0, grids.depth_band(F.abs("elev"))).alias("band"))
    return grids.band_audit(bands, grids.land_cells(g, _spec(spark, sf), _land(spark, sf))).select("row", "col")


@query(
    "j19_shore_bands",
    f"""WITH land AS (SELECT row, col FROM ({SQL_GRID}) WHERE elev > 200), sea AS (SELECT row, col FROM ({SQL_GRID}) WHERE NOT elev > 200)
        SELECT s.row, s.col, CASE WHEN min(sqrt(power((s.row - l.row) * 0.02, 2) + power((s.col - l.col) * 0.03, 2))) <= 0.04 THEN 'nearshore' ELSE 'shelf' END AS band
        FROM sea s JOIN land l ON abs(s.row - l.row) <= 6 AND abs(s.col - l.col) <= 4
             AND sqrt(power((s.row - l.row) * 0.02, 2) + power((s.col - l.col) * 0.03, 2)) <= 0.12 GROUP BY s.row, s.col""",
)
def _(spark, sf):
    g = _grid(spark, sf)
    spec = grids.GridSpec(-74.0, 83.0, 0.03, 0.02, _spec(spark, sf).rows, 64)
    return grids.shore_bands(g, g.where(F.col("elev") > 200), spec).select("row", "col", "band")


@query(
    "j20_subset_tiles",
    f"""SELECT count(*) AS tiles, sum(record_id) AS bytes FROM ({SQL_TILES}) WHERE z <= 9 AND x BETWEEN {SQL_TILE_X.format('-60.0', 'z')} AND {SQL_TILE_X.format('-40.0', 'z')}
        AND y BETWEEN {SQL_TILE_Y.format('76.0', 'z')} AND {SQL_TILE_Y.format('62.0', 'z')}""",
)
def _(spark, sf):
    kept = grids.subset_tiles(_tiles(spark, sf), BOX, 9)
    return kept.agg(F.count("*").alias("tiles"), F.sum("record_id").alias("bytes"))


@query("j22_non_empty_tiles", "SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def _(spark, sf):
    from accessgraph.sources.files import non_empty

    rows = base(spark, sf, "pages").withColumn("content", F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("html")))
    return non_empty(rows).select("page_id")
