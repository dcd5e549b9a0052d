"""Joins of points, segments and paths with land polygons (planar degrees).

Spark has no spatial join, so polygons are listed under the cells they cover,
each with the few edges in it; points meet them by an equality join on the cell.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accessgraph.functions import geo
from accessgraph.operators.open_squares import RING, closed_squares, open_samples
from accessgraph.operators.windows import previous_row
from accessgraph.session import cut_lineage, written

CELL_DEG, SAMPLE_DEG = 0.25, 0.004
# Edges in a row of the index; how often a cell is split or merged at most.
MAX_EDGES, FINEST, COARSEST = 128, 16, 6
WATER_STEP_DEG, WATER_RADIUS_DEG = 0.008, 0.35
LAND_TOLERANCE_DEG = 0.005
DISTINCT_DEG = 0.08
KM_PER_DEG = 111.0
EPSILON = 2.220446049250313e-16


def polygon_edges(polygons: DataFrame, *keys: str) -> DataFrame:
    """One row per edge (polygon_id, ring, x1, y1, x2, y2); each ring is closed by its last edge."""
    keys = keys or ("polygon_id",)
    rings = polygons.select(*keys, F.posexplode("rings").alias("ring", "_r"))
    previous = lambda i: F.element_at(F.col("_r"), F.when(i == 0, -1).otherwise(i))
    edges = F.transform(
        "_r",
        lambda c, i: F.struct(
            c["lon"].alias("x1"), c["lat"].alias("y1"), previous(i)["lon"].alias("x2"), previous(i)["lat"].alias("y2")
        ),
    )
    return rings.select(*keys, "ring", F.explode(edges).alias("_e")).select(*keys, "ring", "_e.*")


SHAPE = ["polygon_id", "shape"]
CELL = [*SHAPE, "cx", "cy"]
RING_CELL = [*SHAPE, "ring", "cx", "cy"]


def _no_edges() -> Column:
    return F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")


def _large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the land. Catalyst does not foresee how many cells an edge is listed under."""
    return df.hint("merge")


def _at(value: Column, cell: float, scale: Column | float) -> Column:
    """Number of the cell of a side of ``cell / scale`` degrees; a power of two halves cells exactly."""
    return F.floor(value / F.lit(cell) * scale).cast("long")


def _parities(edges: DataFrame, wanted: DataFrame, cell: float, level: int) -> DataFrame:
    """``wanted`` ring cells of one size with ``odd``: the parity of crossing edges that end above in their column.

    Only columns with a wanted cell are followed, and their few border crossings
    run down them in one window.
    """
    scale = float(2**level)
    column = [*SHAPE, "ring", "cx"]
    first, last = _at(F.least("x1", "x2"), cell, scale), _at(F.greatest("x1", "x2"), cell, scale) - 1
    east_end = F.when(F.col("x1") > F.col("x2"), F.col("y1")).otherwise(F.col("y2"))
    crossing = edges.where(first <= last)
    if level:
        rough = wanted.select(*SHAPE, "ring", F.shiftright("cx", level).alias("_bx")).distinct()
        crossing = crossing.withColumn("_bx", F.explode(F.sequence(F.shiftright(first, level), F.shiftright(last, level))))
        crossing = crossing.join(_large(rough), [*SHAPE, "ring", "_bx"], "left_semi")
        first = F.greatest(first, F.shiftleft("_bx", level))
        last = F.least(last, F.shiftleft(F.col("_bx") + 1, level) - 1)
    ends = crossing.select(*SHAPE, "ring", F.explode(F.sequence(first, last)).alias("cx"), _at(east_end, cell, scale).alias("cy"))
    if level:
        ends = ends.join(_large(wanted.select(*column).distinct()), column, "left_semi")
    rows = ends.withColumns({"_n": F.lit(1), "_w": F.lit(False)}).unionByName(
        wanted.select(*RING_CELL).withColumns({"_n": F.lit(0), "_w": F.lit(True)})
    )
    rows = rows.groupBy(*RING_CELL).agg(F.sum("_n").alias("_n"), F.bool_or("_w").alias("_w"))
    above = Window.partitionBy(*column).orderBy(F.col("cy").desc()).rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("_n").over(above), F.lit(0)) % 2 == 1
    return rows.withColumn("odd", odd).where("_w").select(*RING_CELL, "odd")


def _squares(base: DataFrame, levels: int) -> DataFrame:
    """(cell, _k): cells wholly on land, with how often the largest aligned square they fill is halved to give them."""
    whole = (F.count(F.lit(1)) == 1) & (F.max("ring") == 0) & (F.count("n") == 0)
    full = base.groupBy(*CELL).agg(whole.alias("_w")).where("_w").select(*CELL)
    parents = full.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    square = Window.partitionBy(*SHAPE, "_k", F.expr("shiftright(cx, _k)"), F.expr("shiftright(cy, _k)"))
    filled = parents.withColumn("_n", F.count(F.lit(1)).over(square)).where(F.col("_n") == F.expr("shiftleft(1L, 2 * _k)"))
    return filled.groupBy(*CELL).agg(F.max("_k").alias("_k"))


def _merged(cells: DataFrame, squares: DataFrame) -> DataFrame:
    """Each square once, in place of the cells that fill it."""
    raised = cells.join(_large(squares), CELL, "left").withColumn("_k", F.coalesce("_k", F.lit(0)))
    corner = lambda c: F.expr(f"shiftleft(shiftright({c}, _k), _k) = {c}")
    return raised.where(corner("cx") & corner("cy")).select(
        *SHAPE, F.expr("shiftright(cx, _k)").alias("cx"), F.expr("shiftright(cy, _k)").alias("cy"), F.pow(F.lit(0.5), "_k").alias("scale"), "rings"
    )


def index_polygons(
    polygons: DataFrame, cell: float = CELL_DEG, max_edges: int = MAX_EDGES, finest: int = FINEST, coarsest: int = COARSEST
) -> DataFrame:
    """Rows (scale, cx, cy, polygon_id, box, rings): a quadtree of cells of ``cell / scale`` degrees.

    For each cell it has the edges in it, and per ring what lies east of it. A
    ray to the east from a point of a cell meets edges of the cell's column and
    edges wholly east of it. The ends of the latter cancel in pairs, but for
    those that an edge crossing the cell's eastern border shares, so their
    parity is fixed by such edges: ``odd`` counts those that end above the cell,
    and those that end beside it are among the cell's own edges. A cell without
    edges is wholly land or water; cells of no ring and in a hole are left out.

    Cells of more than ``max_edges`` edges are split in four until none is left
    or ``finest`` splits are made; edges are counted before they are listed, so
    no row is ever longer (unless so many edges meet in one point). Cells wholly
    on land are merged up to ``coarsest`` times. A polygon given twice counts
    once; one id with two shapes is on land where either is. The index is
    written before it is used.
    """
    shapes = polygons.dropDuplicates(["polygon_id", "rings"]).withColumn("shape", F.xxhash64("rings"))
    edges = polygon_edges(shapes, *SHAPE).where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    span = lambda a, b, scale: F.sequence(_at(F.least(a, b), cell, scale), _at(F.greatest(a, b), cell, scale))
    held = edges.withColumn("cy", F.explode(span("y1", "y2", 1.0))).withColumn("cx", F.explode(span("x1", "x2", 1.0)))
    box = edges.groupBy(*SHAPE, "ring").agg(
        *[f(_at(F.col(c), cell, 1.0)).alias(f"{n}{c[0]}") for c in ("x1", "y1") for f, n in ((F.min, "low_"), (F.max, "high_"))]
    )
    # One row per cell of a ring's box.
    frame = (
        box.withColumn("cx", F.explode(F.sequence("low_x", "high_x")))
        .withColumn("cy", F.explode(F.sequence("low_y", "high_y")))
        .select(*RING_CELL)
    )
    count = lambda df: df.groupBy(*RING_CELL).agg(F.count(F.lit(1)).alias("n"))
    base = _parities(edges, frame, cell, 0).join(_large(count(held)), RING_CELL, "left")
    base = cut_lineage(base.where(F.col("odd") | F.col("n").isNotNull()))

    def listed(rings: DataFrame, held: DataFrame) -> DataFrame:
        """One row per cell with all rings that matter in it."""
        lists = held.groupBy(*RING_CELL).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
        both = rings.join(_large(lists), RING_CELL, "left").withColumn("edges", F.coalesce("edges", _no_edges()))
        cells = both.where(F.col("odd") | (F.size("edges") > 0)).groupBy(*CELL)
        made = cells.agg(F.sort_array(F.collect_list(F.struct("ring", "odd", "edges"))).alias("rings"))
        in_hole = F.exists("rings", lambda r: (r["ring"] > 0) & r["odd"] & (F.size(r["edges"]) == 0))
        return made.where(~in_hole)

    def crowded(n: DataFrame) -> DataFrame:
        return n.groupBy(*CELL).agg(F.sum("n").alias("n")).where(F.col("n") > max_edges).select(*CELL)

    dense, leaves, open_held, level = crowded(base), base.select(*RING_CELL, "odd"), held, 0
    split = not dense.isEmpty()
    if split:
        dense = cut_lineage(dense)
        leaves, open_held = leaves.join(_large(dense), CELL, "left_anti"), held.join(_large(dense), CELL, "left_anti")
    cells = listed(leaves, open_held)
    parts = [_merged(cells, _squares(base, coarsest)) if coarsest else cells.withColumn("scale", F.lit(1.0))]
    while split and level < finest:
        level += 1
        scale = float(2**level)
        inside_parent = lambda v, p: (F.shiftright(v, 1) == F.col(p))
        spread = held.join(_large(dense), CELL, "left_semi").withColumnsRenamed({"cx": "_px", "cy": "_py"})
        spread = spread.withColumn("cx", F.explode(F.filter(span("x1", "x2", scale), lambda v: inside_parent(v, "_px"))))
        spread = spread.withColumn("cy", F.explode(F.filter(span("y1", "y2", scale), lambda v: inside_parent(v, "_py"))))
        held = cut_lineage(spread.drop("_px", "_py"))
        pair = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1))
        children = dense.withColumn("cx", pair("cx")).withColumn("cy", pair("cy"))
        dense = cut_lineage(crowded(count(held))) if level < finest else dense.limit(0)
        children = children.join(_large(dense), CELL, "left_anti")
        near = children.withColumns({"_bx": F.shiftright("cx", level), "_by": F.shiftright("cy", level)})
        wanted = near.join(_large(base.select(*SHAPE, "ring", F.col("cx").alias("_bx"), F.col("cy").alias("_by"))), [*SHAPE, "_bx", "_by"])
        wanted = cut_lineage(wanted.select(*RING_CELL))
        made = listed(_parities(edges, wanted, cell, level), held.join(_large(dense), CELL, "left_anti"))
        parts.append(made.withColumn("scale", F.lit(scale)))
        split = not dense.isEmpty()
    boxes = shapes.select(*SHAPE, "west", "south", "east", "north")
    return cut_lineage(reduce(DataFrame.unionByName, parts).join(_large(boxes), SHAPE).drop("shape"))


def index_scales(index: DataFrame) -> list[float]:
    """The sizes of cells in an index, as many as there are splits and merges at most."""
    return sorted(r["scale"] for r in index.select("scale").distinct().collect())


def _odd(ring: Column, lon: Column, lat: Column, cx: Column, cy: Column, cell: float, scale: Column | float) -> Column:
    """Whether a ray to the east crosses an odd number of the ring's edges."""

    def flips(e: Column) -> Column:
        spans = (e["y1"] > lat) != (e["y2"] > lat)
        at = (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"] + F.lit(EPSILON)) + e["x1"]
        crossing = (_at(e["x1"], cell, scale) > cx) != (_at(e["x2"], cell, scale) > cx)
        end = F.when(e["x1"] > e["x2"], e["y1"]).otherwise(e["y2"])
        return (spans & (lon < at)) != (crossing & (end > lat) & (_at(end, cell, scale) == cy))

    return (F.size(F.filter(ring["edges"], flips)) % 2 == 1) != ring["odd"]


def inside(
    rings: Column, lon: Column, lat: Column, cx: Column, cy: Column, cell: float, scale: Column | float = 1.0
) -> Column:
    """In the outer ring and in none of the holes."""
    in_ring = lambda r: _odd(r, lon, lat, cx, cy, cell, scale)
    outer = F.exists(rings, lambda r: (r["ring"] == 0) & in_ring(r))
    hole = F.exists(rings, lambda r: (r["ring"] > 0) & in_ring(r))
    return outer & ~hole


def _meets(lon: Column, lat: Column, cell: float, scale: float) -> Column:
    """Whether the point is in the polygon of an index row of one ``scale``."""
    cx, cy, box = F.col("cx"), F.col("cy"), [F.col(c) for c in ("west", "east", "south", "north")]
    return (
        (_at(lon, cell, scale) == cx)
        & (_at(lat, cell, scale) == cy)
        & lon.between(box[0], box[1])
        & lat.between(box[2], box[3])
        & inside(F.col("rings"), lon, lat, cx, cy, cell, scale)
    )


def land_cover(index: DataFrame) -> DataFrame:
    """The rows of an index that decide whether a point is on any land.

    A cell wholly on land counts once, whichever polygons fill it, and what else
    is listed inside it cannot change the answer. So where polygons lie over each
    other the cover is bounded by the area, not by their number.
    """
    rows = index.withColumn("_whole", ~F.exists("rings", lambda r: F.size(r["edges"]) > 0))
    full = rows.where("_whole").dropDuplicates(["scale", "cx", "cy"])
    kept = full.unionByName(rows.where(~F.col("_whole")))
    squares = _large(full.select(*[F.col(c).alias(f"_{c}") for c in ("scale", "cx", "cy")]))
    for scale in index_scales(index):
        inside_of = lambda c: F.floor(F.col(c) * (F.lit(scale) / F.col("scale"))) == F.col(f"_{c}")
        smaller = (F.col("scale") > scale) | ((F.col("scale") == scale) & ~F.col("_whole"))
        kept = kept.join(squares.where(F.col("_scale") == scale), inside_of("cx") & inside_of("cy") & smaller, "left_anti")
    return written(kept.drop("_whole"))


def points_on_land(
    points: DataFrame, index: DataFrame, lon: str = "longitude", lat: str = "latitude", cell: float = CELL_DEG, off: bool = False
) -> DataFrame:
    """Points on land, or with ``off`` those that are not; one equality join per size of cell."""
    return points_on_cover(points, land_cover(index), lon, lat, cell, off)


def points_on_cover(
    points: DataFrame, cover: DataFrame, lon: str = "longitude", lat: str = "latitude", cell: float = CELL_DEG, off: bool = False
) -> DataFrame:
    """The same with a cover that is made once and used several times."""
    where = F.lit(False)
    for scale in index_scales(cover):
        met = _meets(F.col(lon).outer(), F.col(lat).outer(), cell, scale)
        where = where | cover.where(F.col("scale") == scale).where(met).exists()
    return points.where(~where if off else where)


def flag_on_land(points: DataFrame, index: DataFrame, key: str, **names: str) -> DataFrame:
    hits = points_on_land(points, index, **names).select(key).distinct().withColumn("on_land", F.lit(True))
    return points.join(hits, key, "left").withColumn("on_land", F.coalesce("on_land", F.lit(False)))


def near_points(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """Points with at least one of ``others`` within ``radius`` degrees; 3 by 3 cells and an exact test."""
    cx, cy = geo.cell(F.col("longitude"), radius), geo.cell(F.col("latitude"), radius)
    around = F.flatten(
        F.transform(
            F.sequence(cx - 1, cx + 1),
            lambda x: F.transform(F.sequence(cy - 1, cy + 1), lambda y: F.struct(x.alias("x"), y.alias("y"))),
        )
    )
    spots = others.select("longitude", "latitude").distinct()
    targets = spots.select(
        F.col("longitude").alias("_lon"), F.col("latitude").alias("_lat"), F.explode(around).alias("_c")
    ).select("_lon", "_lat", F.col("_c.x").alias("_tx"), F.col("_c.y").alias("_ty"))
    keyed = points.withColumn("_px", cx).withColumn("_py", cy)
    test = (
        (F.col("_px") == F.col("_tx"))
        & (F.col("_py") == F.col("_ty"))
        & geo.near_degrees(F.col("longitude"), F.col("latitude"), F.col("_lon"), F.col("_lat"), radius)
    )
    return keyed.join(_large(targets), test, "left_semi").drop("_px", "_py")


def polygons_in_bbox(polygons: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    box = tuple(F.lit(float(v)) for v in bbox)
    mine = (F.col("west"), F.col("south"), F.col("east"), F.col("north"))
    return polygons.where(geo.bbox_overlap(mine, box, touching=True))


def circle_vertices(rows: DataFrame, lat: Column, lon: Column, radius_m: Column, steps: int = geo.CIRCLE_STEPS) -> DataFrame:
    """The rows of :func:`geo.circle_ring`: one per vertex, with its number ``i`` and place ``_v``.

    Numbers are exploded before the places are computed: a function inside an
    array is interpreted, and a row's columns are compiled.
    """
    radius = F.greatest(radius_m, F.lit(1.0))
    spread = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    return spread.withColumn("_v", geo.destination(lat, lon, F.col("i").cast("double") * (360.0 / steps), radius))


# --- segments and paths ------------------------------------------------------------


ENDS = ["x1", "y1", "x2", "y2"]


def segment_samples(segments: DataFrame, step: float = SAMPLE_DEG) -> DataFrame:
    """Sample points of each segment, both ends included, at least two steps."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    steps = F.greatest(F.lit(2), F.ceil(length / F.lit(step)).cast("int"))
    t = F.col("_i") / F.col("_steps")
    return (
        segments.withColumn("_steps", steps)
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_steps"))))
        .withColumn("longitude", F.col("x1") + (F.col("x2") - F.col("x1")) * t)
        .withColumn("latitude", F.col("y1") + (F.col("y2") - F.col("y1")) * t)
        .drop("_steps", "_i")
    )


def segments_on_land(segments: DataFrame, index: DataFrame, key: str = "segment_id", step: float = SAMPLE_DEG) -> DataFrame:
    """Segments with ``crosses_land``: any sample is on land."""
    hits = _keys_on_land(segments.select(key, *ENDS), index, key, step)
    return segments.join(hits, key, "left").withColumn("crosses_land", F.coalesce("crosses_land", F.lit(False)))


def _keys_on_land(segments: DataFrame, index: DataFrame, key: str, step: float = SAMPLE_DEG) -> DataFrame:
    """(key, crosses_land): keys of the segments with a sample on land. Segments in the same place are sampled once."""
    lines = cut_lineage(segments.select(*ENDS).distinct())
    dry = points_on_land(segment_samples(lines, step), index).select(*ENDS).distinct()
    return segments.join(cut_lineage(dry), ENDS, "left_semi").select(key).distinct().withColumn("crosses_land", F.lit(True))


def path_hops(paths: DataFrame, key: str = "path_id") -> DataFrame:
    """One row per hop of each path (array of (lon, lat)), with its position and the hop count."""
    hops = F.transform(
        F.sequence(F.lit(1), F.size("coordinates") - 1),
        lambda i: F.struct(
            (i - 1).alias("hop"),
            F.col("coordinates")[i - 1]["lon"].alias("x1"),
            F.col("coordinates")[i - 1]["lat"].alias("y1"),
            F.col("coordinates")[i]["lon"].alias("x2"),
            F.col("coordinates")[i]["lat"].alias("y2"),
        ),
    )
    long_enough = paths.where(F.size("coordinates") >= 2)
    return long_enough.select(
        key, (F.size("coordinates") - 1).alias("hops"), F.explode(hops).alias("_h")
    ).select(key, "hops", "_h.*")


def paths_on_land(paths: DataFrame, index: DataFrame, key: str = "path_id", exempt_ends: bool = True) -> DataFrame:
    """Paths with ``crosses_land``; the first and last hop may touch the shore unless ``exempt_ends`` is off."""
    hops = path_hops(paths, key)
    if exempt_ends:
        hops = hops.where((F.col("hop") > 0) & (F.col("hop") < F.col("hops") - 1))
    hit = _keys_on_land(hops.select(key, *ENDS), index, key)
    return paths.select(key).join(hit, key, "left").withColumn("crosses_land", F.coalesce("crosses_land", F.lit(False)))


def path_length(paths: DataFrame, key: str = "path_id") -> DataFrame:
    metres = geo.haversine_m(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"))
    sums = path_hops(paths, key).groupBy(key).agg(F.sum(metres).alias("length_m"))
    return paths.select(key).join(sums, key, "left").fillna(0.0, ["length_m"])


def vertex_path_length(vertices: DataFrame, key: str = "path_id", chunk: int = 50_000) -> DataFrame:
    """The same from vertex rows (key, position, longitude, latitude), for paths too long for one row."""
    seen = previous_row(
        vertices, [key], ["position"], F.floor(F.col("position") / F.lit(chunk)), ["longitude", "latitude"]
    )
    metres = geo.haversine_m(F.col("prev.latitude"), F.col("prev.longitude"), F.col("latitude"), F.col("longitude"))
    return seen.groupBy(key).agg(F.coalesce(F.sum(metres), F.lit(0.0)).alias("length_m"))


def paths_distinct(a: Column, b: Column) -> Column:
    """Whether the quarter, half or three-quarter vertices of two paths lie apart."""

    def at(path: Column, part: int) -> Column:
        return F.get(path, F.floor(F.size(path) * part / 4).cast("int"))

    gaps = [F.hypot(at(a, k)["lon"] - at(b, k)["lon"], at(a, k)["lat"] - at(b, k)["lat"]) for k in (1, 2, 3)]
    return (F.size(a) >= 2) & (F.size(b) >= 2) & (F.greatest(*gaps) > DISTINCT_DEG)


def straight_routes(pairs: DataFrame, warning: str = "Straight preview") -> DataFrame:
    """Direct route row for each pair (from_lon, from_lat, to_lon, to_lat)."""
    ends = [F.struct(F.col(f"{e}_lon").alias("lon"), F.col(f"{e}_lat").alias("lat")) for e in ("from", "to")]
    metres = geo.haversine_m(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))
    return (
        pairs.withColumn("bias", F.lit("shortest"))
        .withColumn("mode", F.lit("straight-fallback"))
        .withColumn("coordinates", F.array(*ends))
        .withColumn("distance_m", metres)
        .withColumn("cell_count", F.lit(0))
        .withColumn("warning", F.lit(warning))
    )


# --- nearest water and distance to land ---------------------------------------------


def ring_samples(points: DataFrame, step: float = WATER_STEP_DEG) -> DataFrame:
    """Places (_lon, _lat) of the numbered samples (``_sample``) around each point."""
    ring = F.floor(F.col("_sample") / RING)
    count = F.greatest(F.lit(12), F.ceil(F.lit(2 * math.pi) * ring).cast("int"))
    angle = F.col("_sample") % RING / count * F.lit(2 * math.pi)
    return points.withColumn("_lon", F.col("longitude") + F.cos(angle) * (ring * F.lit(step))).withColumn(
        "_lat", F.col("latitude") + F.sin(angle) * (ring * F.lit(step))
    )


def depth_inside(points: DataFrame, index: DataFrame, edges: DataFrame, key: str, reach: float) -> DataFrame:
    """(key, depth): how far a point on land is from the outline of the polygon it is deepest in.

    Nothing within ``depth`` is water. Depths beyond ``reach`` are given as ``reach``.
    """
    spots = points.select(key, "longitude", "latitude")
    x, y = F.col("longitude"), F.col("latitude")
    met = [
        spots.join(index.where(F.col("scale") == scale), _meets(x, y, CELL_DEG, scale)).select(*spots.columns, "polygon_id")
        for scale in index_scales(index)
    ]
    held = reduce(DataFrame.unionByName, met, spots.withColumn("polygon_id", F.lit(None)).limit(0)).distinct()
    outline = _edge_cells(edges, reach)
    near = _around(held, reach).join(_large(outline), ["polygon_id", "_ex", "_ey"])
    gaps = near.groupBy(key, "polygon_id").agg(F.min(_distance()).alias("_d"))
    return (
        held.select(key, "polygon_id")
        .join(gaps, [key, "polygon_id"], "left")
        .groupBy(key)
        .agg(F.max(F.least(F.lit(reach), F.coalesce("_d", F.lit(reach)))).alias("depth"))
    )


def nearest_water(
    points: DataFrame,
    polygons: DataFrame,
    key: str = "point_id",
    step: float = WATER_STEP_DEG,
    radius: float = WATER_RADIUS_DEG,
    most: int = 8,
    index: DataFrame | None = None,
    cover: DataFrame | None = None,
) -> DataFrame:
    """(key, water_lon, water_lat): the point itself on water, else the first sample of the innermost ring with water.

    Every position is searched once, however many points share it. It starts at
    the first ring that can leave the polygon it is deepest in and reach a cell
    that is not wholly land; without such a cell there is no water to find.
    Samples in squares that lie wholly in a polygon are passed over; the next
    ``most`` of the others meet the polygons, and a position that found no water
    goes on from there with eight times as many, until it has no samples left.
    """
    rings = int(math.floor(radius / step + 1e-9))
    index = index_polygons(polygons) if index is None else index
    cover = land_cover(index) if cover is None else cover
    places = distinct_places(points)
    wet = cut_lineage(
        points_on_cover(places, cover, off=True).select(
            SPOT, F.col("longitude").alias("water_lon"), F.col("latitude").alias("water_lat")
        )
    )
    near = cut_lineage(_open_gaps(places.join(wet.select(SPOT), SPOT, "left_anti"), cover, radius))
    depths = depth_inside(near, index, polygon_edges(polygons), SPOT, radius)
    # One ring of slack keeps rounding of the depth from skipping a ring.
    start = F.greatest(F.lit(1), F.floor(F.greatest("depth", "gap") / F.lit(step))).cast("long") * RING
    left = cut_lineage(near.join(depths, SPOT).withColumn("start", start).drop("depth", "gap"))
    squares, found = written(closed_squares(cover, CELL_DEG)), [wet]
    while not left.isEmpty():
        asked = cut_lineage(open_samples(left, squares, SPOT, rings, step, CELL_DEG, most))
        samples = ring_samples(asked.withColumn("_sample", F.explode("samples")), step)
        hit = cut_lineage(
            points_on_cover(samples.select(SPOT, "_sample", "_lon", "_lat"), cover, "_lon", "_lat", off=True)
            .groupBy(SPOT)
            .agg(F.min_by(F.struct("_lon", "_lat"), "_sample").alias("_w"))
            .select(SPOT, F.col("_w._lon").alias("water_lon"), F.col("_w._lat").alias("water_lat"))
        )
        found.append(hit)
        more = asked.where(F.size("samples") == most).withColumn("start", F.element_at("samples", -1) + 1).drop("samples")
        left = cut_lineage(more.join(hit.select(SPOT), SPOT, "left_anti"))
        most *= 8
    met = places.join(reduce(DataFrame.unionByName, found), SPOT, "left").drop(SPOT)
    return at_places(points, met).select(key, "water_lon", "water_lat")


SPOT = "_spot"


def distinct_places(points: DataFrame) -> DataFrame:
    """(_spot, longitude, latitude): every position once."""
    places = points.select("longitude", "latitude").distinct()
    return cut_lineage(places.withColumn(SPOT, F.monotonically_increasing_id()))


def at_places(points: DataFrame, met: DataFrame) -> DataFrame:
    """Points with what was found at their position; those of no row in ``met`` are left out. Points are never broadcast."""
    met = met.withColumnsRenamed({"longitude": "_x", "latitude": "_y"})
    return _large(points).join(met, F.col("longitude").eqNullSafe(F.col("_x")) & F.col("latitude").eqNullSafe(F.col("_y"))).drop("_x", "_y")


def _open_gaps(places: DataFrame, cover: DataFrame, reach: float, cell: float = CELL_DEG) -> DataFrame:
    """Places with ``gap``, the distance to the nearest cell not wholly on land; those without one within ``reach`` are left out."""
    whole = cover.where((F.col("scale") <= 1) & ~F.exists("rings", lambda r: F.size(r["edges"]) > 0))
    side = (1 / F.col("scale")).cast("long")
    cells = lambda c: F.explode(F.sequence(F.col(c) * side, F.col(c) * side + side - 1))
    full = whole.select("scale", cells("cx").alias("_ex"), "cy").select("_ex", cells("cy").alias("_ey")).distinct()
    span = lambda c: F.explode(F.sequence(_at(F.col(c) - reach, cell, 1.0), _at(F.col(c) + reach, cell, 1.0)))
    around = places.withColumn("_ex", span("longitude")).withColumn("_ey", span("latitude"))
    near, _ = _cell_bounds(cell)
    gaps = around.join(_large(full), ["_ex", "_ey"], "left_anti").withColumn("gap", near)
    return gaps.where(F.col("gap") <= reach).groupBy(*places.columns).agg(F.min("gap").alias("gap"))


def _edge_cells(edges: DataFrame, cell: float) -> DataFrame:
    """Edges under each cell of their box."""
    xs = F.sequence(geo.cell(F.least("x1", "x2"), cell), geo.cell(F.greatest("x1", "x2"), cell))
    ys = F.sequence(geo.cell(F.least("y1", "y2"), cell), geo.cell(F.greatest("y1", "y2"), cell))
    return edges.withColumn("_ex", F.explode(xs)).withColumn("_ey", F.explode(ys))


def _around(points: DataFrame, cell: float) -> DataFrame:
    cx, cy = geo.cell(F.col("longitude"), cell), geo.cell(F.col("latitude"), cell)
    return points.withColumn("_ex", F.explode(F.sequence(cx - 1, cx + 1))).withColumn(
        "_ey", F.explode(F.sequence(cy - 1, cy + 1))
    )


def _distance() -> Column:
    return geo.segment_distance(*[F.col(c) for c in ("longitude", "latitude", "x1", "y1", "x2", "y2")])


def close_to_edges(points: DataFrame, edges: DataFrame, radius: float, key: str) -> DataFrame:
    """Points within ``radius`` of an edge."""
    cell = max(radius, CELL_DEG)
    near = _around(points.select(key, "longitude", "latitude"), cell).join(_large(_edge_cells(edges, cell)), ["_ex", "_ey"])
    return points.join(near.where(_distance() <= radius).select(key).distinct(), key, "left_semi")


def _cell_bounds(cell: float) -> tuple[Column, Column]:
    """Least and greatest distance from a point to the cell (_ex, _ey)."""

    def gaps(at: str, index: str) -> tuple[Column, Column]:
        low, high = F.col(index) * F.lit(cell), (F.col(index) + 1) * F.lit(cell)
        inner = F.greatest(low - F.col(at), F.col(at) - high, F.lit(0.0))
        return inner, F.greatest(F.abs(F.col(at) - low), F.abs(F.col(at) - high))

    (dx, fx), (dy, fy) = gaps("longitude", "_ex"), gaps("latitude", "_ey")
    return F.hypot(dx, dy), F.hypot(fx, fy)


def distance_to_edges(points: DataFrame, edges: DataFrame, key: str, cell: float = CELL_DEG, levels: int = 5) -> DataFrame:
    """Exact distance in degrees to the nearest edge.

    Cells are refined from the whole plane down, four times finer at a time. A
    cell with a vertex bounds the distance from above by its far corner, so all
    cells whose near side lies beyond that are left; only the edges of the few
    last cells are measured.
    """
    listed = cut_lineage(_edge_cells(edges, cell))
    vertex = (geo.cell(F.col("x1"), cell) == F.col("_ex")) & (geo.cell(F.col("y1"), cell) == F.col("_ey"))
    fine = cut_lineage(listed.groupBy("_ex", "_ey").agg(F.bool_or(vertex).alias("_v")))

    def occupied(level: int) -> DataFrame:
        if level == 0:
            return fine
        shrink = lambda c: F.floor(F.col(c) / F.lit(4**level)).cast("long").alias(c)
        return fine.groupBy(shrink("_ex"), shrink("_ey")).agg(F.bool_or("_v").alias("_v"))

    spots = points.select(key, "longitude", "latitude")
    # The coarsest cells cover the globe in a handful.
    top = occupied(levels).agg(F.collect_list(F.struct("_ex", "_ey", "_v"))).first()[0]
    if not top:
        return spots.select(key, F.lit(None).cast("double").alias("distance_deg")).limit(0)
    whole = F.array(*[F.struct(*[F.lit(c[n]).alias(n) for n in ("_ex", "_ey", "_v")]) for c in top])
    cells = spots.withColumn("_c", F.explode(whole)).select(key, "longitude", "latitude", "_c.*")
    for level in range(levels, -1, -1):
        near, far = _cell_bounds(cell * 4**level)
        bounded = cells.withColumn("_near", near)
        limits = cells.groupBy(key).agg(F.min(F.when(F.col("_v"), far)).alias("_far"))
        kept = bounded.join(limits, key).where(F.col("_far").isNull() | (F.col("_near") <= F.col("_far")))
        kept = kept.select(key, "longitude", "latitude", "_ex", "_ey")
        if level:
            for c in ("_ex", "_ey"):
                kept = kept.withColumn(c, F.explode(F.sequence(F.col(c) * 4, F.col(c) * 4 + 3)))
            kept = kept.join(occupied(level - 1), ["_ex", "_ey"])
        cells = cut_lineage(kept)
    return cells.join(_large(listed), ["_ex", "_ey"]).groupBy(key).agg(F.min(_distance()).alias("distance_deg"))


def offshore_localities(
    places: DataFrame, polygons: DataFrame, key: str = "global_id", tolerance: float = LAND_TOLERANCE_DEG
) -> DataFrame:
    """Localities that are neither on land nor within the tolerance of it, with the distance; one search per position."""
    localities = places.where("is_locality")
    afloat = points_on_land(distinct_places(localities), index_polygons(polygons), off=True)
    edges = polygon_edges(polygons)
    shore = close_to_edges(afloat, edges, tolerance, SPOT).select(SPOT)
    far = cut_lineage(afloat.join(shore, SPOT, "left_anti"))
    met = far.join(distance_to_edges(far, edges, SPOT), SPOT).drop(SPOT)
    return at_places(localities, met).withColumn("km", F.col("distance_deg") * KM_PER_DEG)
