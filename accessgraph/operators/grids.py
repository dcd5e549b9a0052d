"""Elevation and depth grids as tables of (row, col, elev), and map tiles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accessgraph.functions import geo
from accessgraph.operators.spatial import (
    SPOT,
    at_places,
    close_to_edges,
    distinct_places,
    index_polygons,
    path_hops,
    points_on_land,
    polygon_edges,
)
from accessgraph.session import cut_lineage

NODATA = -32768.0
# Depth breaks, contour ranks and peak bands in metres.
DEPTH_BREAKS = (5, 10, 20, 50, 100, 200, 500, 1000)
OVERVIEW_BREAKS = (50, 100, 200, 500, 1000)
DETAIL_MIN_ZOOM = 9
INDEX_CONTOURS, INTERMEDIATE_CONTOURS = (200, 500, 1000), (50, 100)
PEAK_BREAKS = (500, 750, 1000, 1250, 1500, 2000, 2500)
PEAK_COLORS = ("#9a8a6c", "#8a7a5c", "#7a6c54", "#6b5e4a", "#5c5242", "#4a463f", "#3a3832")
LAND_ELEV_M, MIN_PATCH_M2, METRES_PER_DEG = 1.0, 400.0, 111320.0
NEAR_SHORE_DEG, SHELF_DEG = 0.04, 0.12
INSIDE_EPSILON_M = 0.5
COARSE_ZOOM = 8


@dataclass(frozen=True)
class GridSpec:
    """Placement of a grid; row 0 is the northern edge."""

    west: float
    north: float
    dlon: float
    dlat: float
    rows: int
    cols: int

    @property
    def east(self) -> float:
        return self.west + self.dlon * self.cols

    @property
    def south(self) -> float:
        return self.north - self.dlat * self.rows

    def center_lon(self) -> Column:
        return F.lit(self.west) + (F.col("col") + 0.5) * self.dlon

    def center_lat(self) -> Column:
        return F.lit(self.north) - (F.col("row") + 0.5) * self.dlat


# --- tiles ------------------------------------------------------------------------


def bbox_tiles(boxes: DataFrame, zooms: list[int]) -> DataFrame:
    """Tiles (z, x, y) that cover each box (west, south, east, north), other columns kept."""
    z = F.explode(F.array(*[F.lit(v) for v in zooms])).alias("z")
    keep = [c for c in boxes.columns if c not in ("west", "south", "east", "north")]
    return (
        boxes.select("*", z)
        .withColumn("x", F.explode(F.sequence(geo.tile_x(F.col("west"), F.col("z")), geo.tile_x(F.col("east"), F.col("z")))))
        .withColumn("y", F.explode(F.sequence(geo.tile_y(F.col("north"), F.col("z")), geo.tile_y(F.col("south"), F.col("z")))))
        .select(*keep, "z", "x", "y")
    )


def tile_children(tiles: DataFrame, target_z: int) -> DataFrame:
    """All tiles at ``target_z`` below each tile."""
    factor = F.pow(F.lit(2.0), F.lit(target_z) - F.col("z")).cast("long")
    span = lambda c: F.explode(F.sequence(F.col(c) * F.col("_f"), (F.col(c) + 1) * F.col("_f") - 1))
    return (
        tiles.withColumn("_f", factor)
        .withColumn("cx", span("x"))
        .withColumn("cy", span("y"))
        .select(F.lit(target_z).alias("z"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("x").alias("parent_x"), F.col("y").alias("parent_y"))
    )


def subset_tiles(tiles: DataFrame, bbox: tuple[float, float, float, float], max_zoom: int) -> DataFrame:
    """Tiles up to a zoom inside a box, by a filter on their numbers alone."""
    west, south, east, north = (F.lit(float(v)) for v in bbox)
    z = F.col("z")
    return tiles.where(
        (z <= max_zoom)
        & F.col("x").between(geo.tile_x(west, z), geo.tile_x(east, z))
        & F.col("y").between(geo.tile_y(north, z), geo.tile_y(south, z))
    )


def _ancestor(df: DataFrame) -> DataFrame:
    """The tile itself up to the coarse zoom, else its ancestor there."""
    drop = F.greatest(F.lit(0), F.col("z") - COARSE_ZOOM)
    up = F.pow(F.lit(2.0), drop)
    return (
        df.withColumn("_z", F.least(F.col("z"), F.lit(COARSE_ZOOM)))
        .withColumn("_x", F.floor(F.col("x") / up).cast("long"))
        .withColumn("_y", F.floor(F.col("y") / up).cast("long"))
    )


def tiles_meeting_boxes(tiles: DataFrame, boxes: DataFrame, touching: bool, how: str = "inner") -> DataFrame:
    """Tiles joined to the boxes they overlap; both meet at tiles of a coarse zoom, then by an exact test."""
    covered = bbox_tiles(
        boxes.select("*", *[F.col(c).alias(f"b_{c}") for c in ("west", "south", "east", "north")]),
        list(range(COARSE_ZOOM + 1)),
    ).withColumnsRenamed({"z": "_bz", "x": "_bx", "y": "_by"})
    placed = _ancestor(tiles).withColumn("_t", geo.tile_bounds(F.col("x"), F.col("y"), F.col("z")))
    mine = tuple(F.col(f"_t.{c}") for c in ("west", "south", "east", "north"))
    box = tuple(F.col(f"b_{c}") for c in ("west", "south", "east", "north"))
    same = (F.col("_z") == F.col("_bz")) & (F.col("_x") == F.col("_bx")) & (F.col("_y") == F.col("_by"))
    return placed.join(covered, same & geo.bbox_overlap(mine, box, touching), how).drop("_z", "_x", "_y", "_t", "_bz", "_bx", "_by")


def land_tiles(polygons: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tiles whose box meets the box of some polygon."""
    return tiles_meeting_boxes(tiles, polygons.select("west", "south", "east", "north"), True, "left_semi")


def gap_zones(misses: DataFrame, viewports: DataFrame) -> DataFrame:
    """Per viewport: whether land and ocean tiles are missing in view."""
    seen = misses.select("zone", "z", "x", "y").distinct()
    hits = tiles_meeting_boxes(seen, viewports.select("viewport_id", "west", "south", "east", "north"), False)
    zones = hits.groupBy("viewport_id").agg(
        F.bool_or(F.col("zone") == "land").alias("land"), F.bool_or(F.col("zone") != "land").alias("ocean")
    )
    return (
        viewports.select("viewport_id")
        .join(zones, "viewport_id", "left")
        .select("viewport_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("land", "ocean")])
    )


def coastal_tiles(polygons: DataFrame, zoom: int, rings: int = 1) -> DataFrame:
    """Tiles that a land boundary touches, and their neighbours up to ``rings`` away."""
    edges = polygon_edges(polygons)
    boxed = edges.withColumns(
        {
            "west": F.least("x1", "x2"), "east": F.greatest("x1", "x2"),
            "south": F.least("y1", "y2"), "north": F.greatest("y1", "y2"),
        }
    )
    touched = bbox_tiles(boxed, [zoom]).withColumn("_t", geo.tile_bounds(F.col("x"), F.col("y"), F.lit(zoom)))
    # The part of the edge inside the tile's columns and rows, as a range of t.
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def span(start: Column, delta: Column, low: Column, high: Column) -> tuple[Column, Column]:
        a, b = (low - start) / delta, (high - start) / delta
        still = delta == 0
        return (
            F.when(still, F.lit(0.0)).otherwise(F.least(a, b)),
            F.when(still, F.lit(1.0)).otherwise(F.greatest(a, b)),
        )

    safe = lambda d: F.when(d != 0, d)
    x_lo, x_hi = span(F.col("x1"), safe(dx), F.col("_t.west"), F.col("_t.east"))
    y_lo, y_hi = span(F.col("y1"), safe(dy), F.col("_t.south"), F.col("_t.north"))
    enter = F.greatest(F.lit(0.0), F.coalesce(x_lo, F.lit(0.0)), F.coalesce(y_lo, F.lit(0.0)))
    leave = F.least(F.lit(1.0), F.coalesce(x_hi, F.lit(1.0)), F.coalesce(y_hi, F.lit(1.0)))
    seen = touched.where(enter <= leave).select("x", "y").distinct()
    return _spread(seen, "x", "y", rings)


def _spread(cells: DataFrame, a: str, b: str, reach: int = 1) -> DataFrame:
    return (
        cells.withColumn("_da", F.explode(F.sequence(F.col(a) - reach, F.col(a) + reach)))
        .withColumn("_db", F.explode(F.sequence(F.col(b) - reach, F.col(b) + reach)))
        .select(F.col("_da").alias(a), F.col("_db").alias(b))
        .distinct()
    )


# --- values -------------------------------------------------------------------------


def rgb_to_elev(r: Column, g: Column, b: Column) -> Column:
    return r * 256.0 + g + b / 256.0 - 32768.0


def elev_to_rgb(elev: Column) -> Column:
    """Struct (r, g, b); the elevation is clipped to what three bytes hold."""
    shifted = F.greatest(F.lit(0.0), F.least(F.lit(65535.0), elev + 32768.0))
    return F.struct(
        F.floor(shifted / 256.0).cast("int").alias("r"),
        F.floor(F.pmod(shifted, F.lit(256.0))).cast("int").alias("g"),
        F.floor(F.pmod(shifted * 256.0, F.lit(256.0))).cast("int").alias("b"),
    )


def merge_grids(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Primary where it has data, else the fallback, else 0."""
    valid = lambda c: F.when(F.col(c) != NODATA, F.col(c))
    a = primary.select("row", "col", F.col("elev").alias("_a"))
    b = fallback.select("row", "col", F.col("elev").alias("_b"))
    return a.join(b, ["row", "col"], "full").select(
        "row", "col", F.coalesce(valid("_a"), valid("_b"), F.lit(0.0)).alias("elev")
    )


def depth_grid(elevation: DataFrame, land: DataFrame) -> DataFrame:
    """``display`` (0 on land) and ``depth`` (positive at sea, no-data on land) from an elevation grid."""
    flat = F.least(F.lit(0.0), F.col("elev"))
    marked = elevation.join(land.select("row", "col").distinct().withColumn("_land", F.lit(True)), ["row", "col"], "left")
    on_land = F.col("_land").isNotNull()
    return marked.select(
        "row",
        "col",
        F.when(on_land, F.lit(0.0)).otherwise(flat).alias("display"),
        F.when(on_land, F.lit(NODATA)).otherwise(F.greatest(F.lit(0.0), -flat)).alias("depth"),
    )


def depth_band(depth: Column, as_coded: bool = False) -> Column:
    """Upper edge of the band a depth lies in.

    ``as_coded`` gives the label one step higher, the first break above the
    upper edge, which is what the published tiles carry.
    """
    breaks = DEPTH_BREAKS
    label = F.lit(breaks[-1])
    for i in range(len(breaks) - 1, -1, -1):
        upper = breaks[min(i + 1, len(breaks) - 1)] if as_coded else breaks[i]
        label = F.when(depth < breaks[i], F.lit(upper)).otherwise(label)
    return F.when(depth >= 0, label)


def contour_rank(depth: Column) -> Column:
    return (
        F.when(depth.isin(*INDEX_CONTOURS), "index").when(depth.isin(*INTERMEDIATE_CONTOURS), "intermediate").otherwise("shallow")
    )


def contour_levels(contours: DataFrame, zoom: float) -> DataFrame:
    """Contours shown at a zoom; rows in feet are never shown."""
    breaks = DEPTH_BREAKS if zoom >= DETAIL_MIN_ZOOM else OVERVIEW_BREAKS
    metric = F.coalesce(F.col("sys") != "ft", F.lit(True)) if "sys" in contours.columns else F.lit(True)
    return contours.where(F.col("depth_abs_m").isin(*breaks) & metric)


def peak_band(elev: Column) -> Column:
    """Struct (band, color) of an elevation; null below the first break."""
    out = F.lit(None)
    for low, color in zip(PEAK_BREAKS, PEAK_COLORS):
        out = F.when(elev >= low, F.struct(F.lit(low).alias("band"), F.lit(color).alias("color"))).otherwise(out)
    return out


def peak_tiles(pixels: DataFrame) -> DataFrame:
    """Tiles (z, x, y, max_elev) that hold at least one peak; pixels are (z, x, y, elev)."""
    return pixels.groupBy("z", "x", "y").agg(F.max("elev").alias("max_elev")).where(F.col("max_elev") >= PEAK_BREAKS[0])


def peak_pyramid(pixels: DataFrame, filter_zoom: int, max_zoom: int) -> DataFrame:
    """Tiles to build: peaks down to the filter zoom, then only children of peak parents."""
    kept = peak_tiles(pixels)
    parents = kept.where(F.col("z") == filter_zoom)
    deeper = [tile_children(parents, z).select("z", "x", "y") for z in range(filter_zoom + 1, max_zoom + 1)]
    return reduce(DataFrame.unionByName, [kept.where(F.col("z") <= filter_zoom).select("z", "x", "y"), *deeper])


# --- cells ----------------------------------------------------------------------------


def land_cells(grid: DataFrame, spec: GridSpec, polygons: DataFrame) -> DataFrame:
    """Cells whose centre is on land."""
    centers = grid.select("row", "col", spec.center_lon().alias("longitude"), spec.center_lat().alias("latitude"))
    return points_on_land(centers, index_polygons(polygons)).select("row", "col")


def land_share(grid: DataFrame, land: DataFrame) -> DataFrame:
    """One row: percentage of cells on land."""
    marked = grid.join(land.withColumn("_land", F.lit(1.0)), ["row", "col"], "left")
    return marked.agg((F.avg(F.coalesce("_land", F.lit(0.0))) * 100).alias("land_percent"))


def full_grid(spark: SparkSession, spec: GridSpec) -> DataFrame:
    """Every (row, col) of a grid, made in parallel."""
    ids = spark.range(spec.rows * spec.cols)
    return ids.select(
        F.floor(F.col("id") / spec.cols).cast("int").alias("row"), (F.col("id") % spec.cols).cast("int").alias("col")
    )


def sample_tiles(grid: DataFrame, spec: GridSpec, tiles: DataFrame, px: int) -> DataFrame:
    """Nearest-cell elevation of each pixel (z, x, y, i, j) of the tiles; 0 outside the grid.

    ``i`` counts columns from the west and ``j`` rows from the north.
    """
    pixels = (
        tiles.withColumn("_t", geo.tile_bounds(F.col("x"), F.col("y"), F.col("z")))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(px - 1))))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(px - 1))))
    )
    lon = F.col("_t.west") + (F.col("i") + 0.5) * (F.col("_t.east") - F.col("_t.west")) / px
    lat = F.col("_t.north") - (F.col("j") + 0.5) * (F.col("_t.north") - F.col("_t.south")) / px
    inside = lon.between(spec.west, spec.east) & lat.between(spec.south, spec.north)
    clip = lambda v, top: F.greatest(F.lit(0), F.least(F.lit(top - 1), v.cast("int")))
    row = clip(F.lit(spec.rows) - F.floor((lat - spec.south) / spec.dlat) - 1, spec.rows)
    col = clip(F.floor((lon - spec.west) / spec.dlon), spec.cols)
    placed = pixels.select("z", "x", "y", "i", "j", F.when(inside, row).alias("row"), F.when(inside, col).alias("col"))
    return placed.join(grid.select("row", "col", "elev"), ["row", "col"], "left").select(
        "z", "x", "y", "i", "j", F.coalesce("elev", F.lit(0.0)).alias("elev")
    )


def cell_edges(grid: DataFrame, value: str) -> DataFrame:
    """Unit segments (x0, y0, x1, y1) between side-by-side cells whose ``value`` differs.

    Each cell meets its neighbour above and to the left by an equality join on
    both indices, so no row or column of the grid is one group.
    """
    here = grid.select("row", "col", F.col(value).alias("_v"))

    def between(d_row: int, d_col: int) -> DataFrame:
        there = here.select((F.col("row") + d_row).alias("row"), (F.col("col") + d_col).alias("col"), F.col("_v").alias("_w"))
        return here.join(there, ["row", "col"]).where(~F.col("_v").eqNullSafe(F.col("_w")))

    up = between(1, 0).select(
        F.col("col").alias("x0"), F.col("row").alias("y0"), (F.col("col") + 1).alias("x1"), F.col("row").alias("y1")
    )
    side = between(0, 1).select(
        F.col("col").alias("x0"), F.col("row").alias("y0"), F.col("col").alias("x1"), (F.col("row") + 1).alias("y1")
    )
    return up.unionByName(side)


def raised_cells(grid: DataFrame, threshold: float = LAND_ELEV_M) -> DataFrame:
    return grid.where(F.col("elev") > threshold).select("row", "col")


def dilate(cells: DataFrame) -> DataFrame:
    """Cells with their eight neighbours."""
    return _spread(cells.select("row", "col"), "row", "col")


def connected_patches(cells: DataFrame) -> DataFrame:
    """Cells with ``patch``, one id per group of cells joined by their sides.

    Stars are contracted in turns: each node links its larger neighbours, then
    its smaller ones, to its smallest neighbour. The number of rounds grows with
    the logarithm of the patch size, and each round is written down.
    """
    key = F.struct("row", "col")
    nodes = cells.select(key.alias("n")).distinct()
    right = cells.select(F.struct("row", (F.col("col") + 1).alias("col")).alias("n"), key.alias("m"))
    below = cells.select(F.struct((F.col("row") + 1).alias("row"), "col").alias("n"), key.alias("m"))
    links = right.unionByName(below).join(nodes, "n", "left_semi").select(F.col("n").alias("a"), F.col("m").alias("b"))
    links = cut_lineage(links)

    def both(df: DataFrame) -> DataFrame:
        return df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(df: DataFrame, upward: bool) -> DataFrame:
        around = both(df) if upward else df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        smallest = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_min"))
        linked = around.join(smallest, "a")
        if upward:
            linked = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_min").alias("b"))
        else:
            linked = linked.select(F.col("b").alias("a"), F.col("_min").alias("b")).unionByName(
                linked.select("a", F.col("_min").alias("b"))
            )
        return linked.where(F.col("a") != F.col("b")).distinct()

    stamp = None
    while True:
        links = cut_lineage(star(star(links, True), False))
        state = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        ).first()
        if state == stamp:
            break
        stamp = state
    labels = links.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("_root"))
    labelled = nodes.join(labels, "n", "left")
    return labelled.select("n.row", "n.col", F.coalesce("_root", F.col("n")).alias("patch"))


def extra_land(elevation: DataFrame, spec: GridSpec, polygons: DataFrame, min_area_m2: float = MIN_PATCH_M2) -> DataFrame:
    """Cells that the elevation shows as land and the polygons miss, without small patches."""
    raised = dilate(raised_cells(elevation))
    inside = raised.where(F.col("row").between(0, spec.rows - 1) & F.col("col").between(0, spec.cols - 1))
    centers = inside.select("row", "col", spec.center_lon().alias("longitude"), spec.center_lat().alias("latitude"))
    missed = cut_lineage(points_on_land(centers, index_polygons(polygons), off=True).select("row", "col"))
    patches = connected_patches(missed)
    area = F.lit(spec.dlon * spec.dlat * METRES_PER_DEG**2) * F.abs(F.cos(F.radians(spec.center_lat())))
    sizes = patches.groupBy("patch").agg(F.sum(area).alias("area_m2")).where(F.col("area_m2") >= min_area_m2)
    return patches.join(sizes, "patch")


def contour_samples(contours: DataFrame, key: str = "contour_id") -> DataFrame:
    """Vertices, and points at 25, 50 and 75 % of each hop, of lines (array of (lon, lat))."""
    shares = F.array(*[F.lit(v) for v in (0.0, 0.25, 0.5, 0.75)])
    hops = path_hops(contours, key)
    last = hops.where(F.col("hop") == F.col("hops") - 1).select(
        key, (F.col("hop") + 1).cast("double").alias("at"), F.col("x2").alias("longitude"), F.col("y2").alias("latitude")
    )
    t = F.col("_t")
    along = hops.withColumn("_t", F.explode(shares)).select(
        key,
        (F.col("hop") + t).alias("at"),
        (F.col("x1") + (F.col("x2") - F.col("x1")) * t).alias("longitude"),
        (F.col("y1") + (F.col("y2") - F.col("y1")) * t).alias("latitude"),
    )
    return along.unionByName(last)


def clip_audit(contours: DataFrame, polygons: DataFrame, key: str = "contour_id", epsilon_m: float = INSIDE_EPSILON_M) -> DataFrame:
    """Contour points truly inside land: on land and farther than the epsilon from every shore; one search per position."""
    samples = contour_samples(contours, key)
    wet_feet = points_on_land(distinct_places(samples), index_polygons(polygons))
    on_shore = close_to_edges(wet_feet, polygon_edges(polygons), epsilon_m / METRES_PER_DEG, SPOT).select(SPOT)
    return at_places(samples, cut_lineage(wet_feet.join(on_shore, SPOT, "left_anti").drop(SPOT)))


def band_audit(bands: DataFrame, land: DataFrame) -> DataFrame:
    """Band cells that lie on land; an empty result means the clip held."""
    return bands.where(F.col("band").isNotNull()).join(land.select("row", "col"), ["row", "col"], "left_semi")


def shore_bands(grid: DataFrame, land: DataFrame, spec: GridSpec, near: float = NEAR_SHORE_DEG, shelf: float = SHELF_DEG) -> DataFrame:
    """Sea cells near land: ``nearshore`` up to ``near`` degrees, ``shelf`` up to ``shelf``.

    Only land cells with a sea side send their distance, to the cells within
    reach; distances are combined by minimum before the shuffle.
    """
    cells = land.select("row", "col").distinct()
    steps = [(0, 1), (0, -1), (1, 0), (-1, 0)]
    sides = F.array(*[F.struct((F.col("row") + a).alias("row"), (F.col("col") + b).alias("col")) for a, b in steps])
    sea_sides = (
        cells.select(F.struct("row", "col").alias("_c"), F.explode(sides).alias("_s"))
        .select("_c", "_s.*")
        .join(cells, ["row", "col"], "left_anti")
    )
    coast = sea_sides.select("_c.row", "_c.col").distinct()
    down, across = int(shelf / spec.dlat + 1e-9), int(shelf / spec.dlon + 1e-9)
    span = lambda reach: F.sequence(F.lit(-reach), F.lit(reach))
    distance = F.hypot(F.col("_dr") * spec.dlat, F.col("_dc") * spec.dlon)
    reached = (
        coast.withColumn("_dr", F.explode(span(down)))
        .withColumn("_dc", F.explode(span(across)))
        .withColumn("_d", distance)
        .where(F.col("_d") <= shelf)
        .select((F.col("row") + F.col("_dr")).alias("row"), (F.col("col") + F.col("_dc")).alias("col"), "_d")
        .groupBy("row", "col")
        .agg(F.min("_d").alias("distance_deg"))
    )
    band = F.when(F.col("distance_deg") <= near, "nearshore").otherwise("shelf")
    return (
        grid.select("row", "col").join(reached, ["row", "col"]).join(cells, ["row", "col"], "left_anti").withColumn("band", band)
    )
