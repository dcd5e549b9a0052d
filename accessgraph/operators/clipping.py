"""Lines cut exactly where they meet land."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accessgraph.functions import geo
from accessgraph.operators.spatial import ENDS, index_polygons, path_hops, points_on_land, polygon_edges
from accessgraph.operators.windows import previous_row, running_max
from accessgraph.session import cut_lineage

# Side of the cells in which hops meet edges, and the shortest piece that counts, in degrees.
CUT_CELL_DEG, SHORTEST_DEG = 0.05, 1e-9
HOP_CHUNK = 10_000


def _listed(segments: DataFrame, cell: float) -> DataFrame:
    """Segments under every cell of their box."""
    span = lambda a, b: F.explode(F.sequence(geo.cell(F.least(a, b), cell), geo.cell(F.greatest(a, b), cell)))
    return segments.withColumn("_cx", span("x1", "x2")).withColumn("_cy", span("y1", "y2"))


def _meeting_points() -> Column:
    """Where along the hop (x1, y1, x2, y2) it meets the edge (ax, ay, bx, by), as shares of its length.

    Hops along an edge meet it at the edge's ends.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    fx, fy = F.col("ax") - F.col("x1"), F.col("ay") - F.col("y1")
    cross, side, square = dx * ey - dy * ex, fx * dy - fy * dx, dx * dx + dy * dy
    t, u = F.try_divide(fx * ey - fy * ex, cross), F.try_divide(side, cross)
    along = lambda px, py: F.try_divide((px - F.col("x1")) * dx + (py - F.col("y1")) * dy, square)
    ends = F.filter(
        F.array(along(F.col("ax"), F.col("ay")), along(F.col("bx"), F.col("by"))), lambda s: (s >= 0) & (s <= 1)
    )
    nothing = F.array().cast("array<double>")
    return (
        F.when(square == 0, nothing)
        .when(cross != 0, F.when(t.between(0, 1) & u.between(0, 1), F.array(t)).otherwise(nothing))
        .when(side == 0, ends)
        .otherwise(nothing)
    )


LINE = "_line"


def _line_pieces(contours: DataFrame, polygons: DataFrame, key: str, cell: float) -> tuple[DataFrame, DataFrame]:
    """Hops (key, hop, _line) of lines, and the pieces (_line, t0, t1, x1, y1, x2, y2, on_land) of every line once.

    Hops in the same place are one line: it is cut once, however many share it.
    """
    hops = cut_lineage(path_hops(contours, key).select(key, "hop", *ENDS))
    lines = cut_lineage(hops.select(*ENDS).distinct().withColumn(LINE, F.monotonically_increasing_id()))
    shore = polygon_edges(polygons).select(*ENDS).distinct()
    edges = _listed(shore, cell).withColumnsRenamed({"x1": "ax", "y1": "ay", "x2": "bx", "y2": "by"})
    # Catalyst takes the listed edges for one row per edge; they are merged, not broadcast.
    met = _listed(lines, cell).join(edges.hint("merge"), ["_cx", "_cy"])
    cuts = met.select(LINE, F.explode(_meeting_points()).alias("t"))
    ends = lines.select(LINE, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    ordered = Window.partitionBy(LINE).orderBy("t")
    spans = cuts.unionByName(ends).distinct().withColumn("t1", F.lead("t").over(ordered)).where(F.col("t1").isNotNull())
    pieces = spans.withColumnRenamed("t", "t0").join(lines, LINE)
    x = lambda t: F.col("x1") + (F.col("x2") - F.col("x1")) * t
    y = lambda t: F.col("y1") + (F.col("y2") - F.col("y1")) * t
    middle = (F.col("t0") + F.col("t1")) / 2
    placed = pieces.select(
        LINE, "t0", "t1", *[f(F.col(t)).alias(f"{n}{i}") for i, t in ((1, "t0"), (2, "t1")) for n, f in (("x", x), ("y", y))],
        x(middle).alias("longitude"), y(middle).alias("latitude"),
    )
    placed = cut_lineage(placed.where(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) > SHORTEST_DEG))
    land = points_on_land(placed, index_polygons(polygons)).select(LINE, "t0").withColumn("on_land", F.lit(True))
    flagged = placed.drop("longitude", "latitude").join(land, [LINE, "t0"], "left")
    return hops.hint("merge").join(lines, ENDS).select(key, "hop", LINE), flagged.withColumn("on_land", F.coalesce("on_land", F.lit(False)))


def cut_pieces(contours: DataFrame, polygons: DataFrame, key: str = "contour_id", cell: float = CUT_CELL_DEG) -> DataFrame:
    """Pieces (key, hop, t0, t1, x1, y1, x2, y2, on_land) of lines (array of (lon, lat)) between all meetings with a shore.

    A piece lies wholly in land or wholly in sea, so its middle decides exactly,
    however thin the land is. Pieces shorter than ``SHORTEST_DEG`` are left out.
    """
    hops, pieces = _line_pieces(contours, polygons, key, cell)
    return hops.join(pieces, LINE).drop(LINE)


def clip_lines(contours: DataFrame, polygons: DataFrame, key: str = "contour_id", cell: float = CUT_CELL_DEG) -> DataFrame:
    """The parts of lines that lie in sea: pieces (key, part, hop, t0, t1, x1, y1, x2, y2).

    ``part`` is where the part begins, as (hop, t); pieces of one part follow
    each other by (hop, t0) without a gap.
    """
    wet = cut_pieces(contours, polygons, key, cell).where(~F.col("on_land")).drop("on_land")
    chunk = F.floor(F.col("hop") / F.lit(HOP_CHUNK))
    seen = previous_row(wet, [key], ["hop", "t0"], chunk, ["x2", "y2"])
    gap = F.hypot(F.col("x1") - F.col("prev.x2"), F.col("y1") - F.col("prev.y2"))
    begins = F.when(F.coalesce(gap > 2 * SHORTEST_DEG, F.lit(True)), F.struct("hop", F.col("t0").alias("t")))
    return running_max(seen.withColumn("_begin", begins).drop("prev"), [key], ["hop", "t0"], chunk, "_begin", "part").drop("_begin")


def line_vertices(pieces: DataFrame, key: str = "contour_id") -> DataFrame:
    """(key, part, hop, t, longitude, latitude): the vertices of clipped lines, in order of (hop, t)."""
    starts = pieces.select(key, "part", "hop", F.col("t0").alias("t"), F.col("x1").alias("longitude"), F.col("y1").alias("latitude"))
    last = pieces.groupBy(key, "part").agg(F.max_by(F.struct("hop", "t1", "x2", "y2"), F.struct("hop", "t0")).alias("_l"))
    ends = last.select(key, "part", "_l.hop", F.col("_l.t1").alias("t"), F.col("_l.x2").alias("longitude"), F.col("_l.y2").alias("latitude"))
    return starts.unionByName(ends)


def land_lengths(contours: DataFrame, polygons: DataFrame, key: str = "contour_id") -> DataFrame:
    """(key, on_land_m): how many metres of each line lie on land; lines without any are left out."""
    metres = geo.haversine_m(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"))
    hops, pieces = _line_pieces(contours, polygons, key, CUT_CELL_DEG)
    per_line = pieces.where("on_land").groupBy(LINE).agg(F.sum(metres).alias("_m"))
    return hops.join(per_line, LINE).groupBy(key).agg(F.sum("_m").alias("on_land_m"))
