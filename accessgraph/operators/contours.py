"""Contour lines of a grid as ordered vertex rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessgraph.session import written

# Corners of a square of four cell centres, clockwise in (row, col) steps; side i runs from corner i to the next.
CORNERS = ((0, 0), (0, 1), (1, 1), (1, 0))
# Rows and columns are numbered from 0 and stay below two to this power.
INDEX_BITS = 28


def _squares(grid: DataFrame, value: str) -> DataFrame:
    """(row, col, v0..v3): the corner values of every square whose four cells have one."""
    cells = grid.select("row", "col", F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    spots = F.array(
        *[
            F.struct((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.lit(i).alias("i"))
            for i, (dr, dc) in enumerate(CORNERS)
        ]
    )
    dealt = cells.select("_v", F.explode(spots).alias("_s")).select("_s.*", "_v")
    corner = lambda i: F.max(F.when(F.col("i") == i, F.col("_v"))).alias(f"v{i}")
    made = dealt.groupBy("row", "col").agg(*[corner(i) for i in range(4)])
    return made.where(F.col("v0").isNotNull() & F.col("v1").isNotNull() & F.col("v2").isNotNull() & F.col("v3").isNotNull())


def _side(i: int) -> Column:
    """A grid side's number, the same from both squares that share it: level, along a row or a column, row, column."""
    lying, dr, dc = ((0, 0, 0), (1, 0, 1), (0, 1, 0), (1, 0, 0))[i]
    kind = F.col("_nth") * 2 + lying
    return F.shiftleft(F.shiftleft(kind.cast("long"), INDEX_BITS) + F.col("row") + dr, INDEX_BITS) + F.col("col") + dc


def contour_segments(grid: DataFrame, levels: Sequence[float], value: str = "elev") -> DataFrame:
    """Directed segments (level, a, b, x1, y1, x2, y2) between the numbers of the grid sides that a level crosses.

    Sides are crossed where one end is at the level or above and the other
    below; the place is interpolated. x counts columns and y rows of cell
    centres. A segment has the higher ground on its left as rows grow
    downwards, so a side ends one segment and starts one at most. In a saddle
    the mean of the four corners decides which corners are joined.
    """
    wanted = F.array(*[F.lit(float(v)) for v in sorted(set(levels))])
    corners = [F.col(f"v{i}") for i in range(4)]
    low, high = F.least(*corners), F.greatest(*corners)
    numbered = F.transform(wanted, lambda v, i: F.struct(v.alias("level"), i.alias("_nth")))
    crossed = F.filter(numbered, lambda v: (v["level"] > low) & (v["level"] <= high))
    rows = _squares(grid, value).withColumn("_l", F.explode(crossed)).select("*", "_l.*").drop("_l")
    level = F.col("level")
    above = [v >= level for v in corners]
    rises = [~above[i] & above[(i + 1) % 4] for i in range(4)]
    falls = [above[i] & ~above[(i + 1) % 4] for i in range(4)]
    saddle = (above[0] == above[2]) & (above[1] == above[3]) & (above[0] != above[1])
    joined = (corners[0] + corners[1] + corners[2] + corners[3]) / 4 >= level

    def spot(i: int) -> tuple[Column, Column, Column]:
        (r0, c0), (r1, c1) = CORNERS[i], CORNERS[(i + 1) % 4]
        # The same end comes first from both squares, so both find the same place.
        first, last = (i, (i + 1) % 4) if i in (0, 1) else ((i + 1) % 4, i)
        t = F.try_divide(level - corners[first], corners[last] - corners[first])
        across, down = abs(c1 - c0), abs(r1 - r0)
        x = F.col("col") + min(c0, c1) + (t if across else F.lit(0.0))
        y = F.col("row") + min(r0, r1) + (t if down else F.lit(0.0))
        return _side(i), x, y

    sides, xs, ys = (F.array(*c) for c in zip(*[spot(i) for i in range(4)], strict=True))
    fall = F.coalesce(*[F.when(f, F.lit(i)) for i, f in enumerate(falls)])
    pairs = F.array(
        *[
            F.when(
                rises[i],
                F.struct(
                    F.lit(i).alias("a"),
                    F.when(saddle, F.when(joined, F.lit((i + 3) % 4)).otherwise(F.lit((i + 1) % 4))).otherwise(fall).alias("b"),
                ),
            )
            for i in range(4)
        ]
    )
    cut = rows.select("level", sides.alias("_n"), xs.alias("_x"), ys.alias("_y"), F.explode(F.array_compact(pairs)).alias("_s"))
    end = lambda c, e: F.col(c)[F.col(f"_s.{e}")]
    return cut.select(
        "level",
        *[end("_n", e).alias(e) for e in "ab"],
        *[end(f"_{c}", e).alias(f"{c}{i}") for i, e in ((1, "a"), (2, "b")) for c in "xy"],
    )


def _ranked(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For (id, prev): ranked rows (id, head, steps), and the rest (id, low), which lies on rings.

    Every node jumps to where its target jumps to, so the number of rounds is
    the logarithm of the longest line. ``low`` is the least id passed over. A
    round that finds no head and changes no ``low`` is the last: what is left
    goes round in rings, and each node knows the least id of its ring. Rounds go
    on from tables: checkpoints add up the partitions and plans of all rounds,
    and each late round takes twice the time of the one before.
    """
    nobody = F.lit(None).cast("long")
    state = nodes.select(
        "id",
        "prev",
        F.when(F.col("prev").isNull(), F.col("id")).otherwise(nobody).alias("head"),
        F.when(F.col("prev").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("steps"),
        F.col("id").alias("low"),
    )
    state = written(state.withColumn("changed", F.col("prev").isNotNull()))
    while not state.where("changed").isEmpty():
        live, target = state.where(F.col("prev").isNotNull()), state.select(*[F.col(c).alias(f"_{c}") for c in ("id", "prev", "head", "steps", "low")])
        least = F.least("low", "_low")
        moved = live.join(target.hint("merge"), F.col("prev") == F.col("_id")).select(
            "id",
            F.col("_prev").alias("prev"),
            F.col("_head").alias("head"),
            (F.col("steps") + F.col("_steps")).alias("steps"),
            least.alias("low"),
            (F.col("_prev").isNull() | (least != F.col("low"))).alias("changed"),
        )
        done = state.where(F.col("prev").isNull()).withColumn("changed", F.lit(False))
        state = written(done.unionByName(moved))
    return state.where(F.col("prev").isNull()).select("id", "head", "steps"), state.where(F.col("prev").isNotNull()).select("id", "low")


def contour_lines(grid: DataFrame, levels: Sequence[float], value: str = "elev") -> DataFrame:
    """Vertices (level, line, position, x, y, closed) of the contour lines at the ``levels``.

    Segments are chained by pointer doubling. ``line`` is the number of
    the side where the line begins; a closed one begins at its least side and ends in a repeated
    first vertex. Every segment lies between two neighbouring positions of one
    line. No line is gathered in a task, so its length is not bounded.
    """
    segments = written(contour_segments(grid, levels, value))
    starts = segments.select(F.col("a").alias("id"), "level", F.col("x1").alias("x"), F.col("y1").alias("y"))
    ends = segments.select(F.col("b").alias("id"), "level", F.col("x2").alias("x"), F.col("y2").alias("y"))
    places = starts.unionByName(ends).groupBy("id").agg(*[F.min(c).alias(c) for c in ("level", "x", "y")])
    before = segments.select(F.col("b").alias("id"), F.col("a").alias("prev"))
    nodes = written(places.select("id").join(before, "id", "left"))
    ranked, rings = _ranked(nodes)
    lines = ranked.withColumn("closed", F.lit(False))
    rings = written(rings)
    if not rings.isEmpty():
        opened = nodes.join(rings, "id").select("id", F.when(F.col("id") != F.col("low"), F.col("prev")).alias("prev"))
        chained = _ranked(opened)[0]
        lasts = chained.groupBy("head").agg((F.max("steps") + 1).alias("steps")).select(F.col("head").alias("id"), "head", "steps")
        lines = lines.unionByName(chained.unionByName(lasts).withColumn("closed", F.lit(True)))
    return lines.join(places, "id").select(
        "level", F.col("head").alias("line"), F.col("steps").alias("position"), "x", "y", "closed"
    )


def line_summary(vertices: DataFrame) -> DataFrame:
    """(level, line, vertices, closed) of every line."""
    return vertices.groupBy("level", "line").agg(F.count(F.lit(1)).alias("vertices"), F.bool_or("closed").alias("closed"))
