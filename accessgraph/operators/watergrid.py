"""Water grids, cost distance on them, and route alternatives.

Costs spread in rounds over square blocks of cells. Every task works on the
bounded array of one block of one route, a round carries a route across a whole
block instead of one cell, and only border costs pass between rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accessgraph.functions import geo
from accessgraph.operators.spatial import nearest_water, paths_distinct, points_on_cover, points_on_land, straight_routes
from accessgraph.session import cut_lineage, written

BLOCK = 64
# Cost in hundredths of entering a cell, also on the wrong and on the wanted side.
STEP_COST, AWAY_COST, TOWARDS_COST = 100, 155, 92
SNAP_DEG, SNAP_CELLS = 0.18, 20
BIASES = ("shortest", "north", "south")
# Directions as bits of a cell's open sides, with the step they take.
RIGHT, LEFT, UP, DOWN = 1, 2, 4, 8
NEVER = 99
STEPS = ((RIGHT, 0, 1), (LEFT, 0, -1), (UP, 1, 0), (DOWN, -1, 0))


@dataclass(frozen=True)
class WaterGrid:
    """Points of a grid over a box; row 0 is the southern edge."""

    west: float
    south: float
    dlon: float
    dlat: float
    rows: int
    cols: int

    def lon(self, col: Column | str = "col") -> Column:
        return F.lit(self.west) + F.col(col) * self.dlon if isinstance(col, str) else F.lit(self.west) + col * self.dlon

    def lat(self, row: Column | str = "row") -> Column:
        return F.lit(self.south) + F.col(row) * self.dlat if isinstance(row, str) else F.lit(self.south) + row * self.dlat


def grid_over(bbox: tuple[float, float, float, float], step: float, pad: float = 0.0, min_cells: int = 2) -> WaterGrid:
    """A grid of about ``step`` degrees over a padded box, both edges on grid points."""
    west, south, east, north = bbox[0] - pad, bbox[1] - pad, bbox[2] + pad, bbox[3] + pad
    width, height = max(east - west, 0.01), max(north - south, 0.01)
    cols, rows = (max(min_cells, math.ceil(side / step) + 1) for side in (width, height))
    return WaterGrid(west, south, width / (cols - 1), height / (rows - 1), rows, cols)


def water_cells(spark: SparkSession, grid: WaterGrid, index: DataFrame, cover: DataFrame | None = None) -> DataFrame:
    """Grid points (row, col) on water; a cover of the index that is there already is not made again."""
    ids = spark.range(grid.rows * grid.cols)
    points = ids.select(
        F.floor(F.col("id") / grid.cols).cast("int").alias("row"), (F.col("id") % grid.cols).cast("int").alias("col")
    )
    placed = points.withColumn("longitude", grid.lon()).withColumn("latitude", grid.lat())
    return points_on_land(placed, index, off=True) if cover is None else points_on_cover(placed, cover, off=True)


def water_links(cells: DataFrame, grid: WaterGrid, index: DataFrame, cover: DataFrame | None = None) -> DataFrame:
    """Links (row, col, to_row, to_col) to the right and up, clear of land at 25, 50 and 75 %."""
    here = cells.select("row", "col")
    to_right = here.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), "row", (F.col("col") - 1).alias("col"))
    to_up = here.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), (F.col("row") - 1).alias("row"), "col")
    pairs = to_right.unionByName(to_up).join(here, ["row", "col"], "left_semi")
    share = F.col("_t")
    samples = pairs.withColumn("_t", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).select(
        "row",
        "col",
        "to_row",
        "to_col",
        (grid.lon() + (grid.lon("to_col") - grid.lon()) * share).alias("longitude"),
        (grid.lat() + (grid.lat("to_row") - grid.lat()) * share).alias("latitude"),
    )
    link = ["row", "col", "to_row", "to_col"]
    land = points_on_land(samples, index) if cover is None else points_on_cover(samples, cover)
    blocked = land.select(*link).distinct()
    return pairs.join(blocked, link, "left_anti").select(*link)


def _block(column: str) -> Column:
    return F.floor(F.col(column) / BLOCK).cast("int")


def grid_blocks(cells: DataFrame, links: DataFrame) -> DataFrame:
    """One row per block: ``sides`` holds the open directions of each cell, ``wet`` marks water."""
    forward = F.when(F.col("to_col") > F.col("col"), RIGHT).otherwise(UP)
    backward = F.when(F.col("to_col") > F.col("col"), LEFT).otherwise(DOWN)
    sides = (
        links.select("row", "col", forward.alias("side"))
        .unionByName(links.select(F.col("to_row").alias("row"), F.col("to_col").alias("col"), backward.alias("side")))
        .groupBy("row", "col")
        .agg(F.bit_or("side").alias("sides"))
    )
    open_cells = cells.select("row", "col").join(sides, ["row", "col"], "left")
    slot = (F.col("row") % BLOCK * BLOCK + F.col("col") % BLOCK).alias("slot")
    return open_cells.groupBy(_block("row").alias("br"), _block("col").alias("bc")).agg(
        F.collect_list(F.struct(slot, F.coalesce("sides", F.lit(0)).alias("sides"))).alias("cells")
    )


FAR = np.iinfo(np.int32).max
CELL_ID = "row int, col int, part long, leaves int"


def _entry_costs(grid: WaterGrid, row: np.ndarray, mid_lat: float, bias: str) -> np.ndarray:
    """Cost of entering a cell of each row, in hundredths."""
    if bias == "shortest":
        return np.full(len(row), STEP_COST, np.int64)
    delta = grid.south + row * grid.dlat - mid_lat
    wrong = delta < 0 if bias == "north" else delta > 0
    return np.where(wrong, AWAY_COST, TOWARDS_COST).astype(np.int64)


def _layouts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Open sides of the cells of each block, a byte each; -1 on land."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            sides = np.full(BLOCK * BLOCK, -1, np.int8)
            for cell in r.cells:
                sides[cell["slot"]] = cell["sides"]
            rows.append((r.br, r.bc, sides.tobytes()))
        yield pd.DataFrame(rows, columns=["br", "bc", "sides"])


def _moved(values: np.ndarray, dr: int, dc: int, empty) -> np.ndarray:
    """``values`` seen from the cell one step on."""
    out = np.full_like(values, empty)
    out[max(dr, 0) : BLOCK + min(dr, 0), max(dc, 0) : BLOCK + min(dc, 0)] = values[
        max(-dr, 0) : BLOCK + min(-dr, 0), max(-dc, 0) : BLOCK + min(-dc, 0)
    ]
    return out


def _ahead(br: int, bc: int, goal_row: int, goal_col: int) -> np.ndarray:
    """The least cost from every cell of a block to a goal."""
    row, col = br * BLOCK + np.arange(BLOCK), bc * BLOCK + np.arange(BLOCK)
    return (np.abs(row - goal_row)[:, None] + np.abs(col - goal_col)[None, :]).astype(np.int64) * TOWARDS_COST


def _spread(
    sides: np.ndarray, entries, enter: np.ndarray, ahead: np.ndarray | None = None, goal: tuple[int, int] | None = None, limit: int = int(FAR)
) -> np.ndarray:
    """Least cost of every cell of a block from its entering costs, by sweeps over the whole block.

    With ``ahead``, cells from which a goal cannot be reached at ``limit``, or at
    the cost it has by then as ``goal`` of this block, are left out.
    """
    cost = np.full((BLOCK, BLOCK), FAR, np.int64)
    for m in entries:
        r, c = divmod(int(m["slot"]), BLOCK)
        if sides[r, c] >= 0:
            cost[r, c] = min(cost[r, c], m["cost"])
    while True:
        before = cost.copy()
        for side, dr, dc in STEPS:
            open_cost = np.where((sides >= 0) & (sides & side > 0), cost, FAR)
            reach = _moved(open_cost, dr, dc, FAR)
            np.minimum(cost, np.where(reach < FAR, reach + enter[1:-1, None], FAR), out=cost)
        if ahead is not None:
            limit = limit if goal is None else min(limit, int(cost[goal]))
            cost[cost + ahead > limit] = FAR
        if (before == cost).all():
            return cost


def _arrivals(sides: np.ndarray, cost: np.ndarray, enter: np.ndarray, br: int, bc: int) -> list[dict]:
    """Costs with which the block's border cells enter the cells next to the block."""
    out = []
    for side, dr, dc in STEPS:
        edge = {RIGHT: np.s_[:, -1], LEFT: np.s_[:, 0], UP: np.s_[-1, :], DOWN: np.s_[0, :]}[side]
        own, known = sides[edge], cost[edge]
        for k in np.flatnonzero((own >= 0) & (own & side > 0) & (known < FAR)):
            r, c = (k, BLOCK - 1 if dc > 0 else 0) if dc else (BLOCK - 1 if dr > 0 else 0, k)
            out.append(
                {
                    "row": int(br * BLOCK + r + dr), "col": int(bc * BLOCK + c + dc),
                    "cost": int(known[k] + enter[r + dr + 1]), "came": side,
                }
            )
    return out


def _came(sides: np.ndarray, cost: np.ndarray, entries, enter: np.ndarray) -> np.ndarray:
    """The least direction by which a cell is entered at its least cost; 0 at the source, ``NEVER`` where nothing arrives.

    Steps inside the block and arrivals from outside count alike, so the choice
    does not depend on where blocks end.
    """
    came = np.full((BLOCK, BLOCK), NEVER, np.int32)
    for side, dr, dc in STEPS:
        open_cost = np.where((sides >= 0) & (sides & side > 0), cost, FAR)
        reach = _moved(open_cost, dr, dc, FAR)
        hit = (reach < FAR) & (reach + enter[1:-1, None] == cost)
        came = np.where(hit, np.minimum(came, side), came)
    for m in entries:
        r, c = divmod(int(m["slot"]), BLOCK)
        if cost[r, c] == m["cost"]:
            came[r, c] = min(came[r, c], m["came"])
    return came


def _blocks_at_work(grid: WaterGrid, final: bool):
    """Spread the entries of each (route, block) row: its arrivals elsewhere, or at the end its cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                sides = np.frombuffer(r.sides, np.int8).reshape(BLOCK, BLOCK)
                enter = _entry_costs(grid, r.br * BLOCK + np.arange(-1, BLOCK + 1), r.mid_lat, r.bias)
                held = r.goal_row // BLOCK == r.br and r.goal_col // BLOCK == r.bc
                at = (int(r.goal_row) % BLOCK, int(r.goal_col) % BLOCK) if held else None
                ahead = _ahead(r.br, r.bc, r.goal_row, r.goal_col) if r.goal_row >= 0 else None
                cost = _spread(sides, r.entries, enter, ahead, at, int(r.limit))
                own = tuple(getattr(r, c) for c in (*ROUTE, "br", "bc"))
                if final:
                    rows.append((*own, cost.ravel().tolist(), _came(sides, cost, r.entries, enter).astype(np.int8).tobytes()))
                else:
                    goal = int(cost[at]) if held else int(FAR)
                    rows.append((*own, _arrivals(sides, cost, enter, r.br, r.bc), goal))
            names = [*ROUTE, "br", "bc", *(["cost", "came"] if final else ["sent", "goal"])]
            yield pd.DataFrame(rows, columns=names)

    return run


def _block_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The water cells of blocks with the least cell they are linked to inside the block, and the sides on which they leave it."""
    for pdf in batches:
        made = []
        for r in pdf.itertuples(index=False):
            sides = np.frombuffer(r.sides, np.int8).reshape(BLOCK, BLOCK)
            part = np.where(sides >= 0, np.arange(BLOCK * BLOCK).reshape(BLOCK, BLOCK), BLOCK * BLOCK)
            while True:
                before = part.copy()
                for side, dr, dc in STEPS:
                    np.minimum(part, _moved(np.where(sides & side > 0, part, BLOCK * BLOCK), dr, dc, BLOCK * BLOCK), out=part, where=sides >= 0)
                if (before == part).all():
                    break
            leaves = np.zeros((BLOCK, BLOCK), np.int32)
            leaves[:, -1] |= sides[:, -1] & RIGHT
            leaves[-1, :] |= sides[-1, :] & UP
            row, col = np.nonzero(sides >= 0)
            least = part[row, col]
            made.append(pd.DataFrame({
                "row": row + r.br * BLOCK, "col": col + r.bc * BLOCK,
                "part": (least // BLOCK + r.br * BLOCK).astype(np.int64) * 2**32 + least % BLOCK + r.bc * BLOCK, "leaves": leaves[row, col],
            }))
        if made:
            yield pd.concat(made)


def water_parts(blocks: DataFrame) -> DataFrame:
    """(row, col, sea): water cells by the sea they are in; cells of one sea reach each other.

    Blocks are labelled inside, and only the parts of blocks that touch each
    other go through the rounds, in which labels also follow the labels they have.
    """
    layouts = blocks.select("br", "bc", "cells").mapInPandas(_layouts, "br int, bc int, sides binary")
    cells = written(layouts.mapInPandas(_block_parts, CELL_ID))
    to = lambda side, dr, dc: cells.where(F.col("leaves").bitwiseAND(F.lit(side)) > 0).select(
        (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.col("part").alias("a")
    )
    met = to(RIGHT, 0, 1).unionByName(to(UP, 1, 0)).join(cells, ["row", "col"]).select("a", F.col("part").alias("b")).distinct()
    links = written(met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    seas = written(links.select(F.col("a").alias("part"), F.col("a").alias("sea")).distinct())
    while True:
        offered = links.join(seas, F.col("b") == F.col("part")).groupBy("a").agg(F.min("sea").alias("_o"))
        lower = seas.join(offered, F.col("part") == F.col("a")).select("part", F.col("sea").alias("_was"), F.least("sea", "_o").alias("_to"))
        onward = seas.select(F.col("part").alias("_to"), F.col("sea").alias("_next"))
        merged = written(lower.join(onward, "_to").select("part", "_was", F.least("_to", "_next").alias("sea")))
        seas = merged.select("part", "sea")
        if merged.where(F.col("sea") != F.col("_was")).isEmpty():
            break
    return cells.join(seas, "part", "left").select("row", "col", F.coalesce("sea", "part").alias("sea"))


# A route without goal has the goal (-1, -1), which no block holds.
ROUTE = ("route_id", "mid_lat", "bias", "goal_row", "goal_col")
PLACE = "route_id string, mid_lat double, bias string, goal_row int, goal_col int, br int, bc int"
SENT = f"{PLACE}, sent array<struct<row:int,col:int,cost:int,came:int>>, goal int"
STATE = f"{PLACE}, cost array<int>, came binary"


def water_cost_distance(blocks: DataFrame, sources: DataFrame, grid: WaterGrid) -> DataFrame:
    """Block states with the least cost, in hundredths, from each source to every water cell it can reach.

    ``sources`` has (route_id, row, col, mid_lat, bias) and may have (goal_row,
    goal_col). Entering a cell costs one, or more or less by its side of
    ``mid_lat`` under a north or south bias. With a goal, a route is not spread
    to where it cannot reach the goal at the least cost found so far.
    Rounds exchange only the costs with which blocks enter each other, a narrow
    table, until none improves; the cells inside are filled in once at the end.
    """
    key = [*ROUTE, "row", "col"]

    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rounds go on from written tables: a checkpoint keeps the size that Catalyst guesses, and guesses multiply with every join.
    layouts = written(blocks.select("br", "bc", "cells").mapInPandas(_layouts, "br int, bc int, sides binary"))

    def work(entries: DataFrame) -> DataFrame:
        slot = (F.col("row") % BLOCK * BLOCK + F.col("col") % BLOCK).cast("int").alias("slot")
        placed = entries.select(*ROUTE, _block("row").alias("br"), _block("col").alias("bc"), slot, "cost", "came")
        grouped = placed.groupBy(*ROUTE, "br", "bc").agg(F.collect_list(F.struct("slot", "cost", "came")).alias("entries"))
        limit = F.lit(int(FAR)).alias("limit")
        if limits is not None:
            grouped, limit = grouped.join(limits, "route_id"), "limit"
        asked = grouped.join(layouts, ["br", "bc"]).select(*ROUTE, "br", "bc", "sides", "entries", limit)
        # What is read says little about the work; rows are dealt over tasks, which are not merged.
        return asked.repartition(tasks, "route_id", "br", "bc")

    for c in ("goal_row", "goal_col"):
        if c not in sources.columns:
            sources = sources.withColumn(c, F.lit(-1))
    known = written(sources.select(*key, F.lit(0).alias("cost"), F.lit(0).alias("came")).distinct())
    fresh, limits = known, None
    ahead = F.abs(F.col("row") - F.col("goal_row")) + F.abs(F.col("col") - F.col("goal_col"))
    while True:
        place = [*ROUTE, _block("row").alias("br"), _block("col").alias("bc")]
        touched = fresh.select(*place).distinct()
        again = known.withColumns({"br": _block("row"), "bc": _block("col")}).join(touched, [*ROUTE, "br", "bc"], "left_semi")
        sent = written(work(again).mapInPandas(_blocks_at_work(grid, False), SENT))
        met = sent.select("route_id", F.col("goal").alias("limit"))
        met = met if limits is None else met.unionByName(limits)
        limits = written(met.groupBy("route_id").agg(F.min("limit").alias("limit")))
        offers = (
            sent.select(*ROUTE, F.explode("sent").alias("_s"))
            .select(*ROUTE, "_s.*")
            .join(limits, "route_id")
            .where((F.col("goal_row") < 0) | (F.col("cost") + ahead * TOWARDS_COST <= F.col("limit")))
        )
        best = offers.groupBy(*key).agg(F.min(F.struct("cost", "came")).alias("_n"))
        held = known.select(*key, F.struct("cost", "came").alias("_o"))
        merged = written(
            held.join(best, key, "full").select(
                *key, F.least("_o", "_n").alias("_b"), (F.col("_o").isNull() | (F.col("_n") < F.col("_o"))).alias("_new")
            )
        )
        known = merged.select(*key, "_b.cost", "_b.came")
        fresh = merged.where("_new").select(*key)
        if fresh.isEmpty():
            return work(known).mapInPandas(_blocks_at_work(grid, True), STATE)


def cell_costs(state: DataFrame) -> DataFrame:
    """Rows (route_id, row, col, cost) of the reached cells, the cost in hundredths."""
    return (
        state.select("route_id", "br", "bc", F.posexplode("cost").alias("slot", "cost"))
        .where(F.col("cost") < int(FAR))
        .select(
            "route_id",
            (F.col("br") * BLOCK + F.floor(F.col("slot") / BLOCK)).cast("int").alias("row"),
            (F.col("bc") * BLOCK + F.col("slot") % BLOCK).cast("int").alias("col"),
            "cost",
        )
    )


def _walk():
    block, back = BLOCK, {side: (-dr, -dc) for side, dr, dc in STEPS}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                row, col, cells, more = int(r.row), int(r.col), [], True
                if r.came[(row % block) * block + col % block] == NEVER:
                    continue
                while True:
                    cells.append({"row": row, "col": col})
                    came = int(r.came[(row % block) * block + col % block])
                    if came == 0:
                        more = False
                        break
                    dr, dc = back[came]
                    row, col = row + dr, col + dc
                    if row // block != r.br or col // block != r.bc:
                        break
                rows.append((r.route_id, int(r.piece), cells, row, col, more))
            yield pd.DataFrame(rows, columns=["route_id", "piece", "cells", "row", "col", "more"])

    return run


def trace_paths(state: DataFrame, goals: DataFrame) -> DataFrame:
    """Path pieces (route_id, piece, cells) from each goal back to its source, one block per round."""
    key = ["route_id", "br", "bc"]
    # Blocks of routes compress well; they are merged, not broadcast.
    table = state.select(*key, "came").hint("merge")
    ahead = goals.select("route_id", "row", "col", F.lit(0).alias("piece"))
    pieces = None
    while True:
        step = written(
            ahead.withColumn("br", _block("row"))
            .withColumn("bc", _block("col"))
            .join(table, key)
            .select("route_id", "piece", "row", "col", "br", "bc", "came")
            .mapInPandas(_walk(), "route_id string, piece int, cells array<struct<row:int,col:int>>, row int, col int, more boolean")
        )
        done = step.select("route_id", "piece", "cells")
        pieces = done if pieces is None else pieces.unionByName(done)
        ahead = step.where("more").select("route_id", "row", "col", (F.col("piece") + 1).alias("piece"))
        if ahead.isEmpty():
            return pieces


def snap_to_grid(points: DataFrame, cells: DataFrame, grid: WaterGrid, key: str) -> DataFrame:
    """(key, row, col): the nearest water cell; squares of growing radius are tried in stages."""
    limit = max(SNAP_CELLS, math.ceil(SNAP_DEG / max(grid.dlon, grid.dlat)))
    clip = lambda v, top: F.greatest(F.lit(0), F.least(F.lit(top - 1), F.round(v).cast("int")))
    home = points.select(
        key,
        clip((F.col("latitude") - grid.south) / grid.dlat, grid.rows).alias("_r"),
        clip((F.col("longitude") - grid.west) / grid.dlon, grid.cols).alias("_c"),
    )
    wet, left, found = cells.select("row", "col"), home, None
    stages = sorted({0, 2, 8, limit} & set(range(limit + 1)))
    for reach in stages:
        span = F.sequence(F.lit(-reach), F.lit(reach))
        near = (
            left.withColumn("_dr", F.explode(span))
            .withColumn("_dc", F.explode(span))
            .withColumn("row", F.col("_r") + F.col("_dr"))
            .withColumn("col", F.col("_c") + F.col("_dc"))
            .join(wet, ["row", "col"])
        )
        square = F.greatest(F.abs("_dr"), F.abs("_dc"))
        apart = F.col("_dr") * F.col("_dr") + F.col("_dc") * F.col("_dc")
        # The innermost square with water decides, then the distance inside it.
        hit = cut_lineage(
            near.groupBy(key)
            .agg(F.min(F.struct(square.alias("q"), apart.alias("d"), "row", "col")).alias("_b"))
            .select(key, "_b.row", "_b.col")
        )
        found = hit if found is None else found.unionByName(hit)
        left = left.join(hit.select(key), key, "left_anti")
    return found


def plan_routes(
    pairs: DataFrame, grid: WaterGrid, cells: DataFrame, blocks: DataFrame, polygons: DataFrame, biases: Sequence[str] = BIASES,
    no_route: str = "Straight preview, no way by water", index: DataFrame | None = None, cover: DataFrame | None = None,
) -> DataFrame:
    """Alternative water routes for pairs (od_id, from_lon, from_lat, to_lon, to_lat).

    An alternative is kept when its corridor differs from every one kept before
    it; a pair without any water path gets the straight line. ``position``
    counts a pair's routes from 1 by distance.
    """
    ends = pairs.select("od_id", F.explode(F.array(*[
        F.struct(F.lit(e).alias("end"), F.col(f"{e}_lon").alias("longitude"), F.col(f"{e}_lat").alias("latitude"))
        for e in ("from", "to")
    ])).alias("_e")).select(F.concat_ws("|", "od_id", "_e.end").alias("point_id"), "od_id", "_e.*")
    shore = nearest_water(ends, polygons, index=index, cover=cover)
    moved = ends.join(shore, "point_id").select(
        "point_id", "od_id", "end",
        F.coalesce("water_lon", "longitude").alias("longitude"), F.coalesce("water_lat", "latitude").alias("latitude"),
    )
    moved = cut_lineage(moved)
    snapped = moved.join(snap_to_grid(moved, cells, grid, "point_id"), "point_id")
    side = lambda e: snapped.where(F.col("end") == e).select(
        "od_id", F.col("row").alias(f"{e}_row"), F.col("col").alias(f"{e}_col"), F.col("latitude").alias(f"{e}_shore")
    )
    # Ends in different seas have no way by water, and none is looked for.
    seas = written(water_parts(blocks))
    sea = lambda e: seas.select(F.col("row").alias(f"{e}_row"), F.col("col").alias(f"{e}_col"), F.col("sea").alias(f"_{e}"))
    linked = side("from").join(side("to"), "od_id").join(sea("from"), ["from_row", "from_col"]).join(sea("to"), ["to_row", "to_col"])
    routed = linked.where(F.col("_from") == F.col("_to")).drop("_from", "_to").withColumn(
        "bias", F.explode(F.array(*[F.lit(b) for b in biases]))
    ).withColumn("route_id", F.concat_ws("|", "od_id", "bias"))
    routed = cut_lineage(routed)
    sources = routed.select(
        "route_id", F.col("from_row").alias("row"), F.col("from_col").alias("col"),
        ((F.col("from_shore") + F.col("to_shore")) / 2).alias("mid_lat"), "bias",
        F.col("to_row").alias("goal_row"), F.col("to_col").alias("goal_col"),
    )
    state = written(water_cost_distance(blocks, sources, grid))
    goals = routed.select("route_id", F.col("to_row").alias("row"), F.col("to_col").alias("col"))
    pieces = trace_paths(state, goals)
    # A path is one route of one pair, at most as long as the grid has cells on it.
    backwards = pieces.groupBy("route_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "cells"))), lambda p: p["cells"])).alias("_cells")
    )
    spot = lambda c: F.struct(grid.lon(c["col"]).alias("lon"), grid.lat(c["row"]).alias("lat"))
    water = backwards.select("route_id", F.transform(F.reverse("_cells"), spot).alias("water"), F.size("_cells").alias("cell_count"))
    paths = routed.select("od_id", "bias", "route_id").join(water, "route_id").join(pairs, "od_id")
    start = F.array(F.struct(F.col("from_lon").alias("lon"), F.col("from_lat").alias("lat")))
    end = F.array(F.struct(F.col("to_lon").alias("lon"), F.col("to_lat").alias("lat")))
    whole = paths.withColumn("coordinates", F.array_distinct(F.concat(start, "water", end)))
    hop = lambda i: geo.haversine_m(
        F.col("coordinates")[i - 1]["lat"], F.col("coordinates")[i - 1]["lon"], F.col("coordinates")[i]["lat"], F.col("coordinates")[i]["lon"]
    )
    length = F.when(
        F.size("coordinates") > 1,
        F.aggregate(F.sequence(F.lit(1), F.size("coordinates") - 1), F.lit(0.0), lambda total, i: total + hop(i)),
    ).otherwise(0.0)
    graded = whole.withColumn("distance_m", length).select(
        "od_id", "bias", "coordinates", "distance_m", "cell_count"
    )
    # At most three alternatives per pair: pivot them and compare side by side.
    body = F.struct("bias", "coordinates", "distance_m", "cell_count")
    wide = graded.groupBy("od_id").agg(*[F.max(F.when(F.col("bias") == b, body)).alias(b) for b in biases])
    kept: list[Column] = []
    for b in biases:
        new = F.col(b).isNotNull()
        for earlier in kept:
            apart = paths_distinct(earlier["coordinates"], F.col(b)["coordinates"])
            new = new & (earlier.isNull() | apart)
        kept.append(F.when(new, F.col(b)))
    routes = wide.select("od_id", F.explode(F.array_compact(F.array(*kept))).alias("_r")).select(
        "od_id", "_r.*", F.lit("water").alias("mode"), F.lit(None).cast("string").alias("warning")
    )
    bare = straight_routes(
        pairs.join(routes.select("od_id"), "od_id", "left_anti"), no_route
    ).select("od_id", "bias", "coordinates", "distance_m", "cell_count", "mode", "warning")
    by_length = Window.partitionBy("od_id").orderBy("distance_m", "bias")
    return routes.unionByName(bare).withColumn("position", F.row_number().over(by_length))
