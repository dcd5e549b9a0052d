"""Small squares of cells that land may leave open, and the samples around a place that lie in them.

A cell is cut into squares, one bit each. A square that lies wholly in one
polygon holds no water, so most samples around a place are left out by a look at
a bit, and only the others have to meet polygons.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Squares on a side of a cell, and the words of 64 bits that hold them.
SIDE = 16
WORDS = SIDE * SIDE // 64
# Edges so near to a square count as in it, in degrees; samples so near to a border of squares are always tested, in squares.
MARGIN_DEG, BORDER = 1e-9, 1e-6
# A sample is numbered by its ring, then by its place on it.
RING = 2**20


def _wholly_inside(row, cell: float) -> np.ndarray:
    """Which squares of the cell of an index row lie wholly in its polygon, by row and column."""
    scale, size = row.scale, cell / SIDE
    base_x, base_y = math.floor(row.cx / scale), math.floor(row.cy / scale)
    # Squares that the index row covers; none if it is smaller than a square.
    n = int(SIDE // scale)
    out = np.zeros((SIDE, SIDE), bool)
    if n == 0:
        return out
    first_x, first_y = int(row.cx * n - base_x * SIDE), int(row.cy * n - base_y * SIDE)
    west = (base_x * SIDE + first_x + np.tile(np.arange(n), n)) * size
    south = (base_y * SIDE + first_y + np.repeat(np.arange(n), n)) * size
    x, y, half = (west + size / 2)[:, None], (south + size / 2)[:, None], size / 2 + MARGIN_DEG
    x1, y1, x2, y2 = (np.asarray(v, float)[None, :] for v in (row.x1, row.y1, row.x2, row.y2))
    dx, dy = x2 - x1, y2 - y1
    apart = (
        (np.abs((x1 + x2) / 2 - x) > np.abs(dx) / 2 + half)
        | (np.abs((y1 + y2) / 2 - y) > np.abs(dy) / 2 + half)
        | (np.abs(dx * (y1 - y) - dy * (x1 - x)) > half * (np.abs(dx) + np.abs(dy)))
    )
    clear = apart.all(axis=1)
    clear &= (west >= row.west) & (west + size <= row.east) & (south >= row.south) & (south + size <= row.north)
    # The middle decides as any point of the index does: see ``spatial.inside``.
    at = lambda v: np.floor(v / cell * scale)
    with np.errstate(divide="ignore", invalid="ignore"):
        left = x < dx * (y - y1) / (dy + np.finfo(float).eps) + x1
    end = np.where(x1 > x2, y1, y2)
    crossing = (at(x1) > row.cx) != (at(x2) > row.cx)
    flips = (((y1 > y) != (y2 > y)) & left) != (crossing & (end > y) & (at(end) == row.cy))
    outer, hole, edge_ring = np.zeros(n * n, bool), np.zeros(n * n, bool), np.asarray(row.edge_ring)
    for k, (ring, odd) in enumerate(zip(row.ring, row.odd)):
        inside = (flips[:, edge_ring == k].sum(axis=1) % 2 == 1) != odd
        if ring == 0:
            outer |= inside
        else:
            hole |= inside
    out[first_y : first_y + n, first_x : first_x + n] = (clear & outer & ~hole).reshape(n, n)
    return out


def _squares_of_rows(cell: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                words = np.packbits(_wholly_inside(r, cell), bitorder="little").view(np.int64)
                rows.append((math.floor(r.cx / r.scale), math.floor(r.cy / r.scale), *words.tolist()))
            yield pd.DataFrame(rows, columns=["cx", "cy", *[f"w{i}" for i in range(WORDS)]])

    return run


def closed_squares(cover: DataFrame, cell: float) -> DataFrame:
    """(cx, cy, words): the squares of each cell that lie wholly in a polygon, one bit each; other cells have none."""
    words = [f"w{i}" for i in range(WORDS)]
    edged = F.exists("rings", lambda r: F.size(r["edges"]) > 0)
    ends = lambda c: F.flatten(F.transform("rings", lambda r: F.transform(r["edges"], lambda e: e[c])))
    numbered = F.flatten(F.transform("rings", lambda r, i: F.transform(r["edges"], lambda e: i)))
    rows = cover.where(edged | (F.col("scale") > 1)).select(
        "scale", "cx", "cy", "west", "south", "east", "north", F.col("rings.ring").alias("ring"), F.col("rings.odd").alias("odd"),
        numbered.alias("edge_ring"), *[ends(c).alias(c) for c in ("x1", "y1", "x2", "y2")],
    )
    # What is read says little about the work; tasks are not merged by it.
    tasks = int(cover.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    open_cells = rows.repartition(tasks).mapInPandas(_squares_of_rows(cell), f"cx long, cy long, {', '.join(f'{w} long' for w in words)}")
    side = F.greatest(F.lit(1.0), 1 / F.col("scale")).cast("long")
    spread = lambda c: F.explode(F.sequence(F.col(c) * side, F.col(c) * side + side - 1))
    full = cover.where((F.col("scale") <= 1) & ~edged).select("scale", spread("cx").alias("_x"), "cy")
    full = full.select(F.col("_x").alias("cx"), spread("cy").alias("cy"), *[F.lit(-1).cast("long").alias(w) for w in words])
    return open_cells.unionByName(full).groupBy("cx", "cy").agg(*[F.bit_or(w).alias(w) for w in words]).select(
        "cx", "cy", F.array(*words).alias("words")
    )


def ring_offsets(rings: int, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and offsets of the samples of rings 1 to ``rings``, in order."""
    ring, k, count = [], [], []
    for r in range(1, rings + 1):
        n = max(12, math.ceil(2 * math.pi * r))
        ring.append(np.full(n, r))
        k.append(np.arange(n))
        count.append(np.full(n, n))
    ring, k, count = (np.concatenate(v) if v else np.zeros(0, int) for v in (ring, k, count))
    angle, radius = k / np.maximum(count, 1) * (2 * math.pi), ring * step
    return ring.astype(np.int64) * RING + k, np.cos(angle) * radius, np.sin(angle) * radius


def _open_samples(rings: int, step: float, cell: float, reach: int, most: int):
    width, size = 2 * reach + 1, cell / SIDE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, east, north = ring_offsets(rings, step)
        for pdf in batches:
            at, lists = [], []
            for n, r in enumerate(pdf.itertuples(index=False)):
                closed = np.zeros((width, width, SIDE, SIDE), bool)
                slots = np.asarray(r.slots, np.int64)
                if len(slots):
                    bits = np.unpackbits(np.asarray(r.words, np.int64).view(np.uint8), bitorder="little")
                    closed[slots // width, slots % width] = bits.reshape(-1, SIDE, SIDE)
                closed = closed.transpose(0, 2, 1, 3).reshape(width * SIDE, width * SIDE)
                first, found = int(np.searchsorted(number, r.start)), []
                while first < len(number) and len(found) < most:
                    part = slice(first, first + 1024)
                    x = (r.longitude + east[part]) / size - (r.home_x - reach) * SIDE
                    y = (r.latitude + north[part]) / size - (r.home_y - reach) * SIDE
                    col, row = np.floor(x), np.floor(y)
                    edge = (np.abs(x - np.rint(x)) < BORDER) | (np.abs(y - np.rint(y)) < BORDER)
                    held = (col >= 0) & (row >= 0) & (col < width * SIDE) & (row < width * SIDE)
                    shut = closed[np.where(held, row, 0).astype(int), np.where(held, col, 0).astype(int)] & held
                    found.extend(number[part][edge | ~shut].tolist())
                    first += 1024
                if found:
                    at.append(n)
                    lists.append(found[:most])
            yield pdf[["spot", "longitude", "latitude"]].iloc[at].assign(samples=pd.Series(lists, index=pdf.index[at], dtype="object"))

    return run


def open_samples(places: DataFrame, squares: DataFrame, spot: str, rings: int, step: float, cell: float, most: int) -> DataFrame:
    """(spot, longitude, latitude, samples): the first ``most`` samples around a place, from number ``start`` on, that no closed square holds.

    ``places`` has (spot, longitude, latitude, start). Places without any are left out.
    """
    reach = math.ceil(rings * step / cell)
    width = 2 * reach + 1
    home = lambda c: F.floor(F.col(c) / F.lit(cell)).cast("long")
    near = places.withColumns({"home_x": home("longitude"), "home_y": home("latitude")})
    slots = F.explode(F.sequence(F.lit(0), F.lit(width * width - 1)))
    around = near.select("home_x", "home_y").distinct().withColumn("_slot", slots).withColumns(
        {"cx": F.col("home_x") - reach + F.col("_slot") % width, "cy": F.col("home_y") - reach + F.floor(F.col("_slot") / width)}
    )
    # A home has the closed squares of a fixed number of cells.
    homes = around.join(squares, ["cx", "cy"]).groupBy("home_x", "home_y").agg(F.sort_array(F.collect_list(F.struct("_slot", "words"))).alias("_l"))
    homes = homes.select("home_x", "home_y", F.col("_l._slot").alias("slots"), F.flatten("_l.words").alias("words"))
    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nothing = lambda kind: F.array().cast(kind)
    asked = near.join(homes, ["home_x", "home_y"], "left").select(
        F.col(spot).alias("spot"), "longitude", "latitude", "start", "home_x", "home_y",
        F.coalesce("slots", nothing("array<int>")).alias("slots"), F.coalesce("words", nothing("array<long>")).alias("words"),
    )
    # Places of one cell are dealt over tasks: the work is in the search, not in what is read.
    searched = asked.repartition(tasks, "spot").mapInPandas(
        _open_samples(rings, step, cell, reach, most), "spot long, longitude double, latitude double, samples array<long>"
    )
    return searched.withColumnRenamed("spot", spot)
