"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessgraph.llm.common import discard, stored


def roots_of(found: np.ndarray, same: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The least node that each row and column node reaches over a matrix of links.

    Rows and columns are the same nodes if ``same``, and the matrix is symmetric;
    else columns come after rows. Links are followed a frontier at a time, so
    the matrix is never listed as pairs.
    """
    left = np.arange(found.shape[0])
    right = left if same else np.arange(found.shape[1]) + found.shape[0]
    open_left = found.any(axis=1)
    open_right = open_left if same else found.any(axis=0)
    for first in np.flatnonzero(open_left):
        if not open_left[first]:
            continue
        open_left[first] = False
        frontier = np.array([first])
        while len(frontier):
            met = np.flatnonzero(found[frontier].any(axis=0) & open_right)
            open_right[met] = False
            right[met] = first
            if same:
                frontier = met
                continue
            frontier = np.flatnonzero(found[:, met].any(axis=1) & open_left)
            open_left[frontier] = False
            left[frontier] = first
    return left, right


def _large_star(pairs: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of node and neighbours."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(pairs: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = pairs.groupBy("a").agg(F.min("b").alias("least"))
    rest = pairs.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return rest.unionByName(least.select("a", F.col("least").alias("b")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; the component is its least node.

    Every round halves the distance to the roots and writes its pairs to the
    shared folder; it ends when a round changes nothing. Nulls and loops are
    ignored, so a node with only a loop has no row. A node with very many edges
    is aggregated before the shuffle and its join is split by adaptive
    execution.
    """
    real = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = stored(real.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "pairs")
    mark = None
    while True:
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        following = stored(_small_star(_large_star(pairs).distinct()).distinct(), "pairs")
        discard(pairs)
        pairs = following
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
