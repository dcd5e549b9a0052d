"""Ordered operations whose groups may be very large.

A plain window over one key sorts that key's rows in a single task. These
helpers split each key by a ``chunk`` that rises with the order, work inside
the (key, chunk) groups, and carry one small row per chunk across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, columns: Sequence[str], out: str = "prev"
) -> DataFrame:
    """Add struct ``out`` with ``columns`` of the row before, null on the first row of a key.

    ``chunk`` must be non-decreasing along ``order`` inside a key.
    """
    chunked = df.withColumn("_chunk", chunk)
    group = [*keys, "_chunk"]
    inside = Window.partitionBy(*group).orderBy(*order)
    body = F.struct(*[F.col(c) for c in columns])
    tails = chunked.groupBy(*group).agg(F.max_by(body, F.struct(*order)).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    carried = tails.select(*group, F.lag("_tail").over(across).alias("_carry"))
    return (
        chunked.withColumn("_lag", F.lag(body).over(inside))
        .join(carried, group, "left")
        .withColumn(out, F.coalesce("_lag", "_carry"))
        .drop("_chunk", "_lag", "_carry")
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, out: str = "n") -> DataFrame:
    """Add the 1-based position of each row inside its key.

    ``chunk`` must be non-decreasing along ``order`` inside a key.
    """
    chunked = df.withColumn("_chunk", chunk)
    group = [*keys, "_chunk"]
    inside = Window.partitionBy(*group).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunked.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(*group, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        chunked.withColumn("_pos", F.row_number().over(inside))
        .join(offsets, group, "left")
        .withColumn(out, F.col("_pos") + F.col("_offset"))
        .drop("_chunk", "_pos", "_offset")
    )


def running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: str, out: str
) -> DataFrame:
    """Add the largest ``value`` up to and including each row of a key.

    ``chunk`` must be non-decreasing along ``order`` inside a key.
    """
    chunked = df.withColumn("_chunk", chunk)
    group = [*keys, "_chunk"]
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = chunked.groupBy(*group).agg(F.max(value).alias("_top"))
    carried = tops.select(*group, F.max("_top").over(before).alias("_carry"))
    return (
        chunked.withColumn("_here", F.max(value).over(inside))
        .join(carried, group, "left")
        .withColumn(out, F.greatest("_here", "_carry"))
        .drop("_chunk", "_here", "_carry")
    )


def nearest_rank(
    df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], coarse: Column | None = None
) -> DataFrame:
    """Exact nearest-rank percentiles per key; null values are ignored.

    Equal values are counted before the shuffle. Ranks are first located in
    coarse ranges of the value, then inside the one range that holds them, so
    no task orders all values of a key.
    """
    bucket = coarse if coarse is not None else F.floor(F.col(value))
    counts = (
        df.where(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*keys, F.col(value).alias("_v"), bucket.alias("_range"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    ranges = counts.groupBy(*keys, "_range").agg(F.sum("_c").alias("_rc"))
    below = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(*keys)
    placed = ranges.select(
        *keys,
        "_range",
        "_rc",
        F.coalesce(F.sum("_rc").over(below), F.lit(0)).alias("_below"),
        F.sum("_rc").over(total).alias("_total"),
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("_total"))).alias("rank"))
            for name, q in fractions.items()
        ]
    )
    targets = (
        placed.withColumn("_want", F.explode(wanted))
        .where((F.col("_want.rank") > F.col("_below")) & (F.col("_want.rank") <= F.col("_below") + F.col("_rc")))
        .select(*keys, "_range", "_below", F.col("_want.name").alias("_name"), F.col("_want.rank").alias("_rank"))
    )
    inner = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    needed = counts.join(targets.select(*keys, "_range").distinct(), [*keys, "_range"], "left_semi")
    running = needed.withColumn("_upto", F.sum("_c").over(inner))
    hit = (
        targets.join(running, [*keys, "_range"])
        .where(F.col("_below") + F.col("_upto") >= F.col("_rank"))
        .groupBy(*keys)
        .agg(*[F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in fractions])
    )
    return hit
