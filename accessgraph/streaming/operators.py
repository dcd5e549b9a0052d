"""Streaming operators.

Those with state bound it by a watermark. Running totals keep none: each
micro-batch writes rows that add up, and a ``combine`` or ``merge`` function
folds the written rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accessgraph.functions.dates import is_stale
from accessgraph.functions.geo import haversine_m
from accessgraph.operators.grids import gap_zones
from accessgraph.operators.tracks import CHUNK, GAP_SEC, classify_accuracy
from accessgraph.operators.windows import previous_row

LATENESS = "1 hour"


def stream_points(raw: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Classified points; of repeated (trip, sequence) rows the first one is kept."""
    graded = raw.withColumn("quality", classify_accuracy(F.col("horizontal_accuracy_m")))
    return graded.withWatermark("recorded_at", lateness).dropDuplicatesWithinWatermark(["trip_id", "sequence"])


def last_arrivals(batch: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Of repeated (trip, sequence) rows of a micro-batch the latest arrival; see :func:`merge_last_arrivals`."""
    columns = [c for c in batch.columns if c not in ("trip_id", "sequence")]
    kept = batch.groupBy("trip_id", "sequence").agg(F.max_by(F.struct(*columns), F.col(arrival)).alias("_r"))
    return kept.select("trip_id", "sequence", "_r.*").withColumn(
        "quality", classify_accuracy(F.col("horizontal_accuracy_m"))
    )


def merge_last_arrivals(written: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The latest arrival of every point over all micro-batches; the stream itself holds no state."""
    return last_arrivals(written.drop("quality"), arrival)


def trip_islands(batch: DataFrame, gap_sec: float = GAP_SEC, chunk: int = CHUNK) -> DataFrame:
    """Totals of every run of consecutive sequence numbers in the points of a micro-batch.

    A run holds all numbers from its first to its last point, so no point that
    arrives later can fall inside it. The rows of all batches therefore add up
    in any order of arrival and after any pause, and the stream needs no state.
    Runs end at multiples of ``chunk``, which splits very long trips. Points
    are expected once, as :func:`stream_points` gives them.
    """
    part = F.floor(F.col("sequence") / F.lit(chunk)).cast("long")
    micros = F.unix_micros(F.col("recorded_at").cast("timestamp"))
    rows = batch.select("trip_id", part.alias("chunk"), "sequence", "latitude", "longitude", "quality", micros.alias("micros"))
    w = Window.partitionBy("trip_id", "chunk").orderBy("sequence")
    point = F.struct("sequence", "latitude", "longitude", "quality", "micros")
    run = F.col("sequence") - F.row_number().over(w)
    rows = rows.withColumns({"_run": run, "_point": point, "_p": F.lag(point).over(w)})
    joined = F.col("_p.sequence") == F.col("sequence") - 1
    both_kept = joined & (F.col("_p.quality") != "rejected") & (F.col("quality") != "rejected")
    hop = haversine_m(F.col("_p.latitude"), F.col("_p.longitude"), F.col("latitude"), F.col("longitude"))
    gap = F.when(joined, (F.col("micros") - F.col("_p.micros")) / 1e6)
    zero = F.lit(0.0)
    return rows.groupBy("trip_id", "chunk", "_run").agg(
        F.min_by("_point", "sequence").alias("first"),
        F.max_by("_point", "sequence").alias("last"),
        F.count(F.lit(1)).alias("point_count"),
        F.coalesce(F.sum(F.when(both_kept, hop)), zero).alias("distance_m"),
        F.coalesce(F.max(F.when(gap > gap_sec, gap)), zero).alias("largest_gap_sec"),
        *[F.count_if(F.col("quality") == q).alias(f"{q}_count") for q in ("rejected", "weak", "good")],
    ).drop("_run")


def overlapping_islands(islands: DataFrame) -> DataFrame:
    """Runs that repeat points of an earlier run of their trip; none if points came once."""
    ordered = islands.select("trip_id", "chunk", "first", "last", F.col("first.sequence").alias("_from"))
    linked = previous_row(ordered, ["trip_id"], ["_from"], F.col("chunk"), ["last"])
    return linked.where(F.col("_from") <= F.col("prev.last.sequence")).drop("_from", "prev")


def combine_trip_islands(islands: DataFrame, gap_sec: float = GAP_SEC) -> DataFrame:
    """Whole-trip totals from the runs of all micro-batches; hops between neighbouring runs are added here.

    The runs of a chunk are folded to one row first, so only those rows meet by trip.
    """
    counts = [f"{q}_count" for q in ("rejected", "weak", "good")]

    def folded(rows: DataFrame, keys: list[str], order: str, *more: Column) -> DataFrame:
        linked = rows.withColumn("_prev", F.lag("last").over(Window.partitionBy("trip_id", *keys).orderBy(order)))
        both_kept = (F.col("_prev.quality") != "rejected") & (F.col("first.quality") != "rejected")
        hop = haversine_m(F.col("_prev.latitude"), F.col("_prev.longitude"), F.col("first.latitude"), F.col("first.longitude"))
        gap = (F.col("first.micros") - F.col("_prev.micros")) / 1e6
        return linked.groupBy("trip_id", *keys).agg(
            *more,
            F.sum("point_count").alias("point_count"),
            (F.sum("distance_m") + F.coalesce(F.sum(F.when(both_kept, hop)), F.lit(0.0))).alias("distance_m"),
            F.greatest(
                F.max("largest_gap_sec"), F.coalesce(F.max(F.when(gap > gap_sec, gap)), F.lit(0.0))
            ).alias("largest_gap_sec"),
            *[F.sum(c).alias(c) for c in counts],
        )

    ordered = islands.withColumn("_from", F.col("first.sequence"))
    ends = [F.min_by("first", "_from").alias("first"), F.max_by("last", "_from").alias("last")]
    return folded(folded(ordered, ["chunk"], "_from", *ends), [], "chunk")


def stream_segments(points: DataFrame, gap: str = f"{GAP_SEC} seconds", lateness: str = LATENESS) -> DataFrame:
    """Stretches of a trip without a pause longer than the gap; late points are dropped by the watermark."""
    return (
        points.withWatermark("recorded_at", lateness)
        .groupBy("trip_id", F.session_window("recorded_at", gap).alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("point_count"),
            F.min("sequence").alias("from_sequence"),
            F.max("sequence").alias("to_sequence"),
            F.min("recorded_at").alias("started_at"),
            F.max("recorded_at").alias("ended_at"),
        )
        .drop("_w")
    )


def active_in_batch(batch: DataFrame) -> DataFrame:
    """Latest point and number of points of each trip in a micro-batch; see :func:`merge_active`."""
    columns = [c for c in batch.columns if c != "trip_id"]
    return batch.groupBy("trip_id").agg(
        F.max_by(F.struct(*columns), F.col("sequence")).alias("last_point"), F.count(F.lit(1)).alias("stored_points")
    )


def merge_active(written: DataFrame) -> DataFrame:
    """Latest point and number of points of each trip over all micro-batches."""
    return written.groupBy("trip_id").agg(
        F.max_by("last_point", F.col("last_point.sequence")).alias("last_point"),
        F.sum("stored_points").alias("stored_points"),
    )


def stream_gaps(misses: DataFrame, window: str = "150 milliseconds", lateness: str = LATENESS) -> DataFrame:
    """Missed tiles per settle window: distinct (window_start, zone, z, x, y)."""
    return (
        misses.withWatermark("at", lateness)
        .groupBy(F.window("at", window).alias("_w"), "zone", "z", "x", "y")
        .agg(F.count(F.lit(1)).alias("reports"))
        .select(F.col("_w.start").alias("window_start"), "zone", "z", "x", "y", "reports")
    )


def window_gap_zones(window_misses: DataFrame, viewports: DataFrame) -> DataFrame:
    """Missing zones per viewport from the misses of closed windows."""
    return gap_zones(window_misses, viewports)


def stream_conditions(conditions: DataFrame) -> DataFrame:
    """Staleness against the clock of each micro-batch."""
    return conditions.withColumn("stale", is_stale(F.col("valid_to"), F.current_timestamp()))


def stream_outbox(events: DataFrame) -> DataFrame:
    """Pending outbox rows; a ``foreachBatch`` sink delivers them."""
    return events.where(F.col("flushed_at").isNull())
