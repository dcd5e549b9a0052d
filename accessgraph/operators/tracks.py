"""GPS track analytics over a table of points.

Trips may be very long, so ordered work runs inside (trip, chunk of the
sequence) groups and only one row per chunk crosses between them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessgraph.functions.dates import whole_seconds_between
from accessgraph.functions.geo import haversine_m
from accessgraph.operators.temporal import Tables
from accessgraph.operators.windows import nearest_rank, numbered, previous_row

GOOD_M, WEAK_M, GAP_SEC = 25, 80, 30
CHUNK = 50_000


def classify_accuracy(accuracy: Column) -> Column:
    """good to 25 m, weak to 80 m or when unknown, else rejected."""
    return (
        F.when(accuracy.isNull(), "weak").when(accuracy <= GOOD_M, "good").when(accuracy <= WEAK_M, "weak").otherwise("rejected")
    )


def to_track_points(fixes: DataFrame, order: Sequence[str] = ("recorded_at",), chunk: Column | None = None) -> DataFrame:
    """Number the fixes of each trip from 0 and add their quality.

    The numbering works on one calendar day of a trip at a time by default.
    """
    day = F.to_date(order[0]) if chunk is None else chunk
    return (
        numbered(fixes, ["trip_id"], list(order), day, "_n")
        .withColumn("sequence", (F.col("_n") - 1).cast("long"))
        .withColumn("quality", classify_accuracy(F.col("horizontal_accuracy_m")))
        .drop("_n")
    )


def with_hops(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Add ``prev``, ``hop_m`` (null next to a rejected point) and ``gap_sec`` to each point."""
    seen = previous_row(
        points,
        ["trip_id"],
        ["sequence"],
        F.floor(F.col("sequence") / F.lit(chunk)),
        ["sequence", "latitude", "longitude", "quality", "recorded_at"],
    )
    both_kept = (F.col("prev.quality") != "rejected") & (F.col("quality") != "rejected")
    metres = haversine_m(F.col("prev.latitude"), F.col("prev.longitude"), F.col("latitude"), F.col("longitude"))
    micros = F.timestamp_diff("MICROSECOND", F.col("prev.recorded_at"), F.col("recorded_at"))
    return seen.withColumn("hop_m", F.when(both_kept, metres)).withColumn("gap_sec", micros / 1e6)


def track_distance(points: DataFrame) -> DataFrame:
    return with_hops(points).groupBy("trip_id").agg(F.coalesce(F.sum("hop_m"), F.lit(0.0)).alias("distance_m"))


def detect_gaps(points: DataFrame, threshold_sec: float = GAP_SEC) -> DataFrame:
    """Pauses strictly longer than the threshold, whatever the quality."""
    return (
        with_hops(points)
        .where(F.col("gap_sec") > threshold_sec)
        .select("trip_id", F.col("prev.sequence").alias("from_sequence"), F.col("sequence").alias("to_sequence"), "gap_sec")
    )


def _largest_gap(threshold_sec: float) -> Column:
    return F.coalesce(F.max(F.when(F.col("gap_sec") > threshold_sec, F.col("gap_sec"))), F.lit(0.0))


def largest_gap(points: DataFrame, threshold_sec: float = 0) -> DataFrame:
    return with_hops(points).groupBy("trip_id").agg(_largest_gap(threshold_sec).alias("largest_gap_sec"))


def accuracy_percentiles(points: DataFrame) -> DataFrame:
    """Nearest-rank median and 90th percentile of the accuracy per trip; nulls are ignored."""
    return nearest_rank(
        points, ["trip_id"], "horizontal_accuracy_m", {"accuracy_p50_m": 50 / 100, "accuracy_p90_m": 90 / 100}
    )


def trip_duration(trips: DataFrame) -> DataFrame:
    seconds = whole_seconds_between(F.col("started_at"), F.col("ended_at"))
    return trips.withColumn("duration_sec", F.coalesce(seconds, F.lit(0).cast("long")))


def summarize_trips(trips: DataFrame, points: DataFrame, gap_threshold_sec: float = GAP_SEC) -> DataFrame:
    """One summary row per trip; trips without points get zeros."""
    totals = with_hops(points).groupBy("trip_id").agg(
        F.coalesce(F.sum("hop_m"), F.lit(0.0)).alias("distance_m"),
        F.count(F.lit(1)).alias("point_count"),
        _largest_gap(gap_threshold_sec).alias("largest_gap_sec"),
        *[F.count_if(F.col("quality") == q).alias(f"{q}_count") for q in ("rejected", "weak", "good")],
    )
    counts = ["distance_m", "point_count", "largest_gap_sec", "rejected_count", "weak_count", "good_count"]
    return (
        trip_duration(trips.select("trip_id", "started_at", "ended_at"))
        .join(totals, "trip_id", "left")
        .join(accuracy_percentiles(points), "trip_id", "left")
        .fillna(0, counts)
    )


def active_trips(trips: DataFrame, points: DataFrame) -> DataFrame:
    """Unfinished trips with their latest point and point count."""
    open_trips = trips.where(F.col("ended_at").isNull())
    columns = [c for c in points.columns if c != "trip_id"]
    last = points.groupBy("trip_id").agg(
        F.max_by(F.struct(*columns), F.col("sequence")).alias("last_point"), F.count(F.lit(1)).alias("stored_points")
    )
    return open_trips.join(last, "trip_id", "left").withColumn("stored_points", F.coalesce("stored_points", F.lit(0)))


def without_trips(tables: Tables, ids: DataFrame) -> dict[str, DataFrame]:
    """Trips, points, waypoints and outbox rows that do not belong to the given trips."""
    gone = ids.select("trip_id").distinct()
    return {name: df.join(gone, "trip_id", "left_anti") for name, df in tables.items()}


def waypoint_violations(waypoints: DataFrame) -> DataFrame:
    """Only private waypoints may be stored."""
    return waypoints.where(F.coalesce(F.col("visibility.type") != "private", F.lit(True))).select(
        "id", F.lit("waypoint is not private").alias("message")
    )
