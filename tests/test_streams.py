import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from accessgraph.operators import tracks
from accessgraph.streaming import operators as live
from accessgraph.streaming.sinks import drain, read_stream

T0 = datetime(2026, 8, 1)
RAW = "trip_id string, sequence long, latitude double, longitude double, horizontal_accuracy_m double, recorded_at timestamp"


def batches(spark, folder, *groups):
    for rows in groups:
        spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.read.schema(RAW).parquet(f"{folder}/in")


def points(first, last, step=10):
    return [("t", i, 64 + i / 1000, -51.0, 10.0 if i % 5 else 100.0, T0 + timedelta(seconds=step * i)) for i in range(first, last)]


def stream(spark, folder):
    return read_stream(spark, f"{folder}/in", spark.createDataFrame([], RAW).schema, files_per_trigger=1)


def summary_matches_the_batch(spark, folder, *groups, chunk=7, gap_sec=5):
    table = batches(spark, folder, *groups)
    grade = tracks.classify_accuracy(F.col("horizontal_accuracy_m"))
    graded = stream(spark, folder).withColumn("quality", grade)
    islands = drain(graded, each=lambda batch: live.trip_islands(batch, gap_sec, chunk))
    assert islands.select("batch_id").distinct().count() == len(groups)
    assert live.overlapping_islands(islands).count() == 0
    got = live.combine_trip_islands(islands, gap_sec).first()
    trips = spark.createDataFrame([("t", T0, None)], "trip_id string, started_at timestamp, ended_at timestamp")
    want = tracks.summarize_trips(trips, table.withColumn("quality", grade), gap_sec).first()
    assert abs(got["distance_m"] - want["distance_m"]) < 1e-6
    for c in ("point_count", "largest_gap_sec", "rejected_count", "weak_count", "good_count"):
        assert got[c] == want[c], c


def test_trip_summary_over_batches_and_chunks(spark, folder):
    summary_matches_the_batch(spark, folder, points(0, 20), points(20, 33))


def test_trip_summary_after_a_long_pause(spark, folder):
    late = [(t, i, a, b, c, at + timedelta(days=3)) for t, i, a, b, c, at in points(5, 8)]
    summary_matches_the_batch(spark, folder, points(0, 5), late, chunk=4096)


def test_trip_summary_in_shuffled_arrival(spark, folder):
    rows = points(0, 40)
    random.Random(3).shuffle(rows)
    summary_matches_the_batch(spark, folder, rows[:11], rows[11:13], rows[13:30], rows[30:])


def test_repeated_runs_are_reported(spark, folder):
    batches(spark, folder, points(0, 5), points(3, 6))
    graded = stream(spark, folder).withColumn("quality", F.lit("good"))
    islands = drain(graded, each=live.trip_islands)
    assert [r["first"]["sequence"] for r in live.overlapping_islands(islands).collect()] == [3]


def test_active_trips_add_up(spark, folder):
    batches(spark, folder, points(3, 6), points(0, 3), [("u", 9, 1.0, 1.0, 1.0, T0)])
    got = live.merge_active(drain(stream(spark, folder), each=live.active_in_batch)).collect()
    assert sorted((r["trip_id"], r["last_point"]["sequence"], r["stored_points"]) for r in got) == [("t", 5, 6), ("u", 9, 1)]


def test_intake_drops_repeats_and_last_wins(spark, folder):
    moved = [(t, i, 1.0, b, c, at) for t, i, a, b, c, at in points(0, 5)]
    batches(spark, folder, points(0, 5), moved, points(5, 6))
    assert drain(live.stream_points(stream(spark, folder))).count() == 6
    arriving = stream(spark, folder).withColumn("arrival", F.when(F.col("latitude") == 1.0, 2).otherwise(1))
    last = live.merge_last_arrivals(drain(arriving, each=live.last_arrivals)).collect()
    assert sorted((r["sequence"], r["latitude"] == 1.0) for r in last) == [(i, i < 5) for i in range(6)]


def test_segments_keep_exact_gap_together(spark, folder):
    late = [("t", 100, 64.0, -51.0, 1.0, T0 + timedelta(hours=9))]
    batches(spark, folder, points(0, 3, 30), points(10, 12, 30), late)
    got = drain(live.stream_segments(stream(spark, folder))).select("from_sequence", "to_sequence", "point_count")
    assert sorted(tuple(r) for r in got.collect()) == [(0, 2, 3), (10, 11, 2)]
