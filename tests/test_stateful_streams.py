"""Steps over micro-batches: late files, long pauses, replays and a moving clock."""

from __future__ import annotations

from datetime import datetime, timedelta
from random import Random

from pyspark.sql import functions as F
from test_streams import T0, batches, points, stream

from accessgraph.operators import tracks
from accessgraph.streaming import stateful as live
from accessgraph.streaming.operators import combine_trip_islands, trip_islands
from accessgraph.streaming.sinks import read_stream


def grade():
    return tracks.classify_accuracy(F.col("horizontal_accuracy_m"))


def graded(spark, folder):
    return stream(spark, folder).withColumn("quality", grade())


def moved(rows, **by):
    return [(t, i, a, b, c, at + timedelta(**by)) for t, i, a, b, c, at in rows]


def test_segments_close_and_late_points_are_counted(spark, folder):
    later = moved(points(50, 53), hours=5)
    batches(spark, folder, points(0, 3, 30), points(4, 6, 30), later, points(3, 4, 30), moved(points(60, 62), hours=9))
    got = live.drain_steps(stream(spark, folder), live.SEGMENT, live.segment_step(), "recorded_at", timedelta(minutes=10))
    closed = sorted((r["from_sequence"], r["to_sequence"], r["point_count"]) for r in got("segments").collect())
    open_ = [(r["from_sequence"], r["to_sequence"], r["point_count"]) for r in got("state").collect()]
    # Point 3 would have joined the first two segments, but came hours too late.
    assert closed == [(0, 2, 3), (4, 5, 2)] and sorted(open_) == [(50, 52, 3), (60, 61, 2)]
    assert [r["sequence"] for r in got("late").collect()] == [3]
    assert sum(n for _, _, n in closed + open_) + got("late").count() == 11


def test_segments_join_over_batches_in_any_order(spark, folder):
    rows = points(0, 60)
    batches(spark, folder, rows[40:], rows[:20], rows[20:40])
    got = live.drain_steps(stream(spark, folder), live.SEGMENT, live.segment_step(), "recorded_at", timedelta(hours=2))
    assert [tuple(r)[3:] for r in got("state").collect()] == [(0, 59, 60)] and got("late").count() == 0


def test_trips_end_with_the_batch_summary(spark, folder):
    first = points(0, 30)
    other = [("u", *r[1:]) for r in moved(points(0, 4), hours=20)]
    end = [("v", *r[1:]) for r in moved(points(0, 2), hours=60)]
    table = batches(spark, folder, first[:10], first[20:], first[10:20], other, end, moved(points(7, 8), seconds=1))
    got = live.drain_steps(
        graded(spark, folder), live.RUNS, live.trip_step(pause_sec=6 * 3600, gap_sec=5, chunk=7), "recorded_at", timedelta(hours=1)
    )
    trips = spark.createDataFrame([("t", T0, None), ("u", T0, None)], "trip_id string, started_at timestamp, ended_at timestamp")
    kept = table.where(F.col("recorded_at") != F.lit(T0 + timedelta(seconds=71))).withColumn("quality", grade())
    want = {r["trip_id"]: r for r in tracks.summarize_trips(trips, kept, 5).collect()}
    rows = got("trips").collect()
    assert sorted(r["trip_id"] for r in rows) == ["t", "u"]
    for r in rows:
        assert abs(r["distance_m"] - want[r["trip_id"]]["distance_m"]) < 1e-6
        for c in ("point_count", "largest_gap_sec", "rejected_count", "weak_count", "good_count"):
            assert r[c] == want[r["trip_id"]][c], c
    assert {r["trip_id"] for r in got("state").collect()} == {"v"} and got("late").count() == 1


def test_runs_of_a_trip_in_order_stay_one_row(spark, folder):
    rows = points(0, 40)
    batches(spark, folder, *[rows[i : i + 10] for i in range(0, 40, 10)])
    got = live.drain_steps(graded(spark, folder), live.RUNS, live.trip_step(3600), "recorded_at", timedelta(hours=1))
    assert got("state").count() == 1 and got("state").first()["point_count"] == 40


def test_a_replayed_batch_changes_nothing(spark, folder):
    step, late = live.segment_step(), timedelta(0)
    make = lambda rows: spark.createDataFrame(rows, "trip_id string, sequence long, latitude double, longitude double, horizontal_accuracy_m double, recorded_at timestamp")
    groups = [make(points(0, 3)), make(moved(points(10, 12), hours=1)), make(points(5, 6) + moved(points(20, 21), hours=2))]
    for number, batch in enumerate(groups):
        for _ in range(2):
            live.take_step(batch, number, folder, live.SEGMENT, step, "recorded_at", late)
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    assert sorted(r["point_count"] for r in read("segments").collect()) == [3]
    assert read("late").count() == 1
    assert sorted(r["point_count"] for r in read("state/batch_id=2").collect()) == [1, 2]
    assert live._batches(spark, f"{folder}/state") == [1, 2]


def test_conditions_turn_stale_with_the_clock_alone(spark, folder):
    schema = "condition_id string, valid_to timestamp, clock timestamp"
    hour = lambda h: T0 + timedelta(hours=h)
    given = [[("a", hour(1), hour(0)), ("b", hour(5), hour(0)), ("c", None, hour(0)), ("d", hour(-1), hour(0))],
             [(None, None, hour(2))], [("b", hour(9), hour(3))], [(None, None, hour(6))], [(None, None, hour(1))]]
    for rows in given:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    rows = read_stream(spark, f"{folder}/in", spark.createDataFrame([], schema).schema, files_per_trigger=1)
    got = live.drain_steps(rows, live.CONDITION, live.condition_step(), "clock")
    stale = {r["condition_id"]: (r["stale_at"], r["batch_id"]) for r in got("stale").collect()}
    assert stale == {"d": (hour(0), 0), "a": (hour(2), 1)}
    assert sorted((r["condition_id"], r["valid_to"]) for r in got("state").collect()) == [("b", hour(9)), ("c", datetime(9999, 12, 31))]


def test_outbox_is_delivered_once_and_marked(spark, folder):
    schema = "event_id long, body string, flushed_at timestamp"
    groups = [[(1, "a", None), (2, "b", T0), (3, "c", None), (3, "c", None)], [(3, "c", None), (4, "d", None)]]
    out = f"{folder}/out"
    send = lambda rows, number: rows.write.mode("overwrite").parquet(f"{out}/batch_id={number}")
    frames = [spark.createDataFrame(g, schema) for g in groups]
    for number in (0, 0, 1, 0, 1):
        live.deliver_batch(frames[number], number, folder, send)
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 3, 4]
    marked = live.flushed(frames[0].unionByName(frames[1]), folder).collect()
    assert all(r["flushed_at"] is not None for r in marked) and [r["flushed_at"] for r in marked if r["event_id"] == 2] == [T0]


def test_runs_are_joined_in_one_pass(spark):
    """No plan reads the points more than once, however the steps are nested."""
    rows = spark.createDataFrame(points(0, 40) + points(50, 55), "trip_id string, sequence long, latitude double, longitude double, horizontal_accuracy_m double, recorded_at timestamp").withColumn("quality", grade())
    joined = live.joined_runs(live.point_runs(rows, 7))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("LogicalRDD") == 1
    islands = trip_islands(rows, chunk=7)
    whole = lambda runs: runs.select("trip_id", "chunk", "first.sequence", "last.sequence", "point_count", F.round("distance_m", 6), "largest_gap_sec", "good_count")
    assert sorted(map(tuple, whole(joined).collect())) == sorted(map(tuple, whole(islands).collect()))
    totals = combine_trip_islands(joined)
    assert totals._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert [tuple(r) for r in totals.select("trip_id", "point_count").collect()] == [("t", 45)]


def test_segments_join_over_chunks_of_time(spark):
    """Against a plain sweep: long segments over several chunks, rows without trip, and gaps at their limit."""
    rng, parts = Random(5), []
    for trip in ("a", "b", None):
        for n in range(120):
            start = T0 + timedelta(seconds=rng.randrange(4000))
            parts.append((trip, start, start + timedelta(seconds=rng.choice((0, 0, 0, 3, 400))), n, n, 1))
    want = []
    for trip in ("a", "b", None):
        rows, open_ = sorted(p[1:] for p in parts if p[0] == trip), None
        for start, end, low, high, n in rows:
            if open_ is None or (start - open_[2]).total_seconds() > 10:
                open_ = [trip, start, end, low, high, n]
                want.append(open_)
            else:
                open_[2:] = [max(open_[2], end), min(open_[3], low), max(open_[4], high), open_[5] + n]
    by = lambda r: (str(r[0]), r[1])
    frame = spark.createDataFrame(parts, live.SEGMENT)
    for chunk in (7, 60, 86_400):
        got = live.joined_segments(frame, 10, chunk).select(*live.SEGMENT.fieldNames())
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1
        assert sorted((list(r) for r in got.collect()), key=by) == sorted(want, key=by)
