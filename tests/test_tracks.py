import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from accessgraph.operators import tracks
from accessgraph.sources import sinks

T0 = datetime(2026, 8, 1, 10)
FIX = "trip_id string, latitude double, longitude double, horizontal_accuracy_m double, altitude_m double, speed_mps double, course_deg double, provider string, recorded_at timestamp"
MARK = "id string, trip_id string, category string, note string, latitude double, longitude double, recorded_at timestamp, visibility struct<type:string>"


def points(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [
        ("t", 64.0, -51.0, 10.0, 3.0, None, None, "gps", at(0)),
        ("t", 64.001, -51.0, 120.0, None, None, None, "gps", at(10)),
        ("t", 64.002, -51.0, None, None, None, None, "gps", at(310)),
        ("t", 64.003, -51.0, 30.0, None, None, None, "gps", at(600)),
    ]
    return tracks.to_track_points(spark.createDataFrame(rows, FIX))


def test_summary_scenario(spark):
    trips = spark.createDataFrame([("t", T0, T0 + timedelta(seconds=600)), ("empty", T0, None)], "trip_id string, started_at timestamp, ended_at timestamp")
    got = {r["trip_id"]: r for r in tracks.summarize_trips(trips, points(spark)).collect()}
    t = got["t"]
    assert (t["duration_sec"], t["point_count"], t["largest_gap_sec"]) == (600, 4, 300.0)
    assert (t["rejected_count"], t["weak_count"], t["good_count"]) == (1, 2, 1)
    # Only the last hop counts: both hops at the rejected point are left out.
    assert abs(t["distance_m"] - 111.19) < 0.1
    assert (t["accuracy_p50_m"], t["accuracy_p90_m"]) == (30.0, 120.0)
    e = got["empty"]
    assert (e["duration_sec"], e["distance_m"], e["point_count"], e["accuracy_p50_m"]) == (0, 0.0, 0, None)


def test_gaps_are_strict(spark):
    gaps = tracks.detect_gaps(points(spark), 290).select("from_sequence", "to_sequence", "gap_sec").collect()
    assert [tuple(g) for g in gaps] == [(1, 2, 300.0)]


def waypoints(spark):
    rows = [("w", "t", "ice & fog", "don't <go>", 64.0, -51.0, T0, {"type": "private"}), ("v", "t", "x", "y", 64.0, -51.0, T0, {"type": "group"})]
    return spark.createDataFrame(rows, MARK)


def test_exports(spark):
    features = sinks.tracks_to_geojson(points(spark), waypoints(spark)).collect()
    kinds = sorted(f["kind"] for f in features if f["kind"] != "track")
    assert kinds == ["track_point", "track_point", "track_point", "waypoint", "waypoint"]
    text = "\n".join(
        r["text"] for r in sinks.tracks_to_gpx(points(spark), waypoints(spark)).orderBy("section", "position", "text").collect()
    )
    assert text.startswith('<?xml version="1.0" encoding="UTF-8"?>\n<gpx')
    assert text.count("<trkpt") == 3 and text.count("<ele>3.0</ele>") == 1
    assert "<desc>don&apos;t &lt;go&gt;</desc>" in text and "ice &amp; fog" in text
    import xml.dom.minidom

    xml.dom.minidom.parseString(text)
    nothing = points(spark).limit(0)
    with pytest.raises(ValueError):
        sinks.tracks_to_geojson(nothing, waypoints(spark).limit(0))


def test_lines_are_whole_features_whatever_their_length(spark):
    def made(trip, n):
        return spark.range(n).select(
            F.lit(trip).alias("trip_id"), F.col("id").alias("sequence"), F.col("id").cast("double").alias("longitude"),
            F.lit(1.0).alias("latitude"), F.lit("good").alias("quality"),
            F.when(F.col("id") != 1, 1.5).alias("horizontal_accuracy_m"), F.timestamp_seconds("id").alias("recorded_at"),
        )

    rows = sinks.track_lines(made('l"ong', 3000).unionByName(made("two", 2)).unionByName(made("one", 1)))
    texts = {}
    for r in rows.orderBy("trip_id", "section", "position").collect():
        texts[r["trip_id"]] = texts.get(r["trip_id"], "") + r["text"]
    assert set(texts) == {'l"ong', "two"}
    for trip, n in (('l"ong', 3000), ("two", 2)):
        feature = json.loads(texts[trip])
        assert feature["geometry"] == {"type": "LineString", "coordinates": [[float(i), 1.0] for i in range(n)]}
        properties = feature["properties"]
        assert (properties["tripId"], properties["kind"], properties["pointCount"]) == (trip, "track", n)
        assert properties["timestamps"][1] == "1970-01-01T00:00:01.000Z" and len(properties["timestamps"]) == n
        assert properties["horizontalAccuracyM"][:3] == [1.5, None, 1.5][:n]


def test_privacy_and_cascade(spark):
    assert [r["id"] for r in tracks.waypoint_violations(waypoints(spark)).collect()] == ["v"]
    gone = spark.createDataFrame([("t",)], "trip_id string")
    assert tracks.without_trips({"points": points(spark)}, gone)["points"].count() == 0
