"""Queries over tracks, exports and streams."""

from __future__ import annotations

from datetime import timedelta
from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql import types as T

from accessgraph.operators import denorm, grids, tracks
from accessgraph.plans.access import SQL_CANON, SQL_RECORDS
from accessgraph.plans.registry import query
from accessgraph.plans.views import base, domain_tables
from accessgraph.session import durable_dir
from accessgraph.sources import sinks
from accessgraph.streaming import operators as live
from accessgraph.streaming import stateful
from accessgraph.streaming.sinks import drain, read_stream


def _fixes(events):
    k = F.col("event_id")
    return events.select(
        F.concat(F.lit("trip_"), F.col("user_id").cast("string")).alias("trip_id"),
        (F.lit(60.0) + ((k * 7919) % 100000).cast("double") / 10000.0).alias("latitude"),
        (F.lit(-55.0) + ((k * 104729) % 100000).cast("double") / 10000.0).alias("longitude"),
        F.when(k % 23 != 0, F.col("value")).alias("horizontal_accuracy_m"),
        F.when(k % 3 == 0, (k % 100).cast("double")).alias("altitude_m"),
        F.lit(None).cast("double").alias("speed_mps"),
        F.lit(None).cast("double").alias("course_deg"),
        F.lit("gps").alias("provider"),
        F.col("ts").cast("timestamp").alias("recorded_at"),
        "event_id",
        "user_id",
    )


def _points(spark, sf):
    return tracks.to_track_points(_fixes(base(spark, sf, "events")), ["recorded_at", "event_id"])


def _trips(spark, sf):
    ends = F.when(F.col("user_id") % 5 != 0, F.max("ts").cast("timestamp"))
    rows = base(spark, sf, "events").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("started_at"), ends.alias("ended_at"))
    return rows.withColumn("trip_id", F.concat(F.lit("trip_"), F.col("user_id").cast("string")))


def _waypoints(spark, sf):
    rows = _fixes(base(spark, sf, "events").where(F.col("event_type") == "error"))
    return rows.select(
        F.concat(F.lit("wp_"), F.col("event_id").cast("string")).alias("id"),
        "trip_id",
        F.lit("hazard & ice").alias("category"),
        F.concat(F.lit("note <"), F.col("event_id").cast("string"), F.lit(">")).alias("note"),
        "latitude",
        "longitude",
        "recorded_at",
        F.struct(F.when(F.col("event_id") % 7 == 0, "shared").otherwise("private").alias("type")).alias("visibility"),
        "event_id",
    )


SQL_QUALITY = "CASE WHEN accuracy IS NULL THEN 'weak' WHEN accuracy <= 25 THEN 'good' WHEN accuracy <= 80 THEN 'weak' ELSE 'rejected' END"
SQL_HOPS = f"""SELECT *, lag(sequence) OVER w AS pseq, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon, lag(q) OVER w AS pq,
      date_diff('microsecond', lag(recorded_at) OVER w, recorded_at) / 1000000.0 AS gap
    FROM (SELECT *, {SQL_QUALITY} AS q FROM v_points) WINDOW w AS (PARTITION BY trip_id ORDER BY sequence)"""


def sql_haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"""2 * 6371000.0 * asin(least(1.0, sqrt(sin(radians(({lat2}) - ({lat1})) / 2) ** 2
        + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians(({lon2}) - ({lon1})) / 2) ** 2)))"""


SQL_METRES = f"CASE WHEN pq <> 'rejected' AND q <> 'rejected' THEN {sql_haversine('plat', 'plon', 'latitude', 'longitude')} END"
SQL_SUMMARY = f"""SELECT trip_id, count(*) AS point_count, round(coalesce(sum({SQL_METRES}), 0), 1) AS distance_m,
      CAST(coalesce(max(CASE WHEN gap > 30 THEN gap END), 0) AS DOUBLE) AS largest_gap_sec,
      count(*) FILTER (WHERE q = 'rejected') AS rejected_count, count(*) FILTER (WHERE q = 'weak') AS weak_count,
      count(*) FILTER (WHERE q = 'good') AS good_count FROM ({SQL_HOPS}) GROUP BY trip_id"""


@query(
    "h1_h2_track_points",
    f"SELECT event_id, trip_id, sequence, {SQL_QUALITY} AS quality FROM v_points",
)
def _(spark, sf):
    return _points(spark, sf).select("event_id", "trip_id", "sequence", "quality")


@query("h3_track_distance", f"SELECT trip_id, distance_m FROM ({SQL_SUMMARY})")
def _(spark, sf):
    return tracks.track_distance(_points(spark, sf)).withColumn("distance_m", F.round("distance_m", 1))


@query(
    "h4_gaps",
    f"SELECT trip_id, pseq AS from_sequence, sequence AS to_sequence, CAST(gap AS DOUBLE) AS gap_sec FROM ({SQL_HOPS}) WHERE gap > 7200",
)
def _(spark, sf):
    return tracks.detect_gaps(_points(spark, sf), 7200)


@query("h5_largest_gap", f"SELECT trip_id, CAST(coalesce(max(CASE WHEN gap > 90000 THEN gap END), 0) AS DOUBLE) AS largest_gap_sec FROM ({SQL_HOPS}) GROUP BY trip_id")
def _(spark, sf):
    return tracks.largest_gap(_points(spark, sf), 90000)


@query(
    "h6_accuracy_percentiles",
    """SELECT trip_id, quantile_disc(accuracy, 0.5) AS accuracy_p50_m, quantile_disc(accuracy, 0.9) AS accuracy_p90_m
       FROM v_points WHERE accuracy IS NOT NULL GROUP BY trip_id""",
)
def _(spark, sf):
    return tracks.accuracy_percentiles(_points(spark, sf))


@query(
    "h7_durations",
    """SELECT trip_id, CASE WHEN e IS NULL THEN 0 ELSE CAST(floor(date_diff('microsecond', s, e) / 1000000.0 + 0.5) AS BIGINT) END AS duration_sec
       FROM (SELECT 'trip_' || CAST(user_id AS STRING) AS trip_id, min(ts) AS s, CASE WHEN user_id % 5 <> 0 THEN max(ts) END AS e
             FROM events GROUP BY user_id)""",
)
def _(spark, sf):
    return tracks.trip_duration(_trips(spark, sf)).select("trip_id", "duration_sec")


@query(
    "h8_trip_summaries",
    f"""SELECT s.*, p.p50 AS accuracy_p50_m, p.p90 AS accuracy_p90_m FROM ({SQL_SUMMARY}) s LEFT JOIN (SELECT trip_id,
          quantile_disc(accuracy, 0.5) AS p50, quantile_disc(accuracy, 0.9) AS p90 FROM v_points WHERE accuracy IS NOT NULL
          GROUP BY trip_id) p ON p.trip_id = s.trip_id""",
)
def _(spark, sf):
    done = tracks.summarize_trips(_trips(spark, sf), _points(spark, sf))
    return done.drop("started_at", "ended_at", "duration_sec").withColumn("distance_m", F.round("distance_m", 1))


@query(
    "h9_active_trips",
    """SELECT trip_id, max(sequence) AS last_sequence, arg_max(event_id, sequence) AS last_event, count(*) AS stored_points
       FROM v_points WHERE user_id % 5 = 0 GROUP BY trip_id""",
)
def _(spark, sf):
    rows = tracks.active_trips(_trips(spark, sf), _points(spark, sf))
    return rows.select(
        "trip_id", F.col("last_point.sequence").alias("last_sequence"), F.col("last_point.event_id").alias("last_event"), "stored_points"
    )


@query(
    "h10_cascade_delete",
    """SELECT 'points' AS t, count(*) AS n FROM events WHERE user_id % 3 <> 0 UNION ALL
       SELECT 'waypoints', count(*) FROM events WHERE user_id % 3 <> 0 AND event_type = 'error'""",
)
def _(spark, sf):
    gone = _trips(spark, sf).where(F.col("user_id") % 3 == 0)
    left = tracks.without_trips({"points": _points(spark, sf), "waypoints": _waypoints(spark, sf)}, gone)
    n = F.count(F.lit(1)).alias("n")
    return left["points"].agg(n).select(F.lit("points").alias("t"), "n").unionByName(
        left["waypoints"].agg(n).select(F.lit("waypoints").alias("t"), "n")
    )


@query("h11_waypoint_privacy", "SELECT 'wp_' || CAST(event_id AS STRING) AS id FROM events WHERE event_type = 'error' AND event_id % 7 = 0")
def _(spark, sf):
    return tracks.waypoint_violations(_waypoints(spark, sf)).select("id")


# --- exports ------------------------------------------------------------------------


@query(
    "a9_places_csv",
    f"""SELECT id, slug, name AS name_kl, danish_name AS name_da, coalesce(CAST(lat AS DOUBLE), -999) AS latitude,
               coalesce(CAST(lon AS DOUBLE), -999) AS longitude, feature_type, municipality, status, updated_at FROM ({SQL_RECORDS})""",
)
def _(spark, sf):
    rows = sinks.places_csv(denorm.denorm_places(domain_tables(spark, sf)))
    as_double = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")).cast("double"), F.lit(-999.0)).alias(c)
    return rows.select(
        "id", "slug", "name_kl", "name_da", as_double("latitude"), as_double("longitude"), "feature_type", "municipality", "status",
        "updated_at",
    )


@query(
    "a9_reachability_csv",
    """SELECT c.id, c.mode, c.direction, s.id AS service_id, s.operator FROM v_connections c
         LEFT JOIN (SELECT * FROM v_connection_services WHERE valid_to IS NULL) s
         ON s.connection_id = c.id WHERE c.retired_at IS NULL""",
)
def _(spark, sf):
    t = domain_tables(spark, sf)
    rows = sinks.reachability_csv(denorm.denorm_reachability(t), denorm.connection_services(t))
    field = lambda name: F.get_json_object("service_json", f"$.{name}").alias("service_id" if name == "id" else name)
    return rows.select("id", "mode", "direction", field("id"), field("operator"))


@query(
    "a10_geojson_features",
    f"""SELECT id, 'place' AS kind, slug AS label, lon, lat FROM ({SQL_RECORDS}) UNION ALL
        SELECT place_id, 'alternate_name', value, NULL, NULL FROM ({SQL_CANON})
        WHERE NOT canon AND place_id IN (SELECT id FROM v_places WHERE status <> 'retired') UNION ALL
        SELECT place_id, 'membership', id, NULL, NULL FROM v_administrative_memberships
        WHERE valid_to IS NULL AND place_id IN (SELECT id FROM v_places WHERE status <> 'retired')""",
)
def _(spark, sf):
    t = domain_tables(spark, sf)
    rows = sinks.to_geojson_features(denorm.denorm_places(t), denorm.place_alternates(t), denorm.place_memberships(t))
    of = lambda path: F.get_json_object("feature", path)
    label = (
        F.when(F.col("kind") == "place", of("$.properties.slug"))
        .when(F.col("kind") == "membership", of("$.properties.assertion_id"))
        .otherwise(of("$.properties.value"))
    )
    spot = lambda i: of(f"$.geometry.coordinates[{i}]").cast("double")
    return rows.select("id", "kind", label.alias("label"), spot(0).alias("lon"), spot(1).alias("lat"))


@query(
    "a11_track_geojson",
    f"""WITH kept AS (SELECT * FROM (SELECT *, {SQL_QUALITY} AS q FROM v_points) WHERE q <> 'rejected'),
        lines AS (SELECT trip_id FROM kept GROUP BY trip_id HAVING count(*) >= 2)
        SELECT trip_id, 'track' AS kind, section, 1 AS n, NULL AS lon_sum FROM lines, (VALUES (0), (2), (4), (6)) s(section)
        UNION ALL SELECT trip_id, 'track', section, count(*), CASE section WHEN 1 THEN sum(longitude)::DECIMAL(18,4)::DOUBLE END
                  FROM kept, (VALUES (1), (3), (5)) s(section) WHERE trip_id IN (SELECT trip_id FROM lines) GROUP BY trip_id, section
        UNION ALL SELECT trip_id, 'track_point', 0, count(*), sum(longitude)::DECIMAL(18,4)::DOUBLE FROM kept GROUP BY trip_id
        UNION ALL SELECT trip_id, 'waypoint', 0, count(*), sum(longitude)::DECIMAL(18,4)::DOUBLE FROM v_points WHERE event_type = 'error' GROUP BY trip_id""",
)
def _(spark, sf):
    rows = sinks.tracks_to_geojson(_points(spark, sf), _waypoints(spark, sf))
    vertex = F.get_json_object(F.ltrim("text", F.lit(",")), "$[0]").cast("double")
    one = F.get_json_object("text", "$.geometry.coordinates[0]").cast("double")
    lon = F.when(F.col("kind") != "track", one).when(F.col("section") == sinks.COORDINATES, vertex)
    total = F.sum(lon).cast("decimal(18,4)").cast("double")
    return rows.groupBy("trip_id", "kind", "section").agg(F.count("*").alias("n"), total.alias("lon_sum"))


SQL_TIME = "strftime(recorded_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
SQL_GPX = f"""WITH ends AS (SELECT DISTINCT trip_id FROM v_points)
    SELECT trip_id, 0 AS section, CAST(0 AS BIGINT) AS position, NULL::DOUBLE AS lat, NULL::DOUBLE AS lon,
           concat_ws('~', '<?xml version="1.0" encoding="UTF-8"?>', '<gpx version="1.1" creator="accessgraph" xmlns="http://www.topografix.com/GPX/1/1">',
             '  <metadata>', '    <name>' || trip_id || '</name>', '    <desc>Exported trip</desc>', '  </metadata>') AS text FROM ends
    UNION ALL SELECT trip_id, 2, 0, NULL, NULL, concat_ws('~', '  <trk>', '    <name>' || trip_id || '</name>', '    <trkseg>') FROM ends
    UNION ALL SELECT trip_id, 4, 0, NULL, NULL, concat_ws('~', '    </trkseg>', '  </trk>', '</gpx>') FROM ends
    UNION ALL SELECT trip_id, 3, sequence, round(latitude, 6), round(longitude, 6),
           concat_ws('~', '      <trkpt lat="" lon="">',
             CASE WHEN event_id % 3 = 0 THEN '      <ele>' || CAST(CAST(event_id % 100 AS DOUBLE) AS STRING) || '</ele>' END,
             '        <time>' || {SQL_TIME} || '</time>', '      </trkpt>') FROM v_points WHERE {SQL_QUALITY} <> 'rejected'
    UNION ALL SELECT trip_id, 1, epoch_us(recorded_at), round(latitude, 6), round(longitude, 6),
           concat_ws('~', '  <wpt lat="" lon="">', '    <time>' || {SQL_TIME} || '</time>', '    <name>hazard &amp; ice</name>',
             '    <desc>note &lt;' || CAST(event_id AS STRING) || '&gt;</desc>', '    <type>hazard &amp; ice</type>', '  </wpt>')
           FROM v_points WHERE event_type = 'error'"""


@query("a12_track_gpx", SQL_GPX)
def _(spark, sf):
    """Every line of every file, with the coordinates as numbers and ~ for the line breaks."""
    rows = sinks.tracks_to_gpx(_points(spark, sf), _waypoints(spark, sf))
    number = lambda name: F.round(F.nullif(F.regexp_extract("text", f' {name}="([^"]*)"', 1), F.lit("")).cast("double"), 6)
    bare = F.regexp_replace("text", ' lat="[^"]*" lon="[^"]*"', ' lat="" lon=""')
    return rows.select(
        "trip_id", "section", "position", number("lat").alias("lat"), number("lon").alias("lon"),
        F.translate(bare, "\n", "~").alias("text"),
    )


# --- streams -------------------------------------------------------------------------

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()),
    ]
)


def _stream(spark, sf):
    """Fixes as they arrive; a stream numbers points on the device, here by the event id."""
    rows = read_stream(spark, f"{sf}/events*.parquet", EVENTS)
    return _fixes(rows).withColumn("sequence", F.col("event_id"))


@query("m1_stream_intake", f"SELECT event_id, {SQL_QUALITY} AS quality FROM v_points")
def _(spark, sf):
    twice = _stream(spark, sf).withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    return drain(live.stream_points(twice, "60 days")).select("event_id", "quality")


@query("m1_stream_last_wins", f"SELECT event_id, 'copy_1' AS provider, {SQL_QUALITY} AS quality FROM v_points")
def _(spark, sf):
    twice = _stream(spark, sf).withColumn("arrival", F.explode(F.array(F.lit(0), F.lit(1))))
    twice = twice.withColumn("provider", F.concat(F.lit("copy_"), F.col("arrival").cast("string")))
    written = drain(twice, each=live.last_arrivals)
    return live.merge_last_arrivals(written).select("event_id", "provider", "quality")


@query("m2_stream_trip_summary", SQL_SUMMARY.replace("ORDER BY sequence", "ORDER BY event_id"))
def _(spark, sf):
    graded = _stream(spark, sf).withColumn("quality", tracks.classify_accuracy(F.col("horizontal_accuracy_m")))
    islands = drain(graded, each=lambda batch: live.trip_islands(batch, chunk=4096))
    return live.combine_trip_islands(islands).withColumn("distance_m", F.round("distance_m", 1))


@query(
    "m3_stream_segments",
    """WITH s AS (SELECT *, sum(CASE WHEN g > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id ORDER BY recorded_at, event_id) AS seg
          FROM (SELECT *, coalesce(date_diff('microsecond', lag(recorded_at) OVER (PARTITION BY trip_id ORDER BY recorded_at, event_id), recorded_at)
                / 1000000.0, 0) AS g FROM v_points))
       SELECT trip_id, min(event_id) AS from_sequence, max(event_id) AS to_sequence, count(*) AS point_count FROM s
       GROUP BY trip_id, seg HAVING max(recorded_at) + INTERVAL 3600 SECOND <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def _(spark, sf):
    rows = drain(live.stream_segments(_stream(spark, sf), "3600 seconds"))
    return rows.select("trip_id", "from_sequence", "to_sequence", "point_count")


# Three micro-batches by time, so that a watermark moves and segments and trips close.
SQL_SLICES = """slices AS (SELECT *, ((epoch_us(ts) - lo) * 3) // (hi - lo + 1) AS slice FROM events, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)),
    marks AS (SELECT max(ts) FILTER (WHERE slice = 0) AS w1, max(ts) FILTER (WHERE slice <= 1) AS w2, max(ts) AS w3 FROM slices)"""


def _slices(spark, sf, rows):
    """The rows of ``events`` by thirds of their time, as ``rows`` makes them."""
    events = base(spark, sf, "events").withColumn("_m", F.unix_micros(F.col("ts").cast("timestamp")))
    low, high = events.agg(F.min("_m"), F.max("_m")).first()
    number = F.call_function("div", (F.col("_m") - low) * 3, F.lit(high - low + 1))
    return [rows(events.where(number == n).drop("_m")) for n in range(3)]


def _steps(spark, batches, state, step, event_time):
    """The folder that a step per batch writes to."""
    folder = f"{durable_dir(spark)}/steps-{uuid4().hex}"
    for number, batch in enumerate(batches):
        stateful.take_step(batch, number, folder, state, step, event_time, timedelta(0))
    return folder


def _numbered_fixes(events):
    return _fixes(events).withColumns(
        {"sequence": F.col("event_id"), "quality": tracks.classify_accuracy(F.col("horizontal_accuracy_m"))}
    )


DAY_US = 86_400_000_000
SQL_TRIPS_OF_DAYS = f"""WITH {SQL_SLICES}, days AS (SELECT * REPLACE (trip_id || '-' || CAST(epoch_us(recorded_at) // {DAY_US} AS STRING) AS trip_id) FROM v_points)"""


@query(
    "m2_stream_closed_trips",
    f"""{SQL_TRIPS_OF_DAYS} SELECT s.* FROM ({SQL_SUMMARY.replace("v_points", "days").replace("ORDER BY sequence", "ORDER BY event_id")}) s
        JOIN (SELECT trip_id FROM days, marks GROUP BY trip_id, w2 HAVING max(recorded_at) + INTERVAL 2 HOUR <= w2) c ON c.trip_id = s.trip_id""",
)
def _(spark, sf):
    """One final row per trip of a day that ended two hours before the last watermark."""

    def rows(events):
        day = F.call_function("div", F.unix_micros("recorded_at"), F.lit(DAY_US)).cast("string")
        return _numbered_fixes(events).withColumn("trip_id", F.concat_ws("-", "trip_id", day))

    folder = _steps(spark, _slices(spark, sf, rows), stateful.RUNS, stateful.trip_step(2 * 3600), "recorded_at")
    return spark.read.parquet(f"{folder}/trips").drop("batch_id").withColumn("distance_m", F.round("distance_m", 1))


@query(
    "m3_stream_closed_and_open_segments",
    f"""WITH {SQL_SLICES}, s AS (SELECT *, sum(CASE WHEN g > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id ORDER BY recorded_at, event_id) AS seg
          FROM (SELECT *, coalesce(date_diff('microsecond', lag(recorded_at) OVER (PARTITION BY trip_id ORDER BY recorded_at, event_id), recorded_at)
                / 1000000.0, 0) AS g FROM v_points))
       SELECT trip_id, min(event_id) AS from_sequence, max(event_id) AS to_sequence, count(*) AS point_count, max(recorded_at) + INTERVAL 3600 SECOND <= w2 AS closed
       FROM s, marks GROUP BY trip_id, seg, w2""",
)
def _(spark, sf):
    folder = _steps(spark, _slices(spark, sf, _numbered_fixes), stateful.SEGMENT, stateful.segment_step(3600), "recorded_at")
    done = spark.read.parquet(f"{folder}/segments").withColumn("closed", F.lit(True))
    rest = spark.read.parquet(f"{folder}/state").where("batch_id = 2").withColumn("closed", F.lit(False))
    return done.unionByName(rest).select("trip_id", "from_sequence", "to_sequence", "point_count", "closed")


@query(
    "m4_stream_active",
    "SELECT trip_id, max(event_id) AS last_event, count(*) AS stored_points FROM v_points GROUP BY trip_id",
)
def _(spark, sf):
    rows = live.merge_active(drain(_stream(spark, sf), each=live.active_in_batch))
    return rows.select("trip_id", F.col("last_point.event_id").alias("last_event"), "stored_points")


def _misses(rows):
    k = F.col("event_id")
    z = (k % 9 + 2).cast("int")
    n = F.pow(F.lit(2.0), z).cast("long")
    return rows.select(
        F.col("ts").cast("timestamp").alias("at"),
        F.when(k % 4 == 0, "land").otherwise("ocean").alias("zone"),
        z.alias("z"),
        ((k * 7919) % n).alias("x"),
        ((k * 104729) % n).alias("y"),
    )


SQL_MISSES = """SELECT ts, CASE WHEN event_id % 4 = 0 THEN 'land' ELSE 'ocean' END AS zone, CAST(event_id % 9 + 2 AS INT) AS z,
    (event_id * 7919) % CAST(power(2, event_id % 9 + 2) AS BIGINT) AS x, (event_id * 104729) % CAST(power(2, event_id % 9 + 2) AS BIGINT) AS y FROM events"""


@query(
    "m5_stream_gaps",
    f"""SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts) AS STRING) AS w, zone, z, x, y, count(*) AS reports FROM ({SQL_MISSES})
        GROUP BY ALL HAVING time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""".replace(
        "GROUP BY ALL", "GROUP BY time_bucket(INTERVAL 6 HOUR, ts), zone, z, x, y"
    ),
)
def _(spark, sf):
    rows = drain(live.stream_gaps(_misses(read_stream(spark, f"{sf}/events*.parquet", EVENTS)), "6 hours"))
    return rows.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("w"), "zone", "z", "x", "y", "reports"
    )


@query(
    "m6_stream_conditions",
    "SELECT event_id, (user_id % 20 = 3 OR event_id % 2 = 0) AS stale FROM events",
)
def _(spark, sf):
    rows = read_stream(spark, f"{sf}/events*.parquet", EVENTS)
    text = F.when(F.col("user_id") % 20 == 3, "soon").when(F.col("event_id") % 2 == 0, "2020-01-01T00:00:00Z").otherwise("2999-01-01T00:00:00Z")
    return drain(live.stream_conditions(rows.select("event_id", text.alias("valid_to")))).select("event_id", "stale")


@query(
    "m6_stream_conditions_by_clock",
    f"""WITH {SQL_SLICES}, c AS (SELECT event_id, slice, ts + INTERVAL 1 HOUR * (event_id % 400 - 100) AS valid_to FROM slices)
        SELECT CAST(event_id AS STRING) AS condition_id, strftime(CASE WHEN slice = 0 AND valid_to <= w1 THEN w1 WHEN slice <= 1 AND valid_to <= w2 THEN w2
               ELSE w3 END, '%Y-%m-%d %H:%M:%S') AS stale_at FROM c, marks WHERE valid_to <= w3""",
)
def _(spark, sf):
    """Conditions that turn stale when the clock of a later batch passes them."""
    end = F.col("ts").cast("timestamp") + F.make_dt_interval(hours=(F.col("event_id") % 400 - 100).cast("int"))
    rows = lambda events: events.select(F.col("event_id").cast("string").alias("condition_id"), end.alias("valid_to"), F.col("ts").alias("clock"))
    folder = _steps(spark, _slices(spark, sf, rows), stateful.CONDITION, stateful.condition_step(), "clock")
    return spark.read.parquet(f"{folder}/stale").select("condition_id", F.date_format("stale_at", "yyyy-MM-dd HH:mm:ss").alias("stale_at"))


@query("m7_outbox_delivery", "SELECT event_id, TRUE AS marked FROM events WHERE user_id % 3 = 0")
def _(spark, sf):
    """Pending events that come twice, in batches that are sent twice, are delivered once and marked."""
    folder = f"{durable_dir(spark)}/outbox-{uuid4().hex}"
    pending = lambda events: events.select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("ts").cast("timestamp")).alias("flushed_at"))
    first, second, third = _slices(spark, sf, pending)
    send = lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/out/batch_id={number}")
    for number, batch in ((0, first), (0, first), (1, first.unionByName(second)), (2, second.unionByName(third)), (2, third)):
        stateful.deliver_batch(batch, number, folder, send)
    sent = spark.read.parquet(f"{folder}/out").select("event_id")
    marked = stateful.flushed(pending(base(spark, sf, "events")), folder).where("flushed_at IS NOT NULL").select("event_id").distinct()
    return sent.join(marked.withColumn("marked", F.lit(True)), "event_id", "left")


@query("m7_stream_outbox", "SELECT event_id FROM events WHERE user_id % 3 = 0")
def _(spark, sf):
    rows = read_stream(spark, f"{sf}/events*.parquet", EVENTS)
    flushed = rows.withColumn("flushed_at", F.when(F.col("user_id") % 3 != 0, F.col("ts")))
    return drain(live.stream_outbox(flushed)).select("event_id")


@query(
    "j21_gap_zones",
    f"""WITH t AS (SELECT DISTINCT zone, z, x, y FROM ({SQL_MISSES})), b AS (SELECT zone, x / power(2, z) * 360 - 180 AS w,
            (x + 1) / power(2, z) * 360 - 180 AS e, degrees(atan(sinh(pi() * (1 - 2 * y / power(2, z))))) AS n,
            degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / power(2, z))))) AS s FROM t),
          v AS (SELECT s_suppkey AS viewport_id, -170.03 + (s_suppkey % 33) * 10 AS w, -170.03 + (s_suppkey % 33) * 10 + 1.5 AS e,
                -70.01 + (s_suppkey % 14) * 10 AS s, -70.01 + (s_suppkey % 14) * 10 + 1.2 AS n FROM supplier)
        SELECT viewport_id, coalesce(bool_or(b.zone = 'land'), FALSE) AS land, coalesce(bool_or(b.zone <> 'land'), FALSE) AS ocean
        FROM v LEFT JOIN b ON b.w < v.e AND b.e > v.w AND b.s < v.n AND b.n > v.s GROUP BY viewport_id""",
)
def _(spark, sf):
    k = F.col("s_suppkey")
    west, south = F.lit(-170.03) + (k % 33) * 10, F.lit(-70.01) + (k % 14) * 10
    viewports = base(spark, sf, "supplier").select(
        k.alias("viewport_id"), west.alias("west"), south.alias("south"), (west + 1.5).alias("east"), (south + 1.2).alias("north")
    )
    return grids.gap_zones(_misses(base(spark, sf, "events")), viewports)
