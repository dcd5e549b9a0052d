"""Text exports: NDJSON, CSV, GeoJSON and GPX."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessgraph.functions.text import xml_text
from accessgraph.operators.windows import numbered

SHOWN_NULLS = {"ignoreNullFields": "false"}


def to_lines(df: DataFrame) -> DataFrame:
    """One JSON text per row, nulls written out."""
    return df.select(F.to_json(F.struct(*df.columns), SHOWN_NULLS).alias("value"))


def write_ndjson(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none", lines_per_file: int = 0) -> None:
    """NDJSON part files. Packed ones cannot be split by readers, so ``lines_per_file`` keeps each small; 0 sets no bound."""
    to_lines(df).write.mode(mode).option("maxRecordsPerFile", lines_per_file).text(path, compression=compression)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def places_csv(denormalized: DataFrame) -> DataFrame:
    """Flat columns of denormalized places with their first Danish name and first open membership."""
    return denormalized.select(
        "id",
        "slug",
        F.col("canonical_name.value").alias("name_kl"),
        F.col("danish_name").alias("name_da"),
        F.coalesce(F.col("coordinates.latitude").cast("string"), F.lit("")).alias("latitude"),
        F.coalesce(F.col("coordinates.longitude").cast("string"), F.lit("")).alias("longitude"),
        "feature_type",
        "municipality",
        "status",
        F.col("updated_at").cast("string").alias("updated_at"),
    )


def reachability_csv(denormalized: DataFrame, services: DataFrame) -> DataFrame:
    """A row per connection and service, the service as JSON text; a connection without any has one empty text."""
    texts = services.select(F.col("connection_id").alias("id"), F.to_json("service", SHOWN_NULLS).alias("service_json"))
    return denormalized.join(texts, "id", "left").select(
        "id",
        "origin_place_id",
        "destination_place_id",
        "direction",
        "mode",
        F.coalesce("service_json", F.lit("")).alias("service_json"),
        F.col("updated_at").cast("string").alias("updated_at"),
    )


def _feature(properties: Column, geometry: Column) -> Column:
    return F.to_json(
        F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")), SHOWN_NULLS
    )


def _point(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def to_geojson_features(denormalized: DataFrame, alternates: DataFrame, memberships: DataFrame) -> DataFrame:
    """Rows (id, kind, feature): one ``place`` feature per place, and one without geometry per name and membership.

    The geometry of a place is null without coordinates.
    """
    refs = F.coalesce(F.col("coordinates.source_refs"), F.array().cast(denormalized.schema["source_refs"].dataType))
    properties = F.struct(
        "id",
        "slug",
        F.col("canonical_name.value").alias("name_kl"),
        "feature_type",
        "status",
        "classification_source_refs",
        "source_refs",
        refs.alias("geometry_source_refs"),
        "updated_at",
    )
    spot = F.when(
        F.col("coordinates").isNotNull(), _point(F.col("coordinates.longitude"), F.col("coordinates.latitude"))
    )
    nowhere = F.lit(None).cast("struct<type:string,coordinates:array<double>>")
    rows = denormalized.select("id", F.lit("place").alias("kind"), _feature(properties, spot).alias("feature"))
    for kind, children in (("alternate_name", alternates), ("membership", memberships)):
        rows = rows.unionByName(
            children.select(
                F.col("place_id").alias("id"),
                F.lit(kind).alias("kind"),
                _feature(F.struct(*children.columns), nowhere).alias("feature"),
            )
        )
    return rows


def _iso(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _accepted(points: DataFrame) -> DataFrame:
    return points.where(F.col("quality") != "rejected")


def _non_empty(points: DataFrame, waypoints: DataFrame) -> None:
    if points.isEmpty() and waypoints.isEmpty():
        raise ValueError("cannot export an empty trip")


# Sections of a track feature in writing order.
BEGIN, COORDINATES, TIMES, TIME_LIST, ACCURACIES, ACCURACY_LIST, END = range(7)


def track_lines(points: DataFrame) -> DataFrame:
    """Rows (trip_id, section, position, text); read in this order they are one line feature per trip.

    A row holds one vertex, its time or its accuracy, so a trip of any length
    is one line and no row grows with it. Trips with fewer than two accepted
    points have no line.
    """
    kept = _accepted(points)
    trips = kept.groupBy("trip_id").agg(F.count(F.lit(1)).alias("_points"), F.min("sequence").alias("_first")).where("_points >= 2")
    placed = kept.join(trips, "trip_id")
    comma = F.when(F.col("sequence") == F.col("_first"), "").otherwise(",")
    json = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v")), SHOWN_NULLS), r'^\{"v":(.*)\}$', 1)
    spot = F.to_json(F.array("longitude", "latitude"))
    vertices = placed.select(
        "trip_id",
        F.col("sequence").alias("position"),
        F.explode(
            F.array(
                F.struct(F.lit(COORDINATES).alias("section"), F.concat(comma, spot).alias("text")),
                F.struct(F.lit(TIME_LIST).alias("section"), F.concat(comma, json(_iso("recorded_at"))).alias("text")),
                F.struct(F.lit(ACCURACY_LIST).alias("section"), F.concat(comma, json(F.col("horizontal_accuracy_m"))).alias("text")),
            )
        ).alias("_v"),
    ).select("trip_id", "_v.section", "position", "_v.text")
    opening = F.lit('{"type":"Feature","geometry":{"type":"LineString","coordinates":[')
    middle = F.concat(
        F.lit(']},"properties":{"tripId":'), json(F.col("trip_id")), F.lit(',"kind":"track","pointCount":'),
        F.col("_points").cast("string"), F.lit(',"timestamps":['),
    )
    frame = trips.select(
        "trip_id",
        F.explode(
            F.array(
                F.struct(F.lit(BEGIN).alias("section"), opening.alias("text")),
                F.struct(F.lit(TIMES).alias("section"), middle.alias("text")),
                F.struct(F.lit(ACCURACIES).alias("section"), F.lit('],"horizontalAccuracyM":[').alias("text")),
                F.struct(F.lit(END).alias("section"), F.lit("]}}").alias("text")),
            )
        ).alias("_f"),
    ).select("trip_id", "_f.section", F.lit(0).cast("long").alias("position"), "_f.text")
    return frame.unionByName(vertices)


def tracks_to_geojson(points: DataFrame, waypoints: DataFrame, check: bool = True) -> DataFrame:
    """Rows (trip_id, kind, section, position, text): lines by section, accepted points and waypoints as whole features."""
    if check:
        _non_empty(points, waypoints)
    spot = _feature(
        F.struct(
            F.col("trip_id").alias("tripId"),
            F.lit("track_point").alias("kind"),
            "sequence",
            _iso("recorded_at").alias("recordedAt"),
            F.col("horizontal_accuracy_m").alias("horizontalAccuracyM"),
            F.col("speed_mps").alias("speedMps"),
            F.col("course_deg").alias("courseDeg"),
            "provider",
            "quality",
        ),
        _point(F.col("longitude"), F.col("latitude")),
    )
    mark = _feature(
        F.struct(
            F.col("trip_id").alias("tripId"),
            F.lit("waypoint").alias("kind"),
            "category",
            "note",
            _iso("recorded_at").alias("recordedAt"),
            F.col("visibility.type").alias("visibility"),
        ),
        _point(F.col("longitude"), F.col("latitude")),
    )
    whole = lambda kind: [F.lit(kind).alias("kind"), F.lit(0).alias("section")]
    return (
        track_lines(points)
        .withColumn("kind", F.lit("track"))
        .unionByName(
            _accepted(points).select("trip_id", *whole("track_point"), F.col("sequence").alias("position"), spot.alias("text"))
        )
        .unionByName(
            waypoints.select("trip_id", *whole("waypoint"), F.lit(0).cast("long").alias("position"), mark.alias("text"))
        )
        .select("trip_id", "kind", "section", "position", "text")
    )


# Sections of a GPX text in writing order.
HEAD, WAYPOINTS, OPEN, TRACK, CLOSE = range(5)


def tracks_to_gpx(
    points: DataFrame, waypoints: DataFrame, creator: str = "accessgraph", check: bool = True, description: str = "Exported trip"
) -> DataFrame:
    """Rows (trip_id, section, position, text); read in this order they are one GPX file per trip.

    A row holds one point or waypoint, so trips of any length export in parallel.
    """
    if check:
        _non_empty(points, waypoints)
    trips = points.select("trip_id").union(waypoints.select("trip_id")).distinct()
    name = xml_text(F.col("trip_id"))
    number = lambda c: F.col(c).cast("string")
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="'),
        xml_text(F.lit(creator)),
        F.lit('" xmlns="http://www.topografix.com/GPX/1/1">\n  <metadata>\n    <name>'),
        name,
        F.lit("</name>\n    <desc>"),
        xml_text(F.lit(description)),
        F.lit("</desc>\n  </metadata>"),
    )
    opening = F.concat(F.lit("  <trk>\n    <name>"), name, F.lit("</name>\n    <trkseg>"))
    frame = trips.select(
        "trip_id",
        F.explode(
            F.array(
                F.struct(F.lit(HEAD).alias("section"), head.alias("text")),
                F.struct(F.lit(OPEN).alias("section"), opening.alias("text")),
                F.struct(F.lit(CLOSE).alias("section"), F.lit("    </trkseg>\n  </trk>\n</gpx>").alias("text")),
            )
        ).alias("_f"),
    ).select("trip_id", "_f.section", F.lit(0).cast("long").alias("position"), "_f.text")
    elevation = F.when(
        F.col("altitude_m").isNotNull(), F.concat(F.lit("\n      <ele>"), number("altitude_m"), F.lit("</ele>"))
    ).otherwise("")
    track = F.concat(
        F.lit('      <trkpt lat="'), number("latitude"), F.lit('" lon="'), number("longitude"), F.lit('">'), elevation,
        F.lit("\n        <time>"), xml_text(_iso("recorded_at")), F.lit("</time>\n      </trkpt>"),
    )
    category = xml_text(F.col("category"))
    mark = F.concat(
        F.lit('  <wpt lat="'), number("latitude"), F.lit('" lon="'), number("longitude"), F.lit('">\n    <time>'),
        xml_text(_iso("recorded_at")), F.lit("</time>\n    <name>"), category, F.lit("</name>\n    <desc>"),
        xml_text(F.col("note")), F.lit("</desc>\n    <type>"), category, F.lit("</type>\n  </wpt>"),
    )
    return frame.unionByName(
        _accepted(points).select(
            "trip_id", F.lit(TRACK).alias("section"), F.col("sequence").alias("position"), track.alias("text")
        )
    ).unionByName(
        waypoints.select(
            "trip_id", F.lit(WAYPOINTS).alias("section"), F.unix_micros("recorded_at").alias("position"), mark.alias("text")
        )
    )


def write_ordered_text(df: DataFrame, path: str, order: Sequence[str], column: str = "text", mode: str = "errorifexists") -> None:
    """Write text rows so that the part files, read in name order, keep the given order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(column).write.mode(mode).text(path)
