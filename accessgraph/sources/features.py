"""Reading feature collections: register pages, points and land polygons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accessgraph.functions.text import clean_name, loose_true, strip_gid
from accessgraph.session import cut_lineage

NUMBER = T.DoubleType()
ATTRIBUTES = T.StructType(
    [T.StructField(n, NUMBER) for n in ("OBJECTID", "ID", "Type", "MunicipalityCode")]
    + [
        T.StructField(n, T.StringType())
        for n in ("GlobalID", "PlacenameOfficial", "PlacenameOfficialOld", "PlacenameDanish", "LokalityCode")
    ]
)
XY = T.StructType([T.StructField("x", NUMBER), T.StructField("y", NUMBER)])
PAGE = T.StructType(
    [
        T.StructField(
            "features",
            T.ArrayType(T.StructType([T.StructField("attributes", ATTRIBUTES), T.StructField("geometry", XY)])),
        ),
        T.StructField("exceededTransferLimit", T.BooleanType()),
    ]
)


def _usable(number: Column) -> Column:
    return number.isNotNull() & ~F.isnan(number) & ~F.abs(number).isin(float("inf"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).option("multiLine", True).json(path)


def ingest_feature_pages(pages: DataFrame, with_geometry: bool = True) -> DataFrame:
    """One row per complete feature of the saved pages; the others are dropped."""
    flat = pages.select(F.explode("features").alias("f")).select("f.attributes.*", "f.geometry")
    rows = flat.select(
        F.col("ID").alias("record_id"),
        strip_gid(clean_name(F.col("GlobalID"))).alias("global_id"),
        clean_name(F.col("PlacenameOfficial")).alias("official_name"),
        clean_name(F.col("PlacenameDanish")).alias("danish_name"),
        clean_name(F.col("PlacenameOfficialOld")).alias("old_official_name"),
        F.col("Type").alias("type_code"),
        F.col("MunicipalityCode").cast("int").alias("municipality_code"),
        clean_name(F.col("LokalityCode")).alias("locality_code"),
        F.col("geometry.x").alias("longitude"),
        F.col("geometry.y").alias("latitude"),
    )
    complete = F.col("official_name").isNotNull() & F.col("global_id").isNotNull()
    complete = complete & _usable(F.col("record_id")) & _usable(F.col("type_code"))
    if with_geometry:
        complete = complete & _usable(F.col("longitude")) & _usable(F.col("latitude"))
    kept = rows.where(complete)
    return kept.withColumn("record_id", F.col("record_id").cast("long")).withColumn("type_code", F.col("type_code").cast("int"))


def read_point_features(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("features array<string>").option("multiLine", True).json(path)
    return point_features(raw.select(F.explode("features").alias("value")))


def point_features(features: DataFrame, value: str = "value") -> DataFrame:
    """Place rows from Point feature texts with loosely typed properties; others are skipped."""
    v = F.try_parse_json(value)
    text = lambda path: F.try_variant_get(v, path, "string")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    is_number = lambda path: F.coalesce(kind(path).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.lit(False))
    is_text = lambda path: F.coalesce(kind(path) == "STRING", F.lit(False))
    number = lambda path: F.when(is_number(path), F.try_variant_get(v, path, "double"))
    given = lambda name: F.when(is_text(f"$.properties.{name}"), text(f"$.properties.{name}"))
    lon, lat = number("$.geometry.coordinates[0]"), number("$.geometry.coordinates[1]")
    name = clean_name(F.coalesce(text("$.properties.officialName"), text("$.properties.name")))
    rows = features.select(
        text("$.geometry.type").alias("_type"),
        F.coalesce(text("$.properties.globalId"), F.concat_ws(",", lon.cast("string"), lat.cast("string"))).alias("global_id"),
        number("$.properties.recordId").cast("long").alias("record_id"),
        name.alias("official_name"),
        F.nullif(given("danishName"), F.lit("")).alias("danish_name"),
        F.nullif(given("oldOfficialName"), F.lit("")).alias("old_official_name"),
        F.coalesce(text("$.properties.featureKind"), F.lit("other")).alias("feature_kind"),
        number("$.properties.typeCode").cast("int").alias("type_code"),
        F.coalesce(text("$.properties.typeLabel"), F.lit("")).alias("type_label"),
        loose_true(text("$.properties.isLocality")).alias("is_locality"),
        given("municipalityName").alias("municipality_name"),
        given("localityCode").alias("locality_code"),
        lon.alias("longitude"),
        lat.alias("latitude"),
    )
    usable = (F.col("_type") == "Point") & F.col("longitude").isNotNull() & F.col("latitude").isNotNull()
    return rows.where(usable & F.col("official_name").isNotNull()).drop("_type")


# --- land polygons --------------------------------------------------------------------

POSITIONS = "array<array<array<double>>>"


def read_land_polygons(features: DataFrame, value: str = "value") -> DataFrame:
    """Polygon rows (polygon_id, rings, west, south, east, north) from land feature texts.

    Polygons, multi-polygons and collections of them (nested to any
    depth) are accepted. Features of another kind and outer rings of fewer than
    four positions are left out.
    """
    kind = F.get_json_object(value, "$.properties.kind")
    land = features.where(F.coalesce(kind, F.lit("")).isin("", "land"))
    geometry = land.select(F.xxhash64(value).alias("_feature"), F.get_json_object(value, "$.geometry").alias("_g"))
    # Collections are opened until none is left: one written step per level of nesting.
    nested = F.coalesce(F.get_json_object("_g", "$.type"), F.lit("")) == "GeometryCollection"
    inner = F.from_json(F.get_json_object("_g", "$.geometries"), "array<string>")
    plain = [geometry.where(~nested)]
    unopened = cut_lineage(geometry.where(nested))
    while not unopened.isEmpty():
        opened = unopened.select("_feature", F.explode(inner).alias("_g"))
        plain.append(opened.where(~nested))
        unopened = cut_lineage(opened.where(nested))
    geometry = reduce(DataFrame.unionByName, plain)
    shape, coordinates = F.get_json_object("_g", "$.type"), F.get_json_object("_g", "$.coordinates")
    polygons = F.when(shape == "Polygon", F.array(F.from_json(coordinates, POSITIONS))).when(
        shape == "MultiPolygon", F.from_json(coordinates, f"array<{POSITIONS}>")
    )
    return polygon_rows(
        geometry.select("_feature", F.explode(polygons).alias("_p")).select(
            F.xxhash64("_feature", F.to_json("_p")).alias("polygon_id"),
            F.transform(
                "_p",
                lambda ring: F.transform(ring, lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat"))),
            ).alias("rings"),
        )
    )


def polygon_rows(polygons: DataFrame) -> DataFrame:
    """Add the box of the outer ring; rings are arrays of (lon, lat), the first one is the outer."""
    lons = F.transform(F.col("rings")[0], lambda c: c["lon"])
    lats = F.transform(F.col("rings")[0], lambda c: c["lat"])
    return polygons.where(F.size(F.get("rings", F.lit(0))) >= 4).select(
        "polygon_id",
        "rings",
        F.array_min(lons).alias("west"),
        F.array_min(lats).alias("south"),
        F.array_max(lons).alias("east"),
        F.array_max(lats).alias("north"),
    )
