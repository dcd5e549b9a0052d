"""Reading records, tables and named releases."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accessgraph.schemas import TABLES

CORRUPT = "_corrupt_record"


def _missing(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in (error.getCondition() or str(error))


def read_records(spark: SparkSession, path: str, schema: T.StructType, layout: str = "json") -> DataFrame:
    """NDJSON rows of a fixed shape; blank lines are skipped and a missing file is an empty table."""
    try:
        return spark.read.schema(schema).format(layout).load(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], schema)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, line, value) of every line of the text files at ``path``; lines count from 1, blank ones included.

    A file is read in splits. A line's number is its place inside its split
    plus the lines of the file's earlier splits, which are one row each. Rows
    of a split carry rising ids without gaps; both reads of ``lines`` plan the
    same splits. Files that cannot be split are one split.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], "file string, path string, line long, value string")
    lines = lines.select(
        "value",
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = lines.groupBy("path", "split").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    line = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return lines.join(splits, ["path", "split"]).select("file", "path", line.alias("line"), "value")


def read_records_strict(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, violations): a line that is not a JSON object of this shape becomes a violation with file, line and text.

    The lines are read as text and parsed by column, so the bad lines keep
    their full text and the good ones keep pushdown on the parsed fields. Only
    the violations need line numbers, so the rows are read without shuffle.
    """
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})

    def parse(lines: DataFrame) -> DataFrame:
        return lines.where(F.trim("value") != "").withColumn("_r", parsed)

    broken = F.col(f"_r.{CORRUPT}").isNotNull()
    numbered = numbered_lines(spark, path)
    plain = read_records(spark, path, T.StructType([T.StructField("value", T.StringType())]), "text")
    rows = parse(plain).where(~broken).select(*[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields])
    violations = parse(numbered).where(broken).select(
        F.col("file").alias("table"),
        F.lit("json").alias("rule"),
        F.sha2("value", 256).alias("key"),
        F.concat(F.concat_ws(":", "file", "line"), F.lit(": invalid JSON: "), "value").alias("message"),
        "path",
        "line",
    )
    return rows, violations


def file_name(table: str) -> str:
    return table.replace("_", "-") + ".ndjson"


def load_tables(spark: SparkSession, root: str, views: bool = False, layout: str = "ndjson") -> dict[str, DataFrame]:
    """The ten canonical tables of a folder, as NDJSON or Parquet, optionally as temp views."""
    tables = {}
    for name, schema in TABLES.items():
        if layout == "ndjson":
            tables[name] = read_records(spark, f"{root}/{file_name(name)}", schema)
        else:
            tables[name] = spark.read.schema(schema).parquet(f"{root}/{name}")
        if views:
            tables[name].createOrReplaceTempView(name)
    return tables


def split_flat_places(flat: DataFrame, source_id: str = "src_legacy_seed") -> dict[str, DataFrame]:
    """Identity, classification, name, geometry, area and membership tables from wide place records."""
    from accessgraph.operators.reconcile import minted_id

    none = F.lit(None)
    refs = F.array(F.struct(F.lit(source_id).alias("source_id"), none.cast("string").alias("record_id"))).alias("source_refs")
    window = [none.cast("date").alias("valid_from"), none.cast("date").alias("valid_to")]
    seen = F.col("updated_at").cast("date")
    place = F.col("id").alias("place_id")
    canonical = F.struct(
        F.col("canonical_name.value").alias("value"), F.col("canonical_name.language").alias("language"), F.lit("official").alias("kind")
    )
    others = F.transform(
        F.coalesce("alternate_names", F.array().cast(flat.schema["alternate_names"].dataType)),
        lambda n: F.struct(
            n["value"].alias("value"), n["language"].alias("language"), F.coalesce(n["kind"], F.lit("exonym")).alias("kind")
        ),
    )
    names = flat.select(place, seen.alias("observed_at"), F.posexplode(F.concat(F.array(canonical), others)).alias("_pos", "_n"))
    members = flat.select(place, seen.alias("observed_at"), F.posexplode("administrative_memberships").alias("_pos", "_m")).where(
        F.col("_m.level") == "municipality"
    )
    area_id = minted_id("adm", F.col("_m.name"))
    return {
        "places": flat.select("id", "status", seen.alias("created_at"), none.cast("date").alias("retired_at"), refs),
        "place_classifications": flat.select(
            minted_id("cls", F.col("id")).alias("id"), place, "feature_type", *window, refs, seen.alias("observed_at")
        ),
        "place_names": names.select(
            minted_id("nam", F.col("place_id"), F.col("_pos").cast("string")).alias("id"), "place_id", "_n.*", *window, refs, "observed_at"
        ),
        "place_geometries": flat.select(
            minted_id("geo", F.col("id")).alias("id"),
            place,
            F.struct(
                F.lit("Point").alias("type"), F.array("coordinates.longitude", "coordinates.latitude").alias("coordinates")
            ).alias("geometry"),
            *window,
            refs,
            seen.alias("observed_at"),
        ),
        "administrative_areas": members.select(
            area_id.alias("id"), F.col("_m.name").alias("name"), F.col("_m.level").alias("level")
        ).distinct().select("*", refs),
        "administrative_memberships": members.select(
            minted_id("mem", F.col("place_id"), F.col("_pos").cast("string")).alias("id"),
            "place_id",
            area_id.alias("administrative_area_id"),
            F.col("_m.valid_from").cast("date").alias("valid_from"),
            F.col("_m.valid_to").cast("date").alias("valid_to"),
            refs,
            "observed_at",
        ),
    }


# --- named releases -----------------------------------------------------------------


def publish_release(
    tables: Mapping[str, DataFrame], root: str, release_id: str, notes: str = "", update_current: bool = True
) -> str:
    """Write tables under a new release folder, then move the pointer.

    An existing release is never overwritten. The release record is written
    last; a folder without it is an unfinished attempt and cannot be opened.
    """
    spark = next(iter(tables.values())).sparkSession
    folder = f"{root}/{release_id}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    row = [(release_id, notes, ",".join(sorted(tables)))]
    record = spark.createDataFrame(row, "release_id string, notes string, tables string").withColumn(
        "selected_at", F.current_timestamp()
    )
    record.coalesce(1).write.mode("errorifexists").json(f"{folder}/_release")
    if update_current:
        pointer = record.select("release_id", "selected_at")
        pointer.coalesce(1).write.mode("append").json(f"{root}/_current")
    return folder


def open_release(spark: SparkSession, root: str, release_id: str | None = None) -> dict[str, DataFrame]:
    """Tables of a release by id, or of the one the newest pointer row names."""
    if release_id is None:
        pointers = spark.read.schema("release_id string, selected_at timestamp").json(f"{root}/_current")
        release_id = pointers.agg(F.max_by("release_id", "selected_at")).first()[0]
        if release_id is None:
            raise ValueError("no release is selected")
    record = spark.read.schema("release_id string, tables string").json(f"{root}/{release_id}/_release").first()
    if record is None or record["release_id"] != release_id:
        raise ValueError(f"release {release_id} is not complete")
    return {name: spark.read.parquet(f"{root}/{release_id}/{name}") for name in record["tables"].split(",")}
