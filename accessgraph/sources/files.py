"""File listings with digests, and dated snapshots."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessgraph.schemas import META_TABLES


def open_filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Hadoop or plain path, for tasks that read or write single files."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path)


def write_named_files(rows: DataFrame, root: str) -> None:
    """Write each (path, content) row to its own file below ``root``.

    Tasks write through ``pyarrow.fs`` under a name of their attempt and rename,
    so a repeated attempt leaves one whole file; of repeated paths one stays.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = open_filesystem(f"{root}/{path}")
                folder = name.rsplit("/", 1)[0]
                system.create_dir(folder, recursive=True)
                draft = f"{folder}/_draft-{attempt}"
                with system.open_output_stream(draft) as out:
                    out.write(content)
                system.move(draft, name)
            yield batch.select([0])

    named = rows.select("path", F.col("content").cast("binary").alias("content"))
    named.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()


def scan_files(spark: SparkSession, glob: str, root: str = "") -> DataFrame:
    """Rows (path, bytes, sha256), the path relative to ``root``; one file per task record.

    Spark reads a file of this source whole, so a file must fit a task (2 GB).
    """
    files = spark.read.format("binaryFile").load(glob)
    relative = F.regexp_replace("path", "^file:/+", "/")
    if root:
        relative = F.substring_index(relative, root.rstrip("/") + "/", -1)
    return files.select(relative.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def snapshot_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Snapshot manifests two folders below ``root``; the date is the folder name."""
    found = (
        spark.read.schema(META_TABLES["source_snapshots"])
        .option("multiLine", True)
        .json(f"{root}/*/*/manifest.json")
        .withColumn("_parts", F.split("_metadata.file_path", "/"))
    )
    return (
        found.where(F.startswith("id", F.lit("snp_")))
        .withColumn("source", F.element_at("_parts", -3))
        .withColumn("snapshot_date", F.element_at("_parts", -2))
        .drop("_parts")
    )


def latest_snapshot(files: DataFrame, names: Sequence[str] = (), required: str | None = None) -> DataFrame:
    """Newest dated snapshot per source from (source, snapshot_date, name) rows.

    ``names`` are payloads in order of preference: the first name that any
    snapshot of the source has wins over newer snapshots without it.
    ``required`` keeps only snapshots that also hold that file.
    """
    rows = files
    if required is not None:
        holders = files.where(F.col("name") == required).select("source", "snapshot_date").distinct()
        rows = rows.join(holders, ["source", "snapshot_date"], "left_semi")
    wanted = names or (required,)
    rank = F.array_position(F.array(*[F.lit(n) for n in wanted]), F.col("name"))
    usable = rows.where(rank > 0)
    best = F.struct((-rank).alias("rank"), F.col("snapshot_date"))
    return usable.groupBy("source").agg(
        F.max_by(F.struct("snapshot_date", "name"), best).alias("_b")
    ).select("source", "_b.snapshot_date", "_b.name")


def non_empty(tiles: DataFrame, content: str = "content") -> DataFrame:
    """Tiles with at least one byte."""
    return tiles.where(F.octet_length(content) > 0)
