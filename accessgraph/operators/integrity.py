"""File and package integrity: digests, manifests and their rules."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessgraph.operators.quality import record_counts
from accessgraph.operators.temporal import Tables, data_as_of

# Size cap, corridor box and the files of a full terrain pack.
MAX_PACK_BYTES = 300 * 1024 * 1024
CORRIDOR_BBOX = (-58.5, 70.4, -50.5, 74.9)
TERRAIN_FILES = (
    "land-relief.pmtiles",
    "land-peaks.pmtiles",
    "ocean-depth-dem.pmtiles",
    "ocean-depth-vector.pmtiles",
    "coastline-land/land.pmtiles",
)

# Bytes of a package's lines that are joined before they are hashed.
BLOCK_BYTES = 1 << 16


def verify_files(manifest: DataFrame, files: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Status of each listed file: missing, size_mismatch, checksum_mismatch or ok."""
    have = files.select(*keys, F.col("bytes").alias("found_bytes"), F.col("sha256").alias("found_sha256"))
    status = (
        F.when(F.col("found_bytes").isNull(), "missing")
        .when(F.col("found_bytes") != F.col("bytes"), "size_mismatch")
        .when(F.col("found_sha256") != F.lower("sha256"), "checksum_mismatch")
        .otherwise("ok")
    )
    return manifest.join(have, list(keys), "left").withColumn("status", status)


def listed_files(manifests: DataFrame) -> DataFrame:
    """One row per file of each manifest."""
    return manifests.select(F.col("id").alias("package_id"), F.explode("files").alias("_f")).select(
        "package_id", "_f.path", "_f.bytes", "_f.sha256"
    )


def aggregate_digests(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(package_id, sha256): the SHA-256 over the sorted ``path:sha256`` lines of each package's files.

    Lines are sorted by ranges over all packages and joined to blocks of about
    ``block_bytes`` where they are, so a large package is sorted by many tasks.
    A digest is one running hash by its nature: a package's blocks are sorted
    into one task, which hashes them batch by batch and holds none of them.
    Files without a path or a digest have no line; a package without lines has
    the digest of nothing.
    """
    key = files.schema["package_id"].dataType.simpleString()
    named = files.select("package_id", "path", "sha256")
    ranged = named.repartitionByRange("package_id", "path", "sha256").sortWithinPartitions("package_id", "path", "sha256")

    def join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        package, lines, held, nth = None, [], 0, 0

        def block() -> pa.RecordBatch:
            text = "".join(f"{line}\n" for line in lines).encode()
            fields = [pa.array([package], kind), pa.array([part], pa.int32()), pa.array([nth], pa.int64()), pa.array([text])]
            return pa.RecordBatch.from_arrays(fields, ["package_id", "part", "nth", "block"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for at, path, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if nth == 0 and not lines and not held:
                    package, held = at, 1
                if at != package or held >= block_bytes:
                    yield block()
                    package, lines, held, nth = at, [], 1, nth + 1
                if path is not None and digest is not None:
                    lines.append(f"{path}:{digest}")
                    held += len(path) + len(digest) + 2
        if held:
            yield block()

    def run_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([package], kind), pa.array([digest.hexdigest()])], ["package_id", "sha256"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for at, block in zip(batch.column(0), batch.column(1), strict=True):
                if digest is None or at.as_py() != package:
                    if digest is not None:
                        yield row()
                    package, digest = at.as_py(), hashlib.sha256()
                digest.update(block.as_buffer())
        if digest is not None:
            yield row()

    blocks = ranged.mapInArrow(join_lines, f"package_id {key}, part int, nth long, block binary")
    ordered = blocks.repartition("package_id").sortWithinPartitions("package_id", "part", "nth")
    return ordered.select("package_id", "block").mapInArrow(run_hash, f"package_id {key}, sha256 string")


def verify_aggregate(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(id, digest_ok): whether the stated digest of each manifest is that of its file rows."""
    found = aggregate_digests(files).select(F.col("package_id").alias("id"), F.col("sha256").alias("_found"))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    same = F.coalesce("_found", nothing) == F.lower("sha256")
    return manifests.join(found, "id", "left").select("id", same.alias("digest_ok"))


def verify_primary(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Check one file per package against the primary values, else against the package values."""
    wanted = manifests.select(
        F.col("id").alias("package_id"),
        F.coalesce("primary_file", F.lit("places.geojson")).alias("path"),
        F.coalesce("primary_bytes", "bytes").alias("bytes"),
        F.lower(F.coalesce("primary_sha256", "sha256")).alias("sha256"),
    )
    return verify_files(wanted, files, ("package_id", "path"))


def has_terrain(files: Column) -> Column:
    wanted = F.array(*[F.lit(f) for f in TERRAIN_FILES])
    return F.size(F.array_except(wanted, F.transform(files, lambda f: f["path"]))) == 0


def pack_kind() -> Column:
    return F.coalesce("kind", F.when(has_terrain(F.col("files")), "full").otherwise("stub"))


def manifest_violations(manifests: DataFrame, package: bool = False) -> DataFrame:
    """Rows (id, rule) for broken manifests.

    ``package`` selects the second family of manifests, which carries a digest
    and layers in place of slug, title and the navigation disclaimer.
    """
    bbox_ok = (F.size("bbox") == 4) & ~F.exists("bbox", lambda v: v.isNull() | F.isnan(v))
    blank = lambda name: F.coalesce(F.length(F.trim(name)), F.lit(0)) == 0
    tests: list[tuple[str, Column]] = [("id", blank("id")), ("bbox", ~F.coalesce(bbox_ok, F.lit(False)))]
    if package:
        tests += [
            ("sha256", ~F.coalesce(F.lower("sha256").rlike("^[a-f0-9]{64}$"), F.lit(False))),
            ("bytes", F.coalesce(F.col("bytes") < 0, F.lit(True))),
            ("layers", F.col("layers").isNull()),
            (
                "layer_fields",
                F.exists(
                    "layers",
                    lambda l: l["id"].isNull() | l["source"].isNull() | l["licence"].isNull() | l["data_as_of"].isNull(),
                ),
            ),
            ("texts", F.col("attributions").isNull() | F.col("warnings").isNull()),
        ]
    else:
        tests += [
            ("slug", blank("slug")),
            ("title", F.col("title").isNull()),
            ("bytes", F.coalesce(F.col("bytes") <= 0, F.lit(True))),
            ("bytes_cap", F.col("bytes") > MAX_PACK_BYTES),
            ("created_at", blank("created_at")),
            ("not_for_navigation", ~F.coalesce("not_for_navigation", F.lit(False))),
            ("kind", ~F.col("kind").isin("stub", "full")),
            ("full_files", (pack_kind() == "full") & ~has_terrain(F.col("files"))),
        ]
    tests += [
        ("files", F.coalesce(F.size("files") == 0, F.lit(not package))),
        (
            "file_fields",
            F.exists(
                "files",
                lambda f: (F.length(f["path"]) == 0)
                | f["path"].isNull()
                | f["bytes"].isNull()
                | (f["bytes"] < 0)
                | ~F.coalesce(F.lower(f["sha256"]).rlike("^[a-f0-9]{64}$"), F.lit(False)),
            ),
        ),
    ]
    failed = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in tests]))
    return manifests.select("id", F.explode(failed).alias("rule"))


def pack_status(installed: DataFrame, remote: DataFrame) -> DataFrame:
    """Per slug: terrain readiness, whether the remote pack is newer, and the box test."""
    far = remote.select("slug", F.col("id").alias("remote_id"), F.col("created_at").alias("remote_created_at"))
    newer = (F.col("remote_id") != F.col("id")) | (F.col("remote_created_at") > F.col("created_at"))
    corridor = F.array(*[F.lit(v) for v in CORRIDOR_BBOX])
    return installed.join(far, "slug", "left").select(
        "slug",
        "id",
        ((pack_kind() == "full") & has_terrain(F.col("files"))).alias("terrain_ready"),
        F.coalesce(newer, F.lit(False)).alias("update_available"),
        (F.col("bbox") == corridor).alias("is_corridor"),
    )


def register_snapshots(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Snapshot records with recomputed checksums; ``mismatch`` marks a wrong stated one."""
    have = files.select("path", "bytes", F.concat(F.lit("sha256:"), F.col("sha256")).alias("recomputed"))
    stated = F.nullif("checksum", F.lit(""))
    taken = F.when(F.contains("retrieved_at", F.lit("T")), F.col("retrieved_at")).otherwise(
        F.concat("retrieved_at", F.lit("T00:00:00Z"))
    )
    return raw.join(have, "path", "left").select(
        "id",
        "source_dataset_id",
        "url",
        taken.alias("retrieved_at"),
        F.col("recomputed").alias("checksum"),
        F.coalesce(F.nullif("media_type", F.lit("")), F.lit("application/json")).alias("media_type"),
        F.when(F.length("licence") > 0, "verified").otherwise("unknown").alias("licence_status"),
        F.col("path").alias("storage_path"),
        F.col("bytes").alias("byte_size"),
        F.coalesce("record_count", F.lit(0)).alias("record_count"),
        F.col("recomputed").isNull().alias("missing"),
        (stated.isNotNull() & (stated != F.col("recomputed"))).alias("mismatch"),
    )


def build_manifest(t: Tables, files: DataFrame, distributions: dict[str, int] | None = None) -> DataFrame:
    """One row that describes a build by its data alone, so equal inputs give equal rows.

    The digests of its files are rows beside it (:func:`file_checksums`), as
    their number follows the data.
    """
    counts = record_counts(t).where(F.col("table") != "total")
    canonical = counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("table", "records")))).alias("canonical_sources"))
    listed = files.agg(F.count(F.lit(1)).alias("n"))
    dated = data_as_of(t)
    pending = t["sources"].agg(F.coalesce(F.bool_or(F.col("verification_status") == "pending"), F.lit(False)).alias("p"))
    outputs = F.create_map(*[x for k, v in (distributions or {}).items() for x in (F.lit(k), F.lit(v))])
    return (
        canonical.withColumn("file_count", listed.scalar())
        .withColumn("data_as_of", dated.scalar())
        .withColumn("version", F.coalesce(F.date_format("data_as_of", "yyyy.MM.dd"), F.lit("0")))
        .withColumn("schema_version", F.lit("1.0"))
        .withColumn("distributions", outputs)
        .withColumn("pending_source", pending.scalar())
    )


def file_checksums(release: str, files: DataFrame) -> DataFrame:
    """The file digests of a build or release as rows."""
    return files.select(F.lit(release).alias("release_id"), "path", "sha256")


def snapshot_ids(release: str, snapshots: DataFrame) -> DataFrame:
    """The snapshots a release was made from as rows."""
    return snapshots.select(F.lit(release).alias("release_id"), F.col("id").alias("source_snapshot_id"))


def release_manifest(
    release: str, t: Tables, files: DataFrame, blockers: DataFrame, snapshots: DataFrame, created_at: Column | None = None
) -> DataFrame:
    """One row: record, file, snapshot and blocker counts of a release.

    File digests, snapshot ids and blockers are tables of the release
    (:func:`file_checksums`, :func:`snapshot_ids`, :func:`source_health`), as
    their number follows the data.
    """
    by_code = blockers.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))
    codes = by_code.agg(F.sort_array(F.collect_list(F.struct("code", "severity", "n"))).alias("b"))
    taken = snapshots.agg(F.count(F.lit(1)).alias("n"))
    stamp = F.current_timestamp() if created_at is None else created_at
    return (
        build_manifest(t, files)
        .select(
            F.lit(release).alias("release_id"),
            stamp.alias("created_at"),
            "data_as_of",
            F.col("canonical_sources").alias("record_counts"),
            "file_count",
        )
        .withColumn("snapshot_count", taken.scalar())
        .withColumn("blockers_by_code", F.coalesce(codes.scalar(), F.array().cast(codes.schema["b"].dataType)))
        .withColumn("publish_ready", ~F.exists("blockers_by_code", lambda b: b["severity"] == "blocker"))
    )


def source_health(release: str, blockers: DataFrame) -> DataFrame:
    """The blockers of a release as rows."""
    return blockers.select(F.lit(release).alias("release_id"), "code", "message", "severity")


def change_summary(
    release: str, previous: str | None, events: DataFrame, first_text: str = "The first release."
) -> DataFrame:
    """One row: how many changes of each kind a release brings."""
    kinds = events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    counts = kinds.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("changes"))
    text = first_text if previous is None else f"Changes since {previous}."
    return counts.select(
        F.lit(release).alias("release_id"), F.lit(previous).alias("previous_release_id"), "changes", F.lit(text).alias("summary")
    )


def package_manifests(files: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """One manifest (id, files, bytes, sha256) per ``package_id``; ``files`` counts its file rows.

    The files are the rows given, beside the manifest, so a package may have any
    number of them.
    """
    sums = files.groupBy(F.col("package_id").alias("id")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    made = sums.join(aggregate_digests(files).withColumnRenamed("package_id", "id"), "id")
    if places is None:
        return made
    stats = places.groupBy(F.col("package_id").alias("id")).agg(
        F.count_if("is_locality").alias("localities"), F.count_if(~F.col("is_locality")).alias("geography")
    )
    return made.join(stats, "id", "left").fillna(0, ["localities", "geography"])


def release_summary(manifests: DataFrame, open_release: str) -> DataFrame:
    """Ids, dates and blocker counts; the full manifest only for the open release."""
    blocking = F.filter("blockers_by_code", lambda b: b["severity"] == "blocker")
    count = F.aggregate(blocking, F.lit(0).cast("long"), lambda total, b: total + b["n"])
    return manifests.select(
        "release_id",
        "created_at",
        "data_as_of",
        "publish_ready",
        count.alias("blocker_count"),
        F.when(F.col("release_id") == open_release, F.struct(*[F.col(c) for c in manifests.columns])).alias("manifest"),
    )
