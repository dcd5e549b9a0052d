import hashlib
import os
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from accessgraph.operators import integrity
from accessgraph.schemas import TABLES
from accessgraph.sources import files, records, sinks


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        file.write(text)


def test_records(spark, folder):
    write(f"{folder}/places.ndjson", '{"id":"a","status":"active","created_at":"2000-01-01"}\n\n{"id":"b"\n')
    rows, bad = records.read_records_strict(spark, f"{folder}/places.ndjson", TABLES["places"])
    assert [r["id"] for r in rows.collect()] == ["a"]
    assert "places.ndjson" in bad.first()["message"] and bad.count() == 1
    assert records.read_records(spark, f"{folder}/none.ndjson", TABLES["places"]).count() == 0
    assert records.load_tables(spark, folder, views=True)["connections"].count() == 0
    assert spark.table("places").where("id = 'a'").count() == 1


def test_line_numbers_over_many_splits(spark, folder):
    lines = ["" if i % 7 == 3 else "{broken" if i % 11 == 5 else f'{{"id":"p{i}","status":"active"}}' for i in range(1, 3001)]
    write(f"{folder}/in/a.ndjson", "\n".join(lines))
    write(f"{folder}/in/b.ndjson", "\r\n".join(reversed(lines)) + "\r\n")
    write(f"{folder}/in/empty.ndjson", "")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows, bad = records.read_records_strict(spark, f"{folder}/in", TABLES["places"])
        assert rows.rdd.getNumPartitions() > 10
        got = sorted((r["table"], r["line"], r["message"]) for r in bad.collect())
        n_rows = rows.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    expected = [
        (name, i, f"{name}:{i}: invalid JSON: {{broken")
        for name, text in (("a.ndjson", lines), ("b.ndjson", lines[::-1]))
        for i, line in enumerate(text, 1)
        if line == "{broken"
    ]
    assert got == sorted(expected)
    assert n_rows == 2 * sum(line.startswith('{"') for line in lines)


def test_release_is_immutable_and_pointer_moves(spark, folder):
    one, two = (spark.range(n).withColumnRenamed("id", "k") for n in (1, 2))
    records.publish_release({"t": one}, folder, "2000.01.01.1")
    records.publish_release({"t": two}, folder, "2000.01.01.2")
    assert records.open_release(spark, folder)["t"].count() == 2
    assert records.open_release(spark, folder, "2000.01.01.1")["t"].count() == 1
    with pytest.raises(AnalysisException):
        records.publish_release({"t": two}, folder, "2000.01.01.1")


def test_files_snapshots_and_digest(spark, folder):
    write(f"{folder}/src/2026-01-01/manifest.json", '{"id":"snp_a",\n"licence_status":"verified"}')
    write(f"{folder}/src/2026-02-01/manifest.json", '{"id":"other"}')
    write(f"{folder}/b.txt", "b")
    write(f"{folder}/a.txt", "aa")
    got = files.snapshot_manifests(spark, folder).collect()
    assert [(r["id"], r["source"], r["snapshot_date"]) for r in got] == [("snp_a", "src", "2026-01-01")]
    scanned = files.scan_files(spark, f"{folder}/*.txt", folder)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(tuple(r) for r in scanned.collect()) == [("a.txt", 2, digest("aa")), ("b.txt", 1, digest("b"))]
    made = integrity.package_manifests(scanned.withColumn("package_id", F.lit("p"))).first()
    lines = f"a.txt:{digest('aa')}\nb.txt:{digest('b')}\n"
    assert made["sha256"] == digest(lines) and made["bytes"] == 3
    checked = integrity.verify_files(scanned.withColumn("sha256", F.lit("x")), scanned).collect()
    assert {r["status"] for r in checked} == {"checksum_mismatch"}


def test_latest_snapshot_prefers_payload_then_date(spark):
    rows = [("s", "2026-01-01", "full.json"), ("s", "2026-03-01", "seed.json"), ("s", "2026-02-01", "full.json"), ("o", "2026-01-01", "seed.json")]
    got = files.latest_snapshot(spark.createDataFrame(rows, "source string, snapshot_date string, name string"), ("full.json", "seed.json"))
    assert sorted(tuple(r) for r in got.collect()) == [("o", "2026-01-01", "seed.json"), ("s", "2026-02-01", "full.json")]


def test_ordered_text(spark, folder):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k")).withColumn("text", F.col("k").cast("string"))
    sinks.write_ordered_text(df, f"{folder}/out", ["k"])
    names = sorted(n for n in os.listdir(f"{folder}/out") if n.startswith("part"))
    lines = [line for n in names for line in open(f"{folder}/out/{n}").read().split()]
    assert lines == [str(i) for i in range(500)]


def test_package_digests_of_any_number_of_files(spark):
    rows = spark.range(150_000).select(
        F.when(F.col("id") % 50 == 0, F.concat(F.lit("small"), F.col("id") % 7)).when(F.col("id") % 50 < 49, "large").alias("package_id"),
        F.concat(F.lit("é/"), F.col("id") * 7919 % 150_000).alias("path"),
        F.col("id").alias("bytes"),
        F.when(F.col("id") % 1000 != 3, F.sha2(F.col("id").cast("string"), 256)).alias("sha256"),
    )
    lines = {}
    for r in rows.collect():
        lines.setdefault(r["package_id"], []).append((r["path"], r["sha256"]))
    text = lambda pairs: "".join(f"{p}:{d}\n" for p, d in sorted(x for x in pairs if x[1]))
    want = {k: hashlib.sha256(text(v).encode()).hexdigest() for k, v in lines.items()}
    assert len(want) == 9 and None in want
    spread = rows.repartition(6)
    assert {r["package_id"]: r["sha256"] for r in integrity.aggregate_digests(spread, block_bytes=300).collect()} == want
    made = {r["id"]: (r["files"], r["sha256"]) for r in integrity.package_manifests(spread.where("package_id IS NOT NULL")).collect()}
    assert made == {k: (len(lines[k]), v) for k, v in want.items() if k}
    stated = spark.createDataFrame([("large", want["large"].upper()), ("none", hashlib.sha256(b"").hexdigest()), ("small1", "0")], "id string, sha256 string")
    checked = {r["id"]: r["digest_ok"] for r in integrity.verify_aggregate(stated, spread).collect()}
    assert checked == {"large": True, "none": True, "small1": False}
    assert integrity.aggregate_digests(rows.limit(0)).count() == 0


def test_packed_ndjson_is_small_files_and_reads_back(spark, folder):
    """Every row is written; a reader gets many small packed files instead of one that it cannot split."""
    rows = spark.range(0, 5000, 1, 1).selectExpr("id", "concat('plc_', id) name", "repeat('x', 200) filler")
    sinks.write_ndjson(rows, f"{folder}/plain")
    sinks.write_ndjson(rows, f"{folder}/packed", compression="gzip", lines_per_file=1000)
    size = lambda kind: [f.stat().st_size for f in Path(f"{folder}/{kind}").glob("part-*")]
    assert len(size("packed")) == 5 and sum(size("packed")) * 5 < sum(size("plain"))
    back = records.read_records(spark, f"{folder}/packed", rows.schema)
    assert back.exceptAll(rows).isEmpty() and back.count() == 5000
