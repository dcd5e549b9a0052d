"""Token counts of documents in flat token files that have no index.

A flat file holds nothing but ids of one width, each document followed by an
end-of-document id. Tasks read byte ranges through ``pyarrow.fs``, so a file of
any size is scanned in parallel and a file system that pyarrow reaches (local,
HDFS, object stores) is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accessgraph.llm.bpe import default_tokenizer, encoder
from accessgraph.llm.common import query, shared_path, stored, table

END_ID = 50256
DTYPE = "<u2"
BLOCK_TOKENS = 1 << 20
SCAN_GROUP = 1 << 10
MOST_TASKS = 1 << 15


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Hadoop or plain path."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, dtype: str = DTYPE
) -> DataFrame:
    """Write every document's ids and ``end_id``, one flat file per task; returns (file, ordinal, doc_id).

    Null and empty texts are ``end_id`` alone; special-token strings in a text
    are ordinary text, so ``end_id`` only ends documents. An id that ``dtype``
    cannot hold is an error, never cut. A task writes under
    a name of its attempt and renames at the end, so a lost or repeated attempt
    leaves one whole file. The returned table is written already.
    """
    source = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = encoder(source, special=False).encode, TaskContext.get()
        name = f"part-{context.partitionId():06d}.bin"
        system, folder = _open(path)
        system.create_dir(folder, recursive=True)
        draft = f"{folder}/_draft-{context.taskAttemptId()}"
        ordinal = 0
        with system.open_output_stream(draft) as out:
            for batch in batches:
                for text in batch.column(1):
                    ids = np.append(encode(text.as_py()), end_id).astype(np.int64)
                    if ids.max() > np.iinfo(dtype).max:
                        raise ValueError(f"id {ids.max()} does not fit into {dtype}")
                    out.write(ids.astype(dtype).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0)],
                    ["file", "ordinal", "doc_id"],
                )
                ordinal += n
        if ordinal:
            system.move(draft, f"{folder}/{name}")
        else:
            system.delete_file(draft)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    manifest = narrow.mapInArrow(write, "file string, ordinal long, doc_id long")
    return stored(manifest, "manifest")


def document_lengths(
    spark: SparkSession, path: str, end_id: int = END_ID, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """(path, ordinal, start, n_tokens, ended) of every document in the files below ``path``.

    Every block of ``block_tokens`` ids is searched on its own. A document that
    began in an earlier block needs that block's last end id, and its number
    needs the count of all earlier end ids: both come from a prefix scan over
    one small row per block, in two levels, so a single huge file is no single
    task. ``n_tokens`` leaves the end id out; ``start`` counts ids from the
    file's beginning. Ids after the last end id are a last document that has
    not ``ended``. An empty file has none; bytes that do not fill an id are
    ignored.
    """
    width = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", "length")
    files = files.withColumn("ids", F.floor(F.col("length") / width))
    blocks = files.where("ids > 0").select(
        "path", F.explode(F.sequence(F.lit(0), F.floor((F.col("ids") - 1) / block_tokens).cast("int"))).alias("block")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first = block * block_tokens
                system, name = _open(file)
                with system.open_input_file(name) as source:
                    data = source.read_at(block_tokens * width, first * width)
                ids = np.frombuffer(data, dtype, len(data) // width)
                ends = np.flatnonzero(ids == end_id) + first
                n = len(ends)
                before = np.r_[-1, ends[:-1]] if n else ends
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file] * n, pa.string()),
                        pa.array(np.full(n, block, np.int32)),
                        pa.array(np.arange(n)),
                        pa.array(before, pa.int64(), mask=np.arange(n) == 0),
                        pa.array(ends, pa.int64()),
                    ],
                    ["path", "block", "rank", "before", "end"],
                )

    # By the size of these small rows alone all blocks would be one task's.
    spread = blocks.repartition(min(MOST_TASKS, max(1, blocks.count())))
    ends = stored(spread.mapInArrow(search, "path string, block int, rank long, before long, end long"), "ends")

    group = F.floor(F.col("block") / SCAN_GROUP)
    sums = ends.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("last"))
    sums = sums.withColumn("group", group)
    earlier = Window.partitionBy("path", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("path", "group").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    above = Window.partitionBy("path").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        "path", "group", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"), F.max("last").over(above).alias("last0")
    )
    carried = (
        sums.withColumns({"n1": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "last1": F.max("last").over(earlier)})
        .join(groups, ["path", "group"])
        .select("path", "block", (F.col("n0") + F.col("n1")).alias("carry"), F.greatest("last0", "last1").alias("carried"))
    )
    start = F.coalesce("before", "carried", F.lit(-1)) + 1
    whole = ends.join(carried, ["path", "block"]).select(
        "path",
        (F.col("carry") + F.col("rank")).alias("ordinal"),
        start.alias("start"),
        (F.col("end") - start).alias("n_tokens"),
        F.lit(True).alias("ended"),
    )
    totals = ends.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("last"))
    rest = files.join(totals, "path", "left").withColumn("begin", F.coalesce("last", F.lit(-1)) + 1)
    tail = rest.where("begin < ids").select(
        "path",
        F.coalesce("n", F.lit(0)).alias("ordinal"),
        F.col("begin").alias("start"),
        (F.col("ids") - F.col("begin")).alias("n_tokens"),
        F.lit(False).alias("ended"),
    )
    return whole.unionByName(tail)


@query("op1_token_counts")
def op1(spark, sf):
    """Tokens of every document, counted in flat token files."""
    path = shared_path(spark, "tokens")
    manifest = write_token_files(table(spark, sf, "documents"), path)
    lengths = document_lengths(spark, path).withColumn("file", F.element_at(F.split("path", "/"), -1))
    return manifest.join(lengths, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "start")
