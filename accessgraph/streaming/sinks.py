"""Running a stream over the data at hand into a table."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from accessgraph.session import durable_dir

BATCH = "batch_id"


def write_batches(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "append",
    each: Callable[[DataFrame], DataFrame] = lambda batch: batch,
):
    """Start a stream that writes ``each`` micro-batch to its own folder.

    A batch that is replayed after a failure overwrites its folder, so every
    row counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def drain(
    stream: DataFrame, mode: str = "append", each: Callable[[DataFrame], DataFrame] = lambda batch: batch
) -> DataFrame:
    """Process all available data and return what was written, with its ``batch_id``."""
    spark = stream.sparkSession
    folder = f"{durable_dir(spark)}/stream-{uuid4().hex}"
    run = write_batches(stream, f"{folder}/out", f"{folder}/state", mode, each)
    run.awaitTermination()
    schema = each(spark.createDataFrame([], stream.schema)).schema.add(BATCH, "long")
    return spark.read.schema(schema).parquet(f"{folder}/out")


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder or glob as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
