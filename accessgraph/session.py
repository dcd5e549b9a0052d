"""Session construction and durable lineage cuts."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
TIDY_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "accessgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC clocks; other settings come from the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Merging sessions on the map side keeps a long trip from travelling whole.
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def durable_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``. Only a ``local`` master
    may fall back to a folder of this machine.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def written(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write ``df`` as a table of the durable folder and continue from it.

    For an input that a plan reads several times: the plan stays small, each
    reader takes only its columns, and lost executors lose nothing. With
    ``tidy`` what was shuffled to write it is dropped at once, not when the
    driver happens to collect its garbage; for rounds that shuffle much.
    """
    spark = df.sparkSession
    path = f"{durable_dir(spark)}/table-{uuid4().hex}"
    before = spark.conf.get(TIDY_KEY, "false")
    if tidy:
        spark.conf.set(TIDY_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.set(TIDY_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the durable folder and continue from the written copy."""
    durable_dir(df.sparkSession)
    return df.checkpoint(eager=True)
