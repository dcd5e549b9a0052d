"""A corpus pipeline over ``documents``: each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessgraph.llm.common import stored, table
from accessgraph.llm.decontamination import without_leaks
from accessgraph.llm.importance import resample
from accessgraph.llm.near_dup import without_near_duplicates
from accessgraph.llm.packing import pack
from accessgraph.llm.secret_scan import scan

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones selects."""
    return resample(docs, table(spark, sf_dir, "labels")).select(*DOCUMENT)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates."""
    return without_near_duplicates(docs).select(*DOCUMENT)


def keep_untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; their secrets are replaced in the text, and ``n_chars`` follows."""
    scanned = scan(docs, redact=True)
    changed = F.col("spans") != ""
    text = F.when(changed, F.col("redacted")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars"))
    return scanned.withColumns({"text": text, "n_chars": n_chars}).select(*DOCUMENT)


def fill_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("minhash near-dedup", keep_one_of_each),
    ("benchmark decontamination", keep_untested),
    ("secret scans", hide_secrets),
    ("best-fit packing", fill_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage before it is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
