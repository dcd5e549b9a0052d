"""Quality classifier by importance resampling over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessgraph.llm import textbytes as tb
from accessgraph.llm.common import discard, fresh, query, stored, table

BUCKETS = 10_000
LABEL_SAMPLE = 20_000
ADDED = ("log_weight", "sampling_key")


def _features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every token and every pair of neighbouring tokens."""
    doc, hashes = tb.tokens(data, offsets)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    both = tb.mix(hashes[pair] * np.uint64(31) + hashes[pair + 1])
    size = np.uint64(buckets)
    return np.concatenate([doc, doc[pair]]), np.concatenate([hashes % size, both % size]).astype(np.int64)


def fit_log_ratios(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, label_sample: int = LABEL_SAMPLE
) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw) for every hash bucket.

    The raw model counts all documents. The target model counts the documents
    of at most ``label_sample`` ids whose every label says quality 1, chosen by
    a hash of the id; that bound is the only sample. Both are smoothed by one
    count per bucket. Without any such label the ratios are zero.
    """
    good = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .where("quality = 1")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(label_sample)
    )
    target_ids = np.sort(np.array([r[0] for r in good.select("doc_id").collect()], np.int64))
    if not len(target_ids):
        return np.zeros(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            known = np.asarray(batch.column(0).is_valid())
            found = np.isin(ids, target_ids) & known
            for first, end, data, offsets in tb.slices(batch.column(1)):
                doc, bucket = _features(data, offsets, buckets)
                counts[0] += np.bincount(bucket, minlength=buckets)
                counts[1] += np.bincount(bucket[found[first:end][doc]], minlength=buckets)
        side, bucket = np.nonzero(counts)
        yield pa.record_batch(
            [pa.array(side.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[side, bucket])],
            ["side", "bucket", "n"],
        )

    rows = (
        docs.select("doc_id", "text")
        .mapInArrow(count, "side int, bucket int, n long")
        .groupBy("side", "bucket")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    counts = np.ones((2, buckets))
    for side, bucket, n in rows:
        counts[side, bucket] += n
    logs = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    return logs[1] - logs[0]


def with_importance(docs: DataFrame, ratios: np.ndarray, seed: int = 0, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with the log importance weight and its Gumbel key.

    ``log_weight`` sums the log ratios of a document's n-grams, 0 for an empty
    or null text. ``sampling_key`` adds Gumbel noise drawn from a hash of seed,
    id and text, so the k largest keys are a sample without replacement in
    proportion to the weights, and a repeated row gets the same key.
    """
    buckets = len(ratios)
    columns = [c for c in (columns or docs.columns) if c not in ADDED]
    pruned = docs.select(*columns, F.col("doc_id").alias(fresh(docs, "_id")), F.col("text").alias(fresh(docs, "_text")))
    kept = len(columns)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(kept).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.uint64)
            weight, noise = np.zeros(len(ids)), np.zeros(len(ids))
            for first, end, data, offsets in tb.slices(batch.column(kept + 1)):
                doc, bucket = _features(data, offsets, buckets)
                weight[first:end] = np.bincount(doc, weights=ratios[bucket], minlength=end - first)
                text = tb.run_hashes(data, offsets[:-1], offsets[1:])
                mixed = tb.mix(text + tb.mix(ids[first:end] + np.uint64(seed)))
                uniform = ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
                noise[first:end] = -np.log(-np.log(uniform))
            weight = np.round(weight, 6)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], pa.array(weight), pa.array(weight + noise)], [*columns, *ADDED]
            )

    schema = docs.select(*columns).withColumns({c: F.lit(0.0) for c in ADDED}).schema
    return pruned.mapInArrow(score, schema)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value, found by counting ever narrower ranges.

    Each round brings ``bins`` counts to the driver. None without rows; the
    smallest value if there are fewer than ``k``.
    """
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k < 1:
        return None
    if k >= n:
        return low
    inside, rest = df, k
    while low < high:
        width = (high - low) / bins
        slot = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        rows = sorted(
            inside.groupBy(slot.alias("slot"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
            .collect(),
            reverse=True,
        )
        for _, count, least, most in rows:
            if rest <= count:
                low, high = least, most
                break
            rest -= count
        inside = df.where((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)))
    return low


def resample(
    docs: DataFrame,
    labels: DataFrame,
    k: int | None = None,
    seed: int = 0,
    buckets: int = BUCKETS,
    label_sample: int = LABEL_SAMPLE,
    columns: list[str] | None = None,
) -> DataFrame:
    """The ``k`` documents sampled by importance, with ``log_weight`` and ``sampling_key``.

    ``k`` defaults to the share of good documents among all labelled ones times
    the number of documents; without target labels every document stays.
    Documents tied at the k-th key stay together, so repeated rows are all kept
    or all dropped. Empty and null texts have weight 0. Columns named like the
    two added ones are replaced.
    """
    ratios = fit_log_ratios(docs, labels, buckets, label_sample)
    scored = with_importance(docs, ratios, seed, columns)
    if not ratios.any() and k is None:
        return scored
    keys = stored(with_importance(docs, ratios, seed, ["doc_id"]), "importance")
    if k is None:
        per_doc = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
        share = per_doc.agg(F.avg((F.col("quality") == 1).cast("int"))).first()[0]
        k = round(share * keys.count())
    cut = kth_largest(keys, "sampling_key", k)
    if columns == ["doc_id"]:
        scored = keys
    else:
        discard(keys)
    return scored.where(F.col("sampling_key") >= F.lit(cut) if cut is not None else F.lit(False))


@query("op5_quality_classifier")
def op5(spark, sf):
    """Documents that the classifier keeps, with their importance."""
    return resample(table(spark, sf, "documents"), table(spark, sf, "labels"), columns=["doc_id"])
