"""Comparison of two releases of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_releases(
    before: DataFrame, after: DataFrame, key: str = "id", columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows (key, kind): added, modified or removed, one shuffle per side."""
    compared = list(columns or [c for c in after.columns if c != key])
    old = before.select(key, F.struct(*compared).alias("_old"))
    new = after.select(key, F.struct(*compared).alias("_new"))
    kind = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    )
    changed = F.filter(
        F.array(
            *[
                F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c))
                for c in compared
            ]
        ),
        lambda c: c.isNotNull(),
    )
    return (
        old.join(new, key, "full")
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(key, "kind", F.when(F.col("kind") == "modified", changed).alias("changed_fields"))
    )


def diff_identity(
    before: DataFrame, after: DataFrame, stable: str = "decision_ref", record: str = "record_id"
) -> DataFrame:
    """Rows (stable ref, kind): ``remapped`` when a stable reference moved to another record id,
    ``conflicted`` when several rows of the new release claim one record id."""
    old = before.where(F.col(stable).isNotNull()).groupBy(stable).agg(F.max(record).alias("old_record_id"))
    new = after.where(F.col(stable).isNotNull()).groupBy(stable).agg(F.max(record).alias("new_record_id"))
    moved = (
        old.join(new, stable)
        .where(F.col("old_record_id") != F.col("new_record_id"))
        .select(
            F.col(stable).alias("reference"), F.lit("remapped").alias("kind"), "old_record_id", F.col("new_record_id")
        )
    )
    clashes = (
        after.groupBy(record)
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(
            F.col(record).alias("reference"),
            F.lit("conflicted").alias("kind"),
            F.lit(None).cast("string").alias("old_record_id"),
            F.col(record).alias("new_record_id"),
        )
    )
    return moved.unionByName(clashes)


def change_events(diff: DataFrame, entity_type: str, release: str, observed_at: str, key: str = "id") -> DataFrame:
    """Diff rows in the shape of change events; ids follow from the content, so reruns match."""
    text = F.concat_ws(" ", F.lit(entity_type), F.col(key), F.col("kind"))
    return diff.select(
        F.concat(F.lit("chg_"), F.sha2(F.concat_ws("|", F.lit(release), text), 256)).alias("id"),
        F.lit(None).cast("string").alias("import_run_id"),
        F.lit(release).alias("release_id"),
        "kind",
        F.lit(entity_type).alias("entity_type"),
        F.col(key).alias("entity_id"),
        F.lit(None).cast("string").alias("upstream_record_id"),
        text.alias("summary"),
        F.lit(observed_at).cast("date").alias("observed_at"),
    )
