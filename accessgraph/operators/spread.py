"""Joins whose result is far larger than both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parts that the rows of one key are dealt over.
PARTS = 64


def spread_join(many: DataFrame, few: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every row of ``many`` with every row of ``few`` that has its keys, for few keys with many rows.

    The rows of a key are dealt over parts and ``few`` goes to each part, so what
    is shuffled grows with the two sides and not with their pairs, and tasks get
    equal shares of a crowded key. Tasks are not merged by the size of what they
    read, which says nothing about what they return. The result should not be
    shuffled again.
    """
    keys, tasks = [*on, "_part"], int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = many.withColumn("_part", F.pmod(F.xxhash64(*many.columns), F.lit(PARTS)).cast("int"))
    given = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.repartition(tasks, *keys).join(given.repartition(tasks, *keys).hint("merge"), keys).drop("_part")
