"""Chat formatting of logged conversations after collapsing cumulative snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accessgraph.llm.common import query, stored, table
from accessgraph.operators.windows import numbered

TURN_FORM = "<|im_start|>{role}\n{text}<|im_end|>\n"
CHUNK = 4096
CROWDED = 4 * CHUNK


def _content_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))


def with_positions(turns: DataFrame, *carried: str) -> DataFrame:
    """Number the turns of each conversation from 1, by turn, role and then content.

    ``_conv`` stands for the conversation id, null ids included. A conversation
    is numbered in chunks of turn numbers. Where turn numbers restart, as among
    all rows without id, such a chunk may hold any number of rows: one of more
    than ``CROWDED`` is split by turn and role, and those by even ranges of the
    content hash, about ``CHUNK`` rows each; only equal rows stay together.
    """
    conv = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    block = F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62)))
    keyed = turns.withColumns({"_conv": conv, "_block": block, "_a": _content_hash(1), "_b": _content_hash(2)})
    narrow = keyed.select("conv_id", "turn", "role", *carried, "_conv", "_block", "_a", "_b")
    group = ["_conv", "_block"]
    crowded = narrow.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWDED).drop("_n")
    ranges = (
        narrow.join(crowded, group, "left_semi")
        .groupBy(
            F.col("_conv").alias("_of"), F.col("_block").alias("_in"), F.col("turn").alias("_turn"), F.col("role").alias("_role")
        )
        .agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_ranges"))
    )
    alike = F.col("turn").eqNullSafe(F.col("_turn")) & F.col("role").eqNullSafe(F.col("_role"))
    split = narrow.join(ranges, (F.col("_conv") == F.col("_of")) & (F.col("_block") == F.col("_in")) & alike, "left")
    # The hash as a fraction of its range; signed hashes and fractions have one order.
    place = F.floor((F.col("_a") / F.lit(2.0**64) + 0.5) * F.col("_ranges"))
    chunk = F.struct("_block", "_turn", "_role", place.alias("place"))
    rows = numbered(split, ["_conv"], ["turn", "role", "_a", "_b"], chunk, "position")
    return rows.drop("_block", "_of", "_in", "_turn", "_role", "_ranges")


def prefix_hashes(positioned: DataFrame) -> DataFrame:
    """(conv_id, _conv, position, a, b): two rolling 64-bit hashes of the turns up to each one.

    A turn's hash covers its position, role and text, so the exclusive or over
    the turns so far identifies that prefix; chunks of a long conversation carry
    one row each.
    """
    part = F.floor((F.col("position") - 1) / CHUNK)
    rows = positioned.select(
        "conv_id",
        "_conv",
        "position",
        part.alias("_part"),
        F.xxhash64("position", "_a").alias("_a"),
        F.xxhash64("position", "_b").alias("_b"),
    )
    inside = Window.partitionBy("_conv", "_part").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_conv", "_part").agg(F.bit_xor("_a").alias("_a"), F.bit_xor("_b").alias("_b"))
    carry = sums.select(
        "_conv", "_part", F.bit_xor("_a").over(before).alias("_ca"), F.bit_xor("_b").over(before).alias("_cb")
    ).where("_part > 0")
    rolled = rows.withColumns({"_a": F.bit_xor("_a").over(inside), "_b": F.bit_xor("_b").over(inside)})
    whole = rolled.join(carry, ["_conv", "_part"], "left")
    return whole.select(
        "conv_id",
        "_conv",
        "position",
        F.col("_a").bitwiseXOR(F.coalesce("_ca", F.lit(0))).alias("a"),
        F.col("_b").bitwiseXOR(F.coalesce("_cb", F.lit(0))).alias("b"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(_conv, n_turns) of conversations that no longer one begins with; of equal ones the least id.

    Prefixes are counted before they are shuffled, so a first turn that most
    conversations share is one row. A conversation is dropped by an anti-join if
    more conversations have its hash at its length than end there.
    """
    prefixes = stored(prefix_hashes(with_positions(turns)), "prefixes")
    last = prefixes.groupBy("_conv").agg(F.max_by(F.struct("conv_id", "position", "a", "b"), "position").alias("last"))
    identity = F.struct(F.col("last.conv_id").isNull().alias("none"), F.col("last.conv_id"), "_conv")
    ends = last.groupBy(F.col("last.position").alias("n_turns"), F.col("last.a").alias("a"), F.col("last.b").alias("b")).agg(
        F.min(identity).alias("first"), F.count(F.lit(1)).alias("ending")
    )
    passing = prefixes.groupBy("position", "a", "b").agg(F.count(F.lit(1)).alias("passing"))
    longer = (
        (ends["n_turns"] == passing["position"])
        & (ends["a"] == passing["a"])
        & (ends["b"] == passing["b"])
        & (passing["passing"] > ends["ending"])
    )
    return ends.join(passing, longer, "left_anti").select(F.col("first._conv").alias("_conv"), "n_turns")


def render(turns: DataFrame, form: str = TURN_FORM) -> DataFrame:
    """(conv_id, position, n_turns, rendered) of every turn of the maximal conversations.

    ``rendered`` fills ``form``; the rows of a conversation in order of position
    are its training text, whatever its length. Turns are ordered by turn
    (nulls first), role and content; repeated rows are repeated turns. Null
    roles and texts are empty; rows without conversation id form one
    conversation. Other columns are ignored.
    """
    kept = maximal_conversations(turns)
    names = {"{role}": F.coalesce("role", F.lit("")), "{text}": F.coalesce("text", F.lit(""))}
    rendered = F.concat(*[names.get(part, F.lit(part)) for part in re.split(r"(\{role\}|\{text\})", form)])
    return (
        with_positions(turns, "text")
        .join(kept, "_conv")
        .select("conv_id", "position", "n_turns", rendered.alias("rendered"))
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS position
  FROM conversations
), r AS (
  SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered FROM t
), c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(rendered, '' ORDER BY position) AS whole FROM r GROUP BY conv_id
), kept AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c AS d WHERE (d.n_turns > c.n_turns AND starts_with(d.whole, c.whole))
      OR (d.whole = c.whole AND d.conv_id < c.conv_id))
)
SELECT r.conv_id, r.position, kept.n_turns, r.rendered FROM r JOIN kept ON r.conv_id IS NOT DISTINCT FROM kept.conv_id
"""


@query("op2_chat_formatting", SQL)
def op2(spark, sf):
    """Every maximal conversation, rendered turn by turn."""
    return render(table(spark, sf, "conversations"))
