"""Near-equal embeddings by small-world graphs per shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accessgraph.llm.common import query, stored, table
from accessgraph.llm.components import components, roots_of
from accessgraph.llm.small_world import BLOCK, SmallWorld

THRESHOLD = 0.93
SHARD = 4096
BEAM = 64
AUDIT_QUERIES = 64
AUDIT_RECALL = 0.99
# Links are nearer, thus easier to find, than the nearest vector of a query without links.
AUDIT_NEAREST = 0.95
# Similarities of the 32-bit search are this close to the double ones.
SLACK = 1e-4


def _usable(vectors: pa.Array, labels: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(usable, flat components, row starts): labelled vectors with finite components and a positive finite norm."""
    n = len(vectors)
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    flat = vectors.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), sizes)
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.bincount(row, flat * flat, n)
    return np.isfinite(norm) & (norm > 0) & np.asarray(labels.is_valid()), flat, starts


def keyed_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, dim, key, vector): the key tells different (label, vector) apart, null for unusable rows."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, flat, starts = _usable(batch.column(2), batch.column(1))
            keys, data = [None] * batch.num_rows, [None] * batch.num_rows
            for i in np.flatnonzero(usable):
                data[i] = (flat[starts[i] : starts[i + 1]] + 0.0).tobytes()
                keys[i] = hashlib.md5(repr(batch.column(1)[int(i)].as_py()).encode() + b"|" + data[i]).digest()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(starts)), pa.array(keys, pa.binary()), pa.array(data, pa.binary())],
                ["vec_id", "label", "dim", "key", "vector"],
            )

    narrow = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    schema = T.StructType([*narrow.schema.fields[:2], T.StructField("dim", T.LongType())])
    return narrow.mapInArrow(make, schema.add("key", "binary").add("vector", "binary"))


def shard_graphs(nodes: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per shard of about ``shard`` vectors of one label: its keys, copies, vectors and graph."""
    sizes = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("label", "dim", F.ceil(F.col("n") / F.lit(shard)).alias("shards"))
    placed = nodes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")))
    schema = placed.select("label", "dim", "shard", "shards").schema
    for name, kind in (("keys", "array<binary>"), ("copies", "array<bigint>"), ("vectors", "binary"), ("graph", "binary")):
        schema = schema.add(name, T.DataType.fromDDL(kind))

    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by("key").combine_chunks()
        data = b"".join(part["vector"].to_pylist())
        vectors = np.frombuffer(data).reshape(part.num_rows, -1)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        draws = np.array([int.from_bytes(k.as_py()[:6], "big") + 1 for k in part["key"]]) / float(1 << 48)
        graph = SmallWorld(unit, draws).save()
        head = part.slice(0, 1).select(["label", "dim", "shard", "shards"])
        for name, value in (
            ("keys", pa.array([part["key"].to_pylist()], pa.list_(pa.binary()))),
            ("copies", pa.array([part["copies"].to_pylist()], pa.list_(pa.int64()))),
            ("vectors", pa.array([data], pa.binary())),
            ("graph", pa.array([graph], pa.binary())),
        ):
            head = head.append_column(name, value)
        return head

    return placed.groupBy("label", "dim", "shard").applyInArrow(build, schema)


def _own_left_out(sims: np.ndarray, ids: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    return sims if own is None else np.where(ids == own[:, None], -np.inf, sims)


def audited_beam(queries: np.ndarray, vectors: np.ndarray, graph: SmallWorld, own: np.ndarray | None, base: int = BEAM) -> int:
    """The least beam, from ``base`` by doubling, that finds the nearest vectors of a sample of the queries.

    ``AUDIT_QUERIES`` queries are compared with all vectors. Whether any of
    them has a link does not matter: the most similar vector of each must be in
    its beam for a share of ``AUDIT_NEAREST``, so a poor graph fails also where
    links are rare. ``own`` holds the queries' places among the vectors, if
    they are vectors of the same shard. The shard's size means no graph.
    """
    n = len(vectors)
    audit = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT_QUERIES, len(queries))).astype(np.int64))
    mine = None if own is None else own[audit]
    true = queries[audit] @ vectors.T
    nearest = _own_left_out(true, np.arange(n)[None], mine).max(axis=1)
    while base < n:
        ids, sims = graph.search(queries[audit].astype(np.float32), base)
        if (_own_left_out(sims, ids, mine).max(axis=1) >= nearest - SLACK).mean() >= AUDIT_NEAREST:
            return base
        base *= 2
    return n


def _found(queries: np.ndarray, vectors: np.ndarray, graph: SmallWorld, base: int, threshold: float) -> np.ndarray:
    """Matrix of the links in the queries' beams, which widen while everything in them is similar enough."""
    n, single = len(vectors), queries.astype(np.float32)
    found = np.zeros((len(queries), n), bool)
    pending, beam = np.arange(len(queries)), base
    while len(pending):
        wider = []
        for at in range(0, len(pending), BLOCK):
            rows = pending[at : at + BLOCK]
            ids, sims = graph.search(single[rows], min(beam, n))
            r, c = np.nonzero(sims >= threshold - SLACK)
            a, b = rows[r], ids[r, c]
            good = np.einsum("ij,ij->i", queries[a], vectors[b]) >= threshold
            found[a[good], b[good]] = True
            wider.append(rows[(sims >= threshold - SLACK).all(axis=1)])
        pending = np.concatenate(wider) if beam < n else np.zeros(0, np.int64)
        beam *= 4
    return found


def links_between(left: np.ndarray, right: np.ndarray, graphs: tuple[SmallWorld, SmallWorld], same: bool, threshold: float) -> np.ndarray:
    """Matrix of the links found between unit vectors of two shards, verified in doubles.

    Each side's vectors search the other side's graph (``graphs`` holds left's
    and right's; within a shard they are the same one), from the beam that
    :func:`audited_beam` sets. Then the links of ``AUDIT_QUERIES`` vectors are
    compared with all true ones; until ``AUDIT_RECALL`` of them were found the
    search starts over with beams twice as wide, and compares everything once
    a beam is the shard.
    """
    own = np.arange(len(left)) if same else None
    sides = [(left, right, graphs[1])] if same else [(left, right, graphs[1]), (right, left, graphs[0])]
    beams = [audited_beam(*side, own) for side in sides]
    audit = np.unique(np.linspace(0, len(left) - 1, min(AUDIT_QUERIES, len(left))).astype(np.int64))
    true = left[audit] @ right.T >= threshold
    if same:
        true[np.arange(len(audit)), audit] = False
    while all(beam < len(side[1]) for beam, side in zip(beams, sides, strict=True)):
        found = _found(*sides[0], beams[0], threshold)
        found |= found.T if same else _found(*sides[1], beams[1], threshold).T
        if same:
            np.fill_diagonal(found, False)
        if (found[audit] & true).sum() >= AUDIT_RECALL * true.sum():
            return found
        beams = [2 * beam for beam in beams]
    found = left @ right.T >= threshold
    if same:
        np.fill_diagonal(found, False)
    return found


def _compare(threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {name: batch.column(name)[row] for name in batch.schema.names}
                same = cell["i"].as_py() == cell["j"].as_py()
                unit = []
                for side in "ab":
                    vectors = np.frombuffer(cell[f"vectors_{side}"].as_py()).reshape(len(cell[f"keys_{side}"]), -1)
                    unit.append(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
                right_graph = SmallWorld.load(unit[1], cell["graph_b"].as_py())
                left_graph = right_graph if same else SmallWorld.load(unit[0], cell["graph_a"].as_py())
                found = links_between(unit[0], unit[1], (left_graph, right_graph), same, threshold)
                copies = [np.array(cell[f"copies_{s}"].as_py(), np.int64) for s in "ab"]
                keys = [cell[f"keys_{s}"].as_py() for s in "ab"]
                left, right = roots_of(found, same)
                names = keys[0] if same else keys[0] + keys[1]
                sides = [(keys[0], left, found, copies[1])]
                if not same:
                    sides.append((keys[1], right, found.T, copies[0]))
                a, b, n = [], [], []
                for own, root, matrix, weight in sides:
                    linked = np.flatnonzero(matrix.any(axis=1))
                    a += [own[i] for i in linked]
                    b += [names[root[i]] for i in linked]
                    n += [int(weight[matrix[i]].sum()) for i in linked]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "n"]
                )

    return compare


def embedding_components(rows: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors of equal, non-null labels (and equal length) link if their cosine
    in doubles is at least ``threshold``. Null, empty and zero vectors and those
    with null or non-finite components, and rows without label, link with
    nothing and are their own component. ``n_links`` counts the other rows
    linked directly, equal vectors and repeated rows included; ``component_id``
    is the least ``vec_id`` reachable. Equal vectors of a label are searched
    once, with their number. Every vector queries the graphs of all shards of
    its label; a task holds two shards. Other columns are ignored.
    """
    keyed = stored(keyed_vectors(rows), "vectors")
    nodes = (
        keyed.where("key is not null")
        .groupBy("label", "dim", "key")
        .agg(F.any_value("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"))
    )
    nodes = stored(nodes, "nodes")
    graphs = stored(shard_graphs(nodes.drop("low"), shard), "graphs")
    pairs = graphs.select(
        "label", "dim", F.col("shard").alias("i"), F.explode(F.sequence("shard", F.col("shards") - 1)).alias("j")
    )
    parts = ("keys", "copies", "vectors", "graph")
    one = graphs.select("label", "dim", F.col("shard").alias("i"), *[F.col(c).alias(f"{c}_a") for c in parts])
    two = graphs.select("label", "dim", F.col("shard").alias("j"), *[F.col(c).alias(f"{c}_b") for c in parts])
    both = pairs.join(two, ["label", "dim", "j"]).join(one, ["label", "dim", "i"]).drop("label", "dim")
    links = stored(both.mapInArrow(_compare(threshold), "a binary, b binary, n long"), "links")
    counts = links.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    roots = components(links).withColumnRenamed("node", "key")
    placed = stored(
        nodes.select("key", "low", "copies")
        .join(counts, "key", "left")
        .join(roots, "key", "left")
        .select(
            "key", "low", F.coalesce("component", "key").alias("component"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "placed",
    )
    least = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    known = placed.join(least, "component").select("key", "n_links", "component_id", F.lit(True).alias("known"))
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return keyed.join(known, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links, l.component_id,
       e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.a = e.vec_id
"""


@query("op9_embedding_near_dedup", SQL)
def op9(spark, sf):
    """Links and component of every embedding."""
    return embedding_components(table(spark, sf, "embeddings"))
