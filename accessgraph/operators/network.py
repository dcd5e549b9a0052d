"""Access questions over the network of places, connections and services."""

from __future__ import annotations

from datetime import date
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessgraph.functions.dates import covers, season_allows
from accessgraph.operators.temporal import (
    SERVICE_RULES,
    Tables,
    active,
    counted_services,
    current,
    has_capability,
    live_connections,
)
from accessgraph.session import cut_lineage, written

MAX_TRANSFERS = 32
# Sources that share a long; longs in a row; written layers of a search before they are merged.
WORD, SLOTS, LAYERS = 64, 8, 8


def serving_connections(t: Tables, at: str | date | Column, capability: str, rule: str = "api") -> DataFrame:
    """Live connections with at least one service that counts."""
    services = counted_services(t["connection_services"], at, capability, rule).select(
        F.col("connection_id").alias("id")
    )
    return live_connections(t["connections"]).join(services, "id", "left_semi")


def _endpoints(connections: DataFrame, *keep: str) -> DataFrame:
    return connections.select(
        F.explode(F.array("origin_place_id", "destination_place_id")).alias("place_id"), *keep
    )


def connected_places(t: Tables, at: str | date | Column, capability: str = "passenger", rule: str = "api") -> DataFrame:
    """Distinct end places of serving connections."""
    return _endpoints(serving_connections(t, at, capability, rule)).distinct()


def isolation(t: Tables, at: str | date | Column, capability: str = "passenger", rule: str = "api") -> DataFrame:
    """Every active place with ``connected`` true or false."""
    linked = connected_places(t, at, capability, rule).withColumn("connected", F.lit(True))
    return (
        active(t["places"])
        .select(F.col("id").alias("place_id"))
        .join(linked, "place_id", "left")
        .withColumn("connected", F.coalesce("connected", F.lit(False)))
    )


def isolation_counts(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count(F.lit(1)).alias("places"),
        F.count_if("connected").alias("connected"),
        F.count_if(~F.col("connected")).alias("isolated"),
    )


def single_dependency(
    t: Tables, at: str | date | Column, capability: str = "passenger", rule: str = "api"
) -> DataFrame:
    """Rows (place_id, kind, value): places that hang on one connection, mode or operator.

    "Exactly one" is tested as smallest = largest, which keeps the state per
    place constant and combines before the shuffle.
    """
    services = counted_services(t["connection_services"], at, capability, rule).select(
        F.col("connection_id").alias("id"), F.nullif("operator", F.lit("")).alias("operator")
    )
    rows = live_connections(t["connections"]).join(services, "id")
    sides = _endpoints(rows, F.col("id").alias("connection"), "mode", "operator")
    kinds = ("connection", "mode", "operator")
    spans = sides.groupBy("place_id").agg(
        *[f(k).alias(f"{n}_{k}") for k in kinds for n, f in (("lo", F.min), ("hi", F.max))]
    )
    picks = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.when(F.col(f"lo_{k}") == F.col(f"hi_{k}"), F.col(f"lo_{k}")).alias("value"))
            for k in kinds
        ]
    )
    return (
        spans.select("place_id", F.explode(picks).alias("_p"))
        .select("place_id", "_p.kind", "_p.value")
        .where(F.col("value").isNotNull())
    )


def single_dependency_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("kind").agg(F.count(F.lit(1)).alias("places"))


def month_mask(year: int, rule: str) -> Column:
    """Bits 0-11: months in which a service counts, probed on day 15."""
    _, dated, seasonal, _, null_kind = SERVICE_RULES[rule]
    bits = []
    for month in range(1, 13):
        test = F.lit(True)
        if dated:
            test = test & covers(date(year, month, 15))
        if seasonal:
            test = test & season_allows(F.lit(month), null_kind_passes=null_kind)
        bits.append(F.when(test, F.lit(1 << (month - 1))).otherwise(F.lit(0)))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def seasonal_loss(t: Tables, year: int, capability: str = "passenger", rule: str = "api") -> DataFrame:
    """Active places connected in some months of a year and not in others.

    The twelve probes travel as one bit mask per service, merged first by
    connection and then by place, so the tables are read and joined once.
    """
    open_end, _, _, active_status, _ = SERVICE_RULES[rule]
    services = has_capability(t["connection_services"], capability)
    if open_end:
        services = current(services)
    if active_status:
        services = services.where(F.col("status") == "active")
    masks = (
        services.select(F.col("connection_id").alias("id"), month_mask(year, rule).alias("mask"))
        .where(F.col("mask") > 0)
        .groupBy("id")
        .agg(F.bit_or("mask").alias("mask"))
    )
    by_place = (
        _endpoints(live_connections(t["connections"]).join(masks, "id"), "mask")
        .groupBy("place_id")
        .agg(F.bit_or("mask").alias("mask"))
        .where((F.col("mask") > 0) & (F.col("mask") < 4095))
    )
    lost = by_place.join(active(t["places"]).select(F.col("id").alias("place_id")), "place_id", "left_semi")
    months = F.sequence(F.lit(1), F.lit(12))
    is_on = lambda m: F.getbit(F.col("mask"), m - 1) == 1
    return lost.select(
        "place_id",
        F.filter(months, is_on).alias("connected_months"),
        F.filter(months, lambda m: ~is_on(m)).alias("isolated_months"),
    )


def edge_list(t: Tables, at: str | date | Column, capability: str = "passenger", rule: str = "api") -> DataFrame:
    """Directed edges (src, dst, connection_id); a bidirectional connection gives two."""
    rows = serving_connections(t, at, capability, rule)
    steps = F.array(
        F.struct(F.col("origin_place_id").alias("src"), F.col("destination_place_id").alias("dst")),
        F.when(
            F.col("direction") == "bidirectional",
            F.struct(F.col("destination_place_id").alias("src"), F.col("origin_place_id").alias("dst")),
        ),
    )
    return (
        rows.select(F.col("id").alias("connection_id"), F.explode(steps).alias("_s"))
        .where(F.col("_s").isNotNull())
        .select("_s.src", "_s.dst", "connection_id")
    )


def hop_distances(
    t: Tables,
    sources: DataFrame,
    at: str | date | Column,
    capability: str = "passenger",
    max_hops: int | None = None,
    rule: str = "api",
    target: str | None = None,
) -> DataFrame:
    """Fewest hops from each source ``place_id`` to every place it can reach.

    One join and one aggregation per hop over the newest frontier, until a round
    reaches nothing new or ``max_hops`` is met. Ties take the smallest
    connection-id array. Each round is written to the shared folder, so a lost
    executor replays one round at most.
    """
    # Of parallel edges only the smallest id can be on the chosen path.
    edges = cut_lineage(
        edge_list(t, at, capability, rule)
        .where(F.col("src") != F.col("dst"))
        .groupBy("src", "dst")
        .agg(F.min("connection_id").alias("connection_id"))
    )
    frontier = sources.select(
        F.col("place_id").alias("source"),
        F.col("place_id").alias("place_id"),
        F.lit(0).alias("hops"),
        F.array("place_id").alias("path"),
        F.array().cast("array<string>").alias("connections"),
    ).distinct()
    reached = [cut_lineage(frontier)]
    seen = reached[0].select("source", "place_id")
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        steps = (
            reached[-1]
            .withColumnRenamed("place_id", "src")
            .join(edges, "src")
            .select(
                "source",
                F.col("dst").alias("place_id"),
                F.array_append("connections", F.col("connection_id")).alias("connections"),
                F.array_append("path", F.col("dst")).alias("path"),
            )
            .join(seen, ["source", "place_id"], "left_anti")
        )
        layer = cut_lineage(
            steps.groupBy("source", "place_id")
            .agg(F.min(F.struct("connections", "path")).alias("_best"))
            .select(
                "source",
                "place_id",
                F.lit(hop).alias("hops"),
                F.col("_best.path").alias("path"),
                F.col("_best.connections").alias("connections"),
            )
        )
        if layer.isEmpty():
            break
        reached.append(layer)
        seen = cut_lineage(seen.unionByName(layer.select("source", "place_id")))
        if target is not None and not layer.where(F.col("place_id") == target).isEmpty():
            break
    return reduce(DataFrame.unionByName, reached)


def _simple_edges(t: Tables, at: str | date | Column, capability: str, rule: str) -> DataFrame:
    return edge_list(t, at, capability, rule).where(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def hops_from_many(
    t: Tables,
    sources: DataFrame,
    at: str | date | Column,
    capability: str = "passenger",
    max_hops: int | None = None,
    rule: str = "api",
) -> DataFrame:
    """(source, place_id, hops): fewest hops from every source ``place_id`` to every place it reaches.

    Sources are numbered and share words of 64 bits, up to ``SLOTS`` words a row,
    so a frontier row says which of 512 sources arrive at a place, and a round is
    one join and one ``bit_or`` that combines before the shuffle. Sources that
    were there before are masked out in the same aggregation. Only what is new is
    written in a round; written layers are merged when there are ``LAYERS`` of
    them. A source is reached by itself in no hops; rounds end when none reaches a
    new place. Names join the rows of words, so pairs are never shuffled.
    """
    edges = written(_simple_edges(t, at, capability, rule))
    starts = written(sources.select("place_id").distinct())
    n = starts.count()
    slots = max(1, min(SLOTS, -(-n // WORD)))
    # Numbers are dense inside a partition, which holds many rows of words, and must not change when a task is repeated.
    dealt = starts.repartitionByRange(max(1, n // (16 * SLOTS * WORD)), "place_id")
    numbered = written(dealt.withColumn("_n", F.monotonically_increasing_id()))
    block, slot = F.floor(F.col("_n") / (slots * WORD)).cast("long"), F.shiftright("_n", 6) % slots
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_n").bitwiseAND(F.lit(WORD - 1)).cast("int"))
    words, key = [f"w{i}" for i in range(slots)], ["block", "place_id"]
    none = F.lit(0).cast("long")
    frontier = written(
        numbered.select(block.alias("block"), "place_id", *[F.when(slot == i, bit).otherwise(none).alias(w) for i, w in enumerate(words)])
    )
    layers, seen = [frontier.withColumn("hops", F.lit(0))], [frontier]
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        arriving = frontier.join(edges, F.col("place_id") == F.col("src")).select(
            "block", F.col("dst").alias("place_id"), *words, *[none.alias(f"_{w}") for w in words]
        )
        known = [s.select(*key, *[none.alias(w) for w in words], *[F.col(w).alias(f"_{w}") for w in words]) for s in seen]
        merged = reduce(DataFrame.unionByName, known, arriving).groupBy(*key)
        fresh = [F.bit_or(w).bitwiseAND(F.bitwise_not(F.bit_or(f"_{w}"))).alias(w) for w in words]
        frontier = written(merged.agg(*fresh).where(reduce(lambda a, b: a | b, [F.col(w) != 0 for w in words])), tidy=True)
        if frontier.isEmpty():
            break
        layers.append(frontier.withColumn("hops", F.lit(hop)))
        seen.append(frontier)
        if len(seen) > LAYERS:
            seen = [written(reduce(DataFrame.unionByName, seen).groupBy(*key).agg(*[F.bit_or(w).alias(w) for w in words]), tidy=True)]
    names = numbered.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("_n", "place_id"))).alias("_l"))
    names = written(names.select("block", F.col("_l.place_id").alias("_names")))
    reached = reduce(DataFrame.unionByName, layers).join(names, "block")
    held = F.explode(F.array(*[F.struct(F.lit(i * WORD).alias("first"), F.col(w).alias("bits")) for i, w in enumerate(words)]))
    reached = reached.select("place_id", "hops", "_names", held.alias("_h")).where("_h.bits != 0")
    reached = reached.withColumn("_bit", F.explode(F.array(*[F.lit(i) for i in range(WORD)]))).where("getbit(_h.bits, _bit) = 1")
    return reached.select(F.get("_names", F.col("_h.first") + F.col("_bit")).alias("source"), "place_id", "hops")


def hop_path(
    t: Tables,
    from_place: str,
    to_place: str,
    at: str | date | Column,
    capability: str = "passenger",
    max_transfers: int | None = None,
    rule: str = "api",
) -> DataFrame:
    """One row: whether and how ``to_place`` is reached with the fewest hops."""
    if max_transfers is not None and not 0 <= max_transfers <= MAX_TRANSFERS:
        raise ValueError(f"max_transfers must be 0 to {MAX_TRANSFERS}")
    spark = t["connections"].sparkSession
    start = spark.createDataFrame([(from_place,)], "place_id string")
    hops = None if max_transfers is None else max_transfers + 1
    found = hop_distances(t, start, at, capability, hops, rule, target=to_place).where(F.col("place_id") == to_place)
    asked = spark.createDataFrame([(from_place, to_place)], "from_place_id string, to_place_id string")
    return asked.join(found, asked["to_place_id"] == found["place_id"], "left").select(
        "from_place_id",
        "to_place_id",
        F.lit(capability).alias("capability"),
        F.lit(max_transfers).cast("int").alias("max_transfers"),
        F.col("hops").isNotNull().alias("reachable"),
        "hops",
        F.coalesce("path", F.array().cast("array<string>")).alias("path"),
        F.coalesce("connections", F.array().cast("array<string>")).alias("connections"),
    )


def access_change(
    before: Tables, after: Tables, at: str | date | Column, capability: str = "passenger", rule: str = "api"
) -> DataFrame:
    """Places whose access differs between two releases: gained, lost, added or removed."""
    old = isolation(before, at, capability, rule).withColumnRenamed("connected", "was_connected")
    new = isolation(after, at, capability, rule).withColumnRenamed("connected", "is_connected")
    change = (
        F.when(F.col("was_connected").isNull(), "added")
        .when(F.col("is_connected").isNull(), "removed")
        .when(F.col("was_connected") & ~F.col("is_connected"), "lost")
        .when(~F.col("was_connected") & F.col("is_connected"), "gained")
    )
    return old.join(new, "place_id", "full").withColumn("change", change).where(F.col("change").isNotNull())
