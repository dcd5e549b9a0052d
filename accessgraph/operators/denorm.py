"""Joined and nested views of places, connections and services."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessgraph.functions.dates import as_date
from accessgraph.functions.text import slug_base
from accessgraph.operators.temporal import (
    Tables,
    counted_services,
    current,
    live_connections,
    not_retired,
)
from accessgraph.operators.windows import numbered
from accessgraph.schemas import SEASONALITY
from accessgraph.session import written

# Month names in season labels.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def unknown_season() -> Column:
    return F.struct(F.lit("unknown").alias("kind"), F.array().cast("array<int>").alias("months")).cast(SEASONALITY)


def is_canonical(kind: str = "kind", language: str = "language") -> Column:
    return (F.col(kind) == "official") & (F.col(language) == "kl")


def last_by_id(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key, the one with the largest id; combined before the shuffle."""
    body = F.struct(*[F.col(c) for c in columns])
    picked = df.groupBy(*keys).agg(F.max_by(body, F.col("id")).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])


def split_names(names: DataFrame) -> DataFrame:
    """Current names with ``is_canonical`` true on the first official one of each place."""
    live = current(names)
    first = (
        live.where(is_canonical())
        .groupBy("place_id")
        .agg(F.min("id").alias("canonical_id"))
    )
    return live.join(first, "place_id", "left").withColumn(
        "is_canonical", F.coalesce(F.col("id") == F.col("canonical_id"), F.lit(False))
    ).drop("canonical_id")


def canonical_names(names: DataFrame) -> DataFrame:
    """One row per place: the first current official name, by id."""
    body = F.struct("id", "value", "valid_from", "valid_to", "source_refs", "observed_at")
    return (
        current(names)
        .where(is_canonical())
        .groupBy("place_id")
        .agg(F.min_by(body, F.col("id")).alias("name"))
    )


def id_range(df: DataFrame, column: str, ranges: int = 256) -> Column:
    """The range of ids that a row falls in, rising with the id, from ``ranges`` quantiles of a hash sample.

    Bounds only steer how work is divided; any bounds give the same result.
    """
    sample = df.where(F.pmod(F.xxhash64(column), F.lit(64)) == 0).select(F.col(column).alias("_b"))
    bounds = [r[0] for r in sample.orderBy(F.xxhash64("_b")).limit(16 * ranges).collect() if r[0] is not None]
    bounds = sorted(set(bounds))[:: max(1, len(bounds) // ranges)]
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(column)))


def with_slugs(named: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Add ``slug`` to rows (id, value, ...); later holders of one name, in id order, get -2, -3 and so on.

    A common name is numbered in chunks of ids: ranges that hold about equal
    numbers of ``ids``, a table that is cheap to read (``named`` by default).
    """
    has_name = F.coalesce(F.length("value"), F.lit(0)) > 0
    based = named.withColumn("base", F.when(has_name, slug_base(F.col("value"))).otherwise(F.col("id")))
    counted = numbered(based, ["base"], ["id"], id_range(named if ids is None else ids, "id"), "_n")
    again = F.concat_ws("-", "base", F.col("_n").cast("string"))
    return counted.withColumn("slug", F.when(F.col("_n") == 1, F.col("base")).otherwise(again)).drop("_n")


def assign_slugs(places: DataFrame, names: DataFrame) -> DataFrame:
    """Slug per live place."""
    named = not_retired(places).select("id").join(
        canonical_names(names).select(F.col("place_id").alias("id"), F.col("name.value").alias("value")), "id", "left"
    )
    return with_slugs(named, places).select("id", "base", "slug")


def current_places(t: Tables) -> DataFrame:
    """Live places with current classification, official name, geometry and municipality.

    Row multiplicity of the left joins is kept, as in a plain SQL view.
    """
    classes = current(t["place_classifications"]).select(
        F.col("place_id").alias("id"), "feature_type", F.col("source_refs").alias("classification_source_refs")
    )
    names = current(t["place_names"]).where(is_canonical()).select(
        F.col("place_id").alias("id"),
        F.col("value").alias("canonical_name_kl"),
        F.col("source_refs").alias("name_source_refs"),
    )
    points = current(t["place_geometries"]).select(
        F.col("place_id").alias("id"), "geometry", F.col("source_refs").alias("geometry_source_refs")
    )
    areas = t["administrative_areas"].where(F.col("level") == "municipality").select(
        F.col("id").alias("municipality_id"), F.col("name").alias("municipality")
    )
    members = (
        current(t["administrative_memberships"])
        .select(F.col("place_id").alias("id"), F.col("administrative_area_id").alias("municipality_id"))
        .join(areas, "municipality_id")
    )
    live = not_retired(t["places"]).select("id", "status", "created_at", "source_refs")
    joined = live
    for side in (classes, names, points, members):
        joined = joined.join(side, "id", "left")
    return joined


def current_connections(t: Tables) -> DataFrame:
    """Live connections with each current service; a connection without one keeps a row."""
    services = current(t["connection_services"]).select(
        F.col("connection_id").alias("id"),
        F.col("id").alias("service_id"),
        "operator",
        "capabilities",
        "seasonality",
        "frequency_band",
        "frequency_basis",
        "status",
        "valid_from",
        "valid_to",
        "source_refs",
    )
    live = live_connections(t["connections"]).select(
        "id", "origin_place_id", "destination_place_id", "direction", "mode"
    )
    return live.join(services, "id", "left")


def place_singles(t: Tables) -> DataFrame:
    """One row per live place: names, classification, point, municipality and newest observation.

    The four tables are stacked and folded by place in one shuffle; every fold
    keeps one value over all rows of the place and combines before it travels.
    """

    def stacked(table: DataFrame, kind: str, body: Column, *more: Column) -> DataFrame:
        return current(table).select("place_id", F.col("observed_at").alias("seen"), body.alias(kind), *more)

    official = F.when(is_canonical(), F.struct("id", "value", "valid_from", "valid_to", "source_refs"))
    danish = F.when(F.col("language") == "da", F.struct("id", "value"))
    areas = t["administrative_areas"].select(F.col("id").alias("administrative_area_id"), "name")
    members = t["administrative_memberships"].join(areas, "administrative_area_id", "left")
    parts = [
        not_retired(t["places"]).select(F.col("id").alias("place_id"), F.struct("status", "created_at").alias("place")),
        stacked(t["place_names"], "name", official, danish.alias("danish")),
        stacked(t["place_classifications"], "class", F.struct("id", "feature_type", "source_refs")),
        stacked(t["place_geometries"], "point", F.struct("id", "geometry", "valid_from", "valid_to", "source_refs")),
        stacked(members, "area", F.struct("id", "name")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return (
        rows.groupBy("place_id")
        .agg(
            F.max("place").alias("place"),
            F.min_by("name", F.col("name.id")).alias("name"),
            F.min_by("danish", F.col("danish.id")).alias("danish"),
            F.max_by("class", F.col("class.id")).alias("class"),
            F.max_by("point", F.col("point.id")).alias("point"),
            F.min_by("area", F.col("area.id")).alias("area"),
            F.max("seen").alias("seen"),
        )
        .where(F.col("place").isNotNull())
    )


def _of_live_places(t: Tables, rows: DataFrame) -> DataFrame:
    live = not_retired(t["places"]).select(F.col("id").alias("place_id"))
    return rows.join(live, "place_id", "left_semi")


def place_alternates(t: Tables) -> DataFrame:
    """One row per current name of a live place other than its canonical one."""
    return _of_live_places(t, split_names(t["place_names"]).where(~F.col("is_canonical"))).select(
        "place_id",
        F.col("id").alias("assertion_id"),
        "value",
        "language",
        F.coalesce("kind", F.lit("alias")).alias("kind"),
        "valid_from",
        "valid_to",
        "source_refs",
    )


def place_memberships(t: Tables) -> DataFrame:
    """One row per current membership of a live place, with level and name of the area."""
    areas = t["administrative_areas"].select(F.col("id").alias("administrative_area_id"), "name", "level")
    return _of_live_places(
        t, current(t["administrative_memberships"]).join(areas, "administrative_area_id", "left")
    ).select(
        "place_id",
        F.col("id").alias("assertion_id"),
        F.coalesce("level", F.lit("")).alias("level"),
        F.coalesce("name", F.lit("")).alias("name"),
        "valid_from",
        "valid_to",
        "source_refs",
        "observed_at",
    )


def denorm_places(t: Tables) -> DataFrame:
    """One record per live place; its other names and memberships are child rows.

    See :func:`place_alternates` and :func:`place_memberships`. The first Danish
    name and the first open membership, by id, stand in the record.
    """
    no_refs = F.array().cast(t["places"].schema["source_refs"].dataType)
    # Numbering reads its input twice and takes a sample of the ids.
    singles = with_slugs(
        written(place_singles(t).withColumn("id", F.col("place_id")).withColumn("value", F.col("name.value")))
    )
    coordinates = F.struct(
        F.col("point.id").alias("assertion_id"),
        F.col("point.geometry.coordinates")[1].alias("latitude"),
        F.col("point.geometry.coordinates")[0].alias("longitude"),
        F.col("point.valid_from").alias("valid_from"),
        F.col("point.valid_to").alias("valid_to"),
        F.col("point.source_refs").alias("source_refs"),
    )
    return singles.select(
        "id",
        "slug",
        F.struct(
            F.col("name.id").alias("assertion_id"),
            F.coalesce("name.value", F.lit("")).alias("value"),
            F.lit("kl").alias("language"),
            F.col("name.valid_from").alias("valid_from"),
            F.col("name.valid_to").alias("valid_to"),
            F.coalesce("name.source_refs", no_refs).alias("source_refs"),
        ).alias("canonical_name"),
        F.coalesce("danish.value", F.lit("")).alias("danish_name"),
        F.coalesce("area.name", F.lit("")).alias("municipality"),
        F.when(F.col("point").isNotNull(), coordinates).alias("coordinates"),
        F.coalesce("class.feature_type", F.lit("")).alias("feature_type"),
        F.col("place.status").alias("status"),
        F.coalesce("class.source_refs", no_refs).alias("classification_source_refs"),
        F.coalesce("name.source_refs", no_refs).alias("source_refs"),
        F.coalesce("seen", F.col("place.created_at")).alias("updated_at"),
    )


def service_struct() -> Column:
    """The service as callers see it, with defaults for missing parts."""
    return F.struct(
        F.col("id"),
        F.col("operator"),
        F.coalesce("capabilities", F.array().cast("array<string>")).alias("capabilities"),
        F.coalesce("seasonality", unknown_season()).alias("seasonality"),
        F.coalesce("frequency_band", F.lit("unknown")).alias("frequency_band"),
        F.coalesce("frequency_basis", F.lit("unknown")).alias("frequency_basis"),
        F.coalesce("status", F.lit("active")).alias("status"),
        F.col("valid_from"),
        F.col("valid_to"),
        F.col("source_refs"),
        F.col("observed_at"),
    )


def denorm_reachability(t: Tables) -> DataFrame:
    """One record per live connection, updated when any of its current services was seen.

    The services are child rows, see :func:`connection_services`.
    """
    seen = (
        current(t["connection_services"])
        .groupBy(F.col("connection_id").alias("id"))
        .agg(F.max("observed_at").alias("seen"), F.count(F.lit(1)).alias("service_count"))
    )
    return live_connections(t["connections"]).join(seen, "id", "left").select(
        "id",
        "origin_place_id",
        "destination_place_id",
        "direction",
        "mode",
        F.coalesce("service_count", F.lit(0)).alias("service_count"),
        F.coalesce("seen", "created_at").alias("updated_at"),
    )


def connection_services(t: Tables) -> DataFrame:
    """(connection_id, service) of every current service of a live connection."""
    live = live_connections(t["connections"]).select(F.col("id").alias("connection_id"))
    services = current(t["connection_services"]).select("connection_id", service_struct().alias("service"))
    return services.join(live, "connection_id", "left_semi")


def place_detail(t: Tables, place_id: str | Column) -> DataFrame:
    """The view row of one place beside each of its current names; one row without name if it has none."""
    wanted = ChainMap({"places": t["places"].where(F.col("id") == place_id)}, t)
    for name in ("place_classifications", "place_names", "place_geometries", "administrative_memberships"):
        wanted[name] = t[name].where(F.col("place_id") == place_id)
    names = current(wanted["place_names"]).select(
        F.col("place_id").alias("id"),
        F.struct("kind", "language", "value", "id", "valid_from", "valid_to", "source_refs").alias("name"),
    )
    return current_places(wanted).join(names, "id", "left")


def place_identifiers(t: Tables, place_id: str, today: str | date | Column) -> DataFrame:
    """External ids of a place that are open or end on or after ``today``."""
    return (
        t["external_identifiers"]
        .where((F.col("entity_type") == "place") & (F.col("entity_id") == place_id))
        .where(F.col("valid_to").isNull() | (F.col("valid_to") >= as_date(today)))
        .select("id", "namespace", "value", "valid_from", "valid_to", "source_refs")
        .orderBy("namespace", "value")
    )


def edges_with_services(t: Tables, at: str | date | Column, connections: DataFrame | None = None) -> DataFrame:
    """Live connections, one row per service valid and in season on a date; a null service if there is none."""
    live = live_connections(t["connections"] if connections is None else connections)
    services = counted_services(t["connection_services"], at, rule="api").select(
        F.col("connection_id").alias("id"), service_struct().alias("service")
    )
    return live.join(services, "id", "left").select(
        F.col("id").alias("connection_id"), "origin_place_id", "destination_place_id", "direction", "mode", "service"
    )


def place_connections(t: Tables, place_id: str, at: str | date | Column) -> DataFrame:
    """Edges that touch a place on a date, a row per service, with its role and the peer; direction is ignored."""
    touching = t["connections"].where(
        (F.col("origin_place_id") == place_id) | (F.col("destination_place_id") == place_id)
    )
    near_services = t["connection_services"].join(
        touching.select(F.col("id").alias("connection_id")), "connection_id", "left_semi"
    )
    near = ChainMap({"connection_services": near_services}, t)
    is_origin = F.col("origin_place_id") == place_id
    return (
        edges_with_services(near, at, touching)
        .withColumn("role", F.when(is_origin, "origin").otherwise("destination"))
        .withColumn("peer_place_id", F.when(is_origin, F.col("destination_place_id")).otherwise(F.col("origin_place_id")))
    )


def all_place_connections(t: Tables, at: str | date | Column) -> DataFrame:
    """The same for every place at once: (place_id, role, peer_place_id, edge columns)."""
    edges = edges_with_services(t, at)
    ends = F.array(
        F.struct(
            F.col("origin_place_id").alias("place_id"),
            F.lit("origin").alias("role"),
            F.col("destination_place_id").alias("peer_place_id"),
        ),
        F.struct(
            F.col("destination_place_id").alias("place_id"),
            F.lit("destination").alias("role"),
            F.col("origin_place_id").alias("peer_place_id"),
        ),
    )
    # A loop touches its place once, as origin.
    ends = F.when(F.col("origin_place_id") == F.col("destination_place_id"), F.slice(ends, 1, 1)).otherwise(ends)
    return edges.withColumn("_end", F.explode(ends)).select(
        "_end.*", "connection_id", "direction", "mode", "service"
    )


def reachable_neighbours(t: Tables, place_id: str, at: str | date | Column) -> DataFrame:
    """Places one step away, honouring direction, dates and an active status."""
    both = F.col("direction") == "bidirectional"
    steps = live_connections(t["connections"]).where(
        (F.col("origin_place_id") == place_id) | (both & (F.col("destination_place_id") == place_id))
    )
    steps = steps.select(
        F.col("id").alias("connection_id"),
        "mode",
        F.when(F.col("origin_place_id") == place_id, F.col("destination_place_id"))
        .otherwise(F.col("origin_place_id"))
        .alias("peer_place_id"),
    )
    services = counted_services(t["connection_services"], at, rule="dated_active").select(
        "connection_id", F.col("id").alias("service_id"), "operator"
    )
    peers = current(t["place_names"]).where(is_canonical()).select(
        F.col("place_id").alias("peer_place_id"), F.col("value").alias("peer_name")
    )
    return steps.join(services, "connection_id").join(peers, "peer_place_id", "left")


def graph_nodes(t: Tables) -> DataFrame:
    """End places of live connections that have an official name and a point.

    Names and points are taken regardless of validity; the largest id wins.
    """
    names = t["place_names"]
    by = lambda test: F.max_by("value", F.when(test, F.col("id")))
    kl = is_canonical()
    other_official = (F.col("kind") == "official") & (F.col("language") != "kl")
    first_other = F.min_by("value", F.when(other_official, F.col("id")))
    pivot = names.groupBy("place_id").agg(
        F.coalesce(by(kl), first_other).alias("official_name"),
        by((F.col("kind") == "exonym") & (F.col("language") == "da")).alias("danish_name"),
        by(F.col("kind").isin("historical", "former", "old")).alias("historical_name"),
    )
    points = last_by_id(
        t["place_geometries"].where(F.col("geometry.type") == "Point"), ["place_id"], ["geometry"]
    ).select(
        "place_id",
        F.col("geometry.coordinates")[0].alias("longitude"),
        F.col("geometry.coordinates")[1].alias("latitude"),
    )
    live = live_connections(t["connections"])
    ends = live.select(F.explode(F.array("origin_place_id", "destination_place_id")).alias("place_id")).distinct()
    return (
        t["places"]
        .select(F.col("id").alias("place_id"))
        .join(ends, "place_id", "left_semi")
        .join(pivot.where(F.col("official_name").isNotNull()), "place_id")
        .join(points, "place_id")
    )


def graph_edges(t: Tables, nodes: DataFrame) -> DataFrame:
    """Live connections between known nodes, with a summary of the first active open service by id.

    All of those services are child rows, see :func:`edge_services`.
    """
    ends = written(nodes.select("place_id", "official_name"))
    first = (
        counted_services(t["connection_services"], F.lit(None), rule="export")
        .groupBy(F.col("connection_id").alias("id"))
        .agg(F.min(service_struct()).alias("_first"), F.count(F.lit(1)).alias("service_count"))
    )
    return (
        live_connections(t["connections"])
        .join(
            ends.select(F.col("place_id").alias("origin_place_id"), F.col("official_name").alias("from_name")),
            "origin_place_id",
        )
        .join(
            ends.select(F.col("place_id").alias("destination_place_id"), F.col("official_name").alias("to_name")),
            "destination_place_id",
        )
        .join(first, "id", "left")
        .select(
            "id",
            F.col("origin_place_id").alias("from_place_id"),
            F.col("destination_place_id").alias("to_place_id"),
            "from_name",
            "to_name",
            F.coalesce("direction", F.lit("bidirectional")).alias("direction"),
            "mode",
            F.coalesce("service_count", F.lit(0)).alias("service_count"),
            F.col("_first.operator").alias("operator"),
            F.col("_first.frequency_band").alias("frequency_band"),
            F.coalesce(F.col("_first.seasonality"), unknown_season()).alias("seasonality"),
        )
    )


def edge_services(t: Tables, edges: DataFrame) -> DataFrame:
    """(id, service) of every active open service of the given edges."""
    services = counted_services(t["connection_services"], F.lit(None), rule="export").select(
        F.col("connection_id").alias("edge_id"), service_struct().alias("service")
    )
    return edges.select("id").join(services.withColumnRenamed("edge_id", "id"), "id")


def season_label(seasonality: str = "seasonality") -> Column:
    """``Year-round``, the listed month names, or the kind."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    kind, months = F.col(f"{seasonality}.kind"), F.col(f"{seasonality}.months")
    listed = F.transform(months, lambda m: F.coalesce(F.get(names, m - 1), m.cast("string")))
    return (
        F.when(kind == "year_round", "Year-round")
        .when((kind == "seasonal") & (F.size(months) > 0), F.array_join(listed, ", "))
        .otherwise(F.coalesce(F.nullif(kind, F.lit("")), F.lit("Unknown seasonality")))
    )


def links_from(edges: DataFrame, place_id: str | None = None) -> DataFrame:
    """Links leaving a place: its own edges, and bidirectional edges from the far end.

    Without ``place_id`` the links of all places are returned. Both ends come
    from one pass over the edges.
    """

    def link(here: str, there: str) -> Column:
        return F.struct(
            F.col(f"{here}_place_id").alias("place_id"),
            F.col(f"{there}_place_id").alias("other_place_id"),
            F.col(f"{there}_name").alias("other_name"),
        )

    back = (F.col("direction") == "bidirectional") & (F.col("from_place_id") != F.col("to_place_id"))
    ends = F.array_compact(F.array(link("from", "to"), F.when(back, link("to", "from"))))
    columns = ["id", "mode", "operator", "frequency_band", "seasonality"]
    links = edges.select(F.explode(ends).alias("_l"), *columns).select("_l.*", *columns)
    if place_id is not None:
        links = links.where(F.col("place_id") == place_id)
    return links.withColumn("season_label", season_label())


def link_lines(edges: DataFrame, nodes: DataFrame, place_id: str | None = None) -> DataFrame:
    """Line features from a place to each linked peer."""
    spots = nodes.select("place_id", "longitude", "latitude")
    peers = spots.select(
        F.col("place_id").alias("other_place_id"),
        F.col("longitude").alias("other_longitude"),
        F.col("latitude").alias("other_latitude"),
    )
    return (
        links_from(edges, place_id)
        .join(spots, "place_id")
        .join(peers, "other_place_id")
        .select(
            "place_id",
            F.struct("id", "mode", "other_name", "other_place_id", "season_label").alias("properties"),
            F.struct(
                F.lit("LineString").alias("type"),
                F.array(F.array("longitude", "latitude"), F.array("other_longitude", "other_latitude")).alias(
                    "coordinates"
                ),
            ).alias("geometry"),
        )
    )
