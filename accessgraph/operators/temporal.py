"""Filters over time-bounded assertions, and dates derived from them."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessgraph.functions.dates import covers, is_stale, season_allows

Tables = Mapping[str, DataFrame]

# The date fields that make up "data as of", and the ten tables.
AS_OF_FIELDS = ("observed_at", "created_at", "retrieved_at", "effective_from", "valid_from")
FRESHNESS_TABLES = ("place_names", "place_classifications", "connection_services")

# Which services count. Name: (needs open end, needs date, needs season, needs active status,
# a missing season kind passes).
SERVICE_RULES: dict[str, tuple[bool, bool, bool, bool, bool]] = {
    "api": (False, True, True, False, False),
    "build": (True, True, False, False, True),
    "build_month": (True, True, True, False, True),
    "export": (True, False, False, True, True),
    "dated_active": (False, True, False, True, True),
}


def current(df: DataFrame) -> DataFrame:
    return df.where(F.col("valid_to").isNull())


def valid_on(df: DataFrame, at: str | date | Column) -> DataFrame:
    return df.where(covers(at))


def in_season(df: DataFrame, at: str | date | Column, null_kind_passes: bool = False) -> DataFrame:
    day = at if isinstance(at, Column) else F.lit(at).cast("date")
    return df.where(season_allows(F.month(day), null_kind_passes=null_kind_passes))


def has_capability(df: DataFrame, capability: str) -> DataFrame:
    return df.where(F.array_contains("capabilities", capability))


def not_retired(places: DataFrame) -> DataFrame:
    return places.where(F.col("status") != "retired")


def active(places: DataFrame) -> DataFrame:
    return places.where(F.col("status") == "active")


def live_connections(connections: DataFrame) -> DataFrame:
    return connections.where(F.col("retired_at").isNull())


def counted_services(
    services: DataFrame, at: str | date | Column, capability: str | None = None, rule: str = "api"
) -> DataFrame:
    """Services that count on a date under one of the named rules."""
    open_end, dated, seasonal, active_status, null_kind = SERVICE_RULES[rule]
    if capability is not None:
        services = has_capability(services, capability)
    if open_end:
        services = current(services)
    if active_status:
        services = services.where(F.col("status") == "active")
    if dated:
        services = valid_on(services, at)
    if seasonal:
        services = in_season(services, at, null_kind_passes=null_kind)
    return services


def filter_edges(
    edges: DataFrame,
    modes: list[str] | None = None,
    capabilities: list[str] | None = None,
    operator: str | None = None,
) -> DataFrame:
    """Keep the (edge, service) rows of the given modes, capabilities and operator.

    A row without service is dropped by a capability or operator filter and kept
    when neither is asked for.
    """
    if modes:
        edges = edges.where(F.lower("mode").isin([m.lower() for m in modes]))
    if capabilities:
        wanted = F.array(*[F.lit(c) for c in capabilities])
        edges = edges.where(F.arrays_overlap("service.capabilities", wanted))
    if operator and operator.strip():
        edges = edges.where(F.lower("service.operator") == operator.strip().lower())
    return edges


def data_as_of(tables: Tables, empty: str | date | None = None) -> DataFrame:
    """One row: the latest of five date fields over all tables, or ``empty`` when there is none."""
    peaks = []
    for df in tables.values():
        present = [F.max(c).cast("date") for c in AS_OF_FIELDS if c in df.columns]
        if present:
            # Each table shrinks to one row before the union.
            peak = present[0] if len(present) == 1 else F.greatest(*present)
            peaks.append(df.agg(peak.alias("d")))
    fallback = F.lit(empty).cast("date")
    stacked = reduce(DataFrame.unionByName, peaks)
    return stacked.agg(F.coalesce(F.max("d"), fallback).alias("data_as_of"))


def latest_observed_at(tables: Tables) -> DataFrame:
    """One row: the newest observation among names, classifications and services."""
    peaks = [tables[name].agg(F.max("observed_at").alias("d")) for name in FRESHNESS_TABLES]
    return reduce(DataFrame.unionByName, peaks).agg(F.max("d").alias("last_observed_at"))


def with_release_meta(df: DataFrame, release: str, as_of: str | date, tables: Tables) -> DataFrame:
    """Add release and freshness columns to every row; the freshness is one scalar."""
    return (
        df.withColumn("release_id", F.lit(release))
        .withColumn("data_as_of", F.lit(as_of).cast("date"))
        .withColumn("freshness_status", F.lit("current"))
        .withColumn("last_observed_at", latest_observed_at(tables).scalar())
    )


def flag_stale(conditions: DataFrame, now: Column) -> DataFrame:
    return conditions.withColumn("stale", is_stale(F.col("valid_to"), now))
