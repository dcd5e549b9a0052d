"""Data-quality rules; every violation is a row (table, rule, key, message)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accessgraph.operators.denorm import assign_slugs, is_canonical
from accessgraph.operators.temporal import Tables, active, current
from accessgraph.schemas import CAPABILITIES, META_TABLES, RULES, SEASON_KINDS, TABLES

COLUMNS = ("table", "rule", "key", "message")

PLACE_ASSERTIONS = ("place_classifications", "place_names", "place_geometries", "administrative_memberships")
WITH_VALIDITY = (*PLACE_ASSERTIONS, "connection_services", "external_identifiers")
WITH_SOURCES = tuple(name for name, schema in TABLES.items() if "source_refs" in schema.fieldNames())
# What an external identifier may name, and the table that holds it.
ENTITIES = {"place": "places", "connection": "connections", "area": "administrative_areas"}
PUBLISH_RULES = ("pending_source", "pending_reference", "verified_source_url", "verified_source_retrieved_at")

Rule = tuple[str, Column, Column]


def _text(template: str, *args: Column) -> Column:
    first, *rest = template.split("%s")
    filled = [part for a, after in zip(args, rest, strict=True) for part in (F.coalesce(a.cast("string"), F.lit("null")), F.lit(after))]
    return F.concat(F.lit(first), *filled)


def row_rules(df: DataFrame, table: str, rules: Iterable[Rule], key: str = "id") -> DataFrame:
    """All rules of one table in one scan; a row yields one violation per failed rule."""
    failed = F.array_compact(
        F.array(
            *[
                F.when(test, F.struct(F.lit(rule).alias("rule"), message.alias("message")))
                for rule, test, message in rules
            ]
        )
    )
    return df.select(F.col(key).cast("string").alias("key"), F.explode(failed).alias("_f")).select(
        F.lit(table).alias("table"), "_f.rule", "key", "_f.message"
    )


def _found(df: DataFrame, table: str | Column, rule: str, key: Column, message: Column) -> DataFrame:
    name = table if isinstance(table, Column) else F.lit(table)
    return df.select(name.alias("table"), F.lit(rule).alias("rule"), key.cast("string").alias("key"), message.alias("message"))


def _all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --- record shape -------------------------------------------------------------


def schema_rules(table: str, df: DataFrame) -> list[Rule]:
    """Required fields, id patterns, enumerations and ranges of one table."""
    spec, rules = RULES[table], []
    for name in spec.required:
        rules.append(("required", F.col(name).isNull(), F.lit(f"'{name}' is a required property")))
    for name, pattern in spec.patterns.items():
        rules.append(("pattern", ~F.col(name).rlike(pattern), _text(f"{name} '%s' has the wrong form", F.col(name))))
    for name, allowed in spec.enums.items():
        rules.append(("enum", ~F.col(name).isin(*allowed), _text(f"{name} '%s' is not allowed", F.col(name))))
    if "source_refs" in df.columns:
        refs = F.col("source_refs")
        rules.append(("min_items", F.size(refs) == 0, F.lit("source_refs is empty")))
    if "geometry" in df.columns:
        lon, lat = F.get("geometry.coordinates", F.lit(0)), F.get("geometry.coordinates", F.lit(1))
        rules.append(("geometry_type", F.col("geometry.type") != "Point", F.lit("geometry is not a Point")))
        rules.append(("coordinates", F.size("geometry.coordinates") != 2, F.lit("coordinates need two numbers")))
        rules.append(("range", ~lon.between(-180, 180), _text("longitude %s is out of range", lon)))
        rules.append(("range", ~lat.between(-90, 90), _text("latitude %s is out of range", lat)))
    if "seasonality" in df.columns:
        months = F.col("seasonality.months")
        rules.append(
            ("enum", ~F.col("seasonality.kind").isin(*SEASON_KINDS), _text("season '%s' is not allowed", F.col("seasonality.kind")))
        )
        rules.append(("range", F.exists(months, lambda m: ~m.between(1, 12)), F.lit("a month is not 1 to 12")))
        rules.append(("unique_items", F.size(F.array_distinct(months)) < F.size(months), F.lit("a month is repeated")))
    if "capabilities" in df.columns:
        unknown = F.array_except("capabilities", F.array(*[F.lit(c) for c in CAPABILITIES]))
        rules.append(("enum", F.size(unknown) > 0, F.lit("a capability is not allowed")))
    return rules


def schema_violations(table: str, df: DataFrame) -> DataFrame:
    key = "id" if "id" in df.columns else "release_id"
    return row_rules(df, table, schema_rules(table, df), key)


def raw_violations(table: str, lines: DataFrame, value: str = "value") -> DataFrame:
    """Checks that need the raw JSON text: broken lines, unknown fields, unreadable dates, wrong types."""
    schema = {**TABLES, **META_TABLES}[table]
    fields = F.from_json(value, "map<string,string>")
    parsed = lines.where(F.trim(value) != "").withColumn("_m", fields)
    unknown = F.array_except(F.map_keys("_m"), F.array(*[F.lit(n) for n in schema.fieldNames()]))
    dates = [f.name for f in schema.fields if isinstance(f.dataType, T.DateType)]
    texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    as_variant = F.try_parse_json(value)
    rules: list[Rule] = [
        ("json", F.col("_m").isNull() | as_variant.isNull(), F.lit("invalid JSON")),
        ("unknown_field", F.size(unknown) > 0, _text("unexpected: %s", F.array_join(F.array_sort(unknown), ", "))),
    ]
    for name in dates:
        written = F.col("_m")[name]
        readable = written.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(written).isNotNull()
        rules.append(("date", written.isNotNull() & ~readable, _text(f"{name} '%s' is not a date", written)))
    for name in texts:
        kind = F.schema_of_variant(F.try_variant_get(as_variant, f"$.{name}", "variant"))
        rules.append(("type", kind.isNotNull() & ~kind.isin("STRING", "VOID"), F.lit(f"{name} is not a string")))
    keyed = parsed.withColumn("_key", F.coalesce(F.col("_m")["id"], F.col("_m")["release_id"], F.col(value)))
    return row_rules(keyed, table, rules, "_key")


def meta_violations(tables: Tables) -> DataFrame:
    return _all(schema_violations(name, tables[name]) for name in META_TABLES if name in tables)


# --- rules across records -------------------------------------------------------


def duplicate_ids(t: Tables) -> DataFrame:
    ids = _all(t[name].select("id", F.lit(name).alias("table")) for name in TABLES)
    # No ordering and no list per id: one count and the smallest table name.
    return _found(
        ids.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("table").alias("table")).where("n > 1"),
        F.col("table"),
        "duplicate_id",
        F.col("id"),
        _text("id '%s' is used more than once", F.col("id")),
    )


def _orphans(child: DataFrame, table: str, column: str, parents: DataFrame) -> DataFrame:
    known = parents.select(F.col("id").alias(column))
    lost = child.where(F.coalesce(F.length(column), F.lit(0)) > 0).join(known, column, "left_anti")
    return _found(lost, table, "foreign_key", F.col("id"), _text(f"{column} '%s' does not resolve", F.col(column)))


def foreign_keys(t: Tables) -> DataFrame:
    found = [_orphans(t[name], name, "place_id", t["places"]) for name in PLACE_ASSERTIONS]
    found.append(
        _orphans(
            t["administrative_memberships"], "administrative_memberships", "administrative_area_id", t["administrative_areas"]
        )
    )
    found.append(_orphans(t["connection_services"], "connection_services", "connection_id", t["connections"]))
    return _all(found)


def polymorphic_keys(t: Tables) -> DataFrame:
    known = _all(
        t[table].select(F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id")) for kind, table in ENTITIES.items()
    )
    ids = t["external_identifiers"].where(F.coalesce(F.length("entity_id"), F.lit(0)) > 0)
    lost = ids.join(known, ["entity_type", "entity_id"], "left_anti")
    return _found(
        lost,
        "external_identifiers",
        "polymorphic_key",
        F.col("id"),
        _text("entity_id '%s' does not resolve as %s", F.col("entity_id"), F.col("entity_type")),
    )


def _references(t: Tables, names: Iterable[str], only_current: bool = False) -> DataFrame:
    frames = []
    for name in names:
        df = t[name]
        if only_current and "valid_to" in df.columns:
            df = current(df)
        frames.append(
            df.select(F.lit(name).alias("table"), "id", F.posexplode("source_refs").alias("pos", "ref")).select(
                "table", "id", "pos", F.col("ref.source_id").alias("source_id")
            )
        )
    return _all(frames)


def unknown_sources(t: Tables) -> DataFrame:
    refs = _references(t, WITH_SOURCES).where(F.coalesce(F.length("source_id"), F.lit(0)) > 0)
    lost = refs.join(t["sources"].select(F.col("id").alias("source_id")), "source_id", "left_anti")
    return _found(
        lost,
        F.col("table"),
        "unknown_source",
        F.col("id"),
        _text("source_refs[%s] unknown source '%s'", F.col("pos"), F.col("source_id")),
    )


def validity_rules() -> list[Rule]:
    test = F.col("valid_from") > F.col("valid_to")
    return [("validity_order", test, _text("valid_from '%s' > valid_to '%s'", F.col("valid_from"), F.col("valid_to")))]


def validity_order(t: Tables) -> DataFrame:
    return _all(row_rules(t[name], name, validity_rules()) for name in WITH_VALIDITY)


def _one_current(t: Tables, table: str, rows: DataFrame, rule: str, what: str) -> DataFrame:
    counts = rows.groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))
    places = active(t["places"]).select(F.col("id").alias("place_id"))
    seen = places.join(counts, "place_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> 1")
    return _found(seen, table, rule, F.col("place_id"), _text(f"active place '%s' has %s {what}", F.col("place_id"), F.col("n")))


def one_official_name(t: Tables) -> DataFrame:
    rows = current(t["place_names"]).where(is_canonical())
    return _one_current(t, "place_names", rows, "one_official_name", "current official KL names")


def one_classification(t: Tables) -> DataFrame:
    rows = current(t["place_classifications"])
    return _one_current(t, "place_classifications", rows, "one_classification", "current classifications")


def lifecycle_rules() -> list[Rule]:
    retired, ended = F.col("status") == "retired", F.col("retired_at").isNotNull()
    return [
        ("lifecycle", retired & ~ended, F.lit("a retired place needs retired_at")),
        ("lifecycle", ~retired & ended, F.lit("only a retired place may have retired_at")),
    ]


def place_row_rules(t: Tables) -> DataFrame:
    return row_rules(t["places"], "places", lifecycle_rules())


def loop_rules() -> list[Rule]:
    loop = F.col("origin_place_id") == F.col("destination_place_id")
    return [("self_connection", loop, _text("self-connection (%s)", F.col("origin_place_id")))]


def self_connections(t: Tables) -> DataFrame:
    return row_rules(t["connections"], "connections", loop_rules())


def _later_copies(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key other than the one with the smallest id, with ``first_id``."""
    firsts = (
        rows.groupBy(*keys).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    return rows.join(firsts, keys).where(F.col("id") > F.col("first_id"))


def duplicate_edges(t: Tables) -> DataFrame:
    ends = ("origin_place_id", "destination_place_id")
    both = F.col("direction") == "bidirectional"
    rows = t["connections"].select(
        "id",
        F.when(both, F.least(*ends)).otherwise(F.col(ends[0])).alias("a"),
        F.when(both, F.greatest(*ends)).otherwise(F.col(ends[1])).alias("b"),
        "mode",
        "direction",
    )
    keys = ["a", "b", "mode", "direction"]
    for name in keys:
        rows = rows.where(F.length(name) > 0)
    return _found(
        _later_copies(rows, keys),
        "connections",
        "duplicate_edge",
        F.col("id"),
        _text("duplicate edge %s <-> %s (%s), first is %s", F.col("a"), F.col("b"), F.col("mode"), F.col("first_id")),
    )


def duplicate_identifiers(t: Tables) -> DataFrame:
    rows = current(t["external_identifiers"]).select("id", "namespace", "value")
    return _found(
        _later_copies(rows, ["namespace", "value"]),
        "external_identifiers",
        "duplicate_identifier",
        F.col("id"),
        _text("duplicate current namespace/value (%s, %s), first is %s", F.col("namespace"), F.col("value"), F.col("first_id")),
    )


def season_rules() -> list[Rule]:
    kind, months = F.col("seasonality.kind"), F.coalesce(F.size("seasonality.months"), F.lit(0))
    return [
        ("seasonality", (kind == "year_round") & (months > 0), F.lit("a year-round service lists months")),
        ("seasonality", (kind == "seasonal") & (months <= 0), F.lit("a seasonal service lists no months")),
    ]


def seasonality(t: Tables) -> DataFrame:
    return row_rules(t["connection_services"], "connection_services", season_rules())


def slug_collisions(t: Tables) -> DataFrame:
    slugs = assign_slugs(t["places"], t["place_names"]).groupBy("slug").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _found(slugs, "places", "slug_unique", F.col("slug"), _text("slug '%s' belongs to %s places", F.col("slug"), F.col("n")))


def retired_assertions(t: Tables) -> DataFrame:
    gone = t["places"].where(F.col("status") == "retired").select(F.col("id").alias("place_id"))
    return _all(
        _found(
            current(t[name]).join(gone, "place_id", "left_semi"),
            name,
            "retired_place",
            F.col("id"),
            _text("active assertion on retired place '%s'", F.col("place_id")),
        )
        for name in PLACE_ASSERTIONS
    )


def retired_services(t: Tables) -> DataFrame:
    gone = t["connections"].where(F.col("retired_at").isNotNull()).select(F.col("id").alias("connection_id"))
    return _found(
        current(t["connection_services"]).join(gone, "connection_id", "left_semi"),
        "connection_services",
        "retired_connection",
        F.col("id"),
        _text("active service on retired connection '%s'", F.col("connection_id")),
    )


def pending_references(t: Tables) -> DataFrame:
    pending = t["sources"].where(F.col("verification_status") == "pending").select(F.col("id").alias("source_id"))
    refs = _references(t, WITH_SOURCES, only_current=True).join(pending, "source_id", "left_semi")
    return _found(
        refs,
        F.col("table"),
        "pending_reference",
        F.col("id"),
        _text("current assertion references pending source '%s'", F.col("source_id")),
    )


def source_rules() -> list[Rule]:
    verified = F.col("verification_status") == "verified"
    no_url = F.coalesce(F.length("url"), F.lit(0)) == 0
    return [
        ("verified_source_url", verified & no_url, _text("verified source '%s' has no URL", F.col("id"))),
        (
            "verified_source_retrieved_at",
            verified & F.col("retrieved_at").isNull(),
            _text("verified source '%s' has no retrieved_at", F.col("id")),
        ),
        (
            "pending_source",
            F.col("verification_status") == "pending",
            _text("source '%s' is still pending", F.col("id")),
        ),
    ]


def source_row_rules(t: Tables) -> DataFrame:
    return row_rules(t["sources"], "sources", source_rules())


def record_violations(t: Tables, publish: bool = False, schema: bool = True) -> DataFrame:
    """The rules that need one record only, all of a table in one scan."""
    own = {"places": lifecycle_rules, "connections": loop_rules, "connection_services": season_rules}
    if publish:
        own["sources"] = source_rules
    found = []
    for name in TABLES:
        rules = schema_rules(name, t[name]) if schema else []
        rules += validity_rules() if name in WITH_VALIDITY else []
        rules += own[name]() if name in own else []
        if rules:
            found.append(row_rules(t[name], name, rules))
    return _all(found)


def _kept(test: Column, target: str, key: Column, rule: str, column: str = "", pos: Column | None = None) -> Column:
    """A reference of a row to the record ``key`` of ``target``, if ``test`` holds."""
    fields = {"rule": F.lit(rule), "column": F.lit(column), "pos": F.lit(None).cast("int") if pos is None else pos}
    fields |= {"target": F.lit(target), "ref": key}
    return F.when(test & (F.coalesce(F.length(key), F.lit(0)) > 0), F.struct(*[c.alias(n) for n, c in fields.items()]))


def references(t: Tables) -> DataFrame:
    """All references as rows (table, id, live, rule, column, pos, target, ref), one scan per table.

    ``rule`` is what is broken when nothing has the key; ``live`` says that the row is current.
    """
    always, frames = F.lit(True), []
    for name in TABLES:
        df, held = t[name], []
        if name in PLACE_ASSERTIONS:
            held.append(_kept(always, "place", F.col("place_id"), "foreign_key", "place_id"))
        if name == "administrative_memberships":
            held.append(_kept(always, "area", F.col("administrative_area_id"), "foreign_key", "administrative_area_id"))
        if name == "connection_services":
            held.append(_kept(always, "connection", F.col("connection_id"), "foreign_key", "connection_id"))
        if name == "external_identifiers":
            known = F.col("entity_type").isin(*ENTITIES)
            held += [_kept(F.col("entity_type") == kind, kind, F.col("entity_id"), "polymorphic_key") for kind in ENTITIES]
            held.append(_kept(~F.coalesce(known, F.lit(False)), "", F.col("entity_id"), "polymorphic_key"))
        found = F.array(*held) if held else None
        if name in WITH_SOURCES:
            refs = F.transform(
                "source_refs", lambda ref, pos: _kept(always, "source", ref["source_id"], "unknown_source", pos=pos)
            )
            found = refs if found is None else F.concat(found, F.coalesce(refs, F.array()))
        if found is None:
            continue
        live = F.col("valid_to").isNull() if "valid_to" in df.columns else always
        kind = F.col("entity_type") if name == "external_identifiers" else F.lit(None).cast("string")
        rows = df.select("id", live.alias("live"), kind.alias("kind"), F.explode(F.array_compact(found)).alias("_r"))
        frames.append(rows.select(F.lit(name).alias("table"), "id", "live", "kind", "_r.*"))
    return _all(frames)


def reference_violations(t: Tables, publish: bool = False) -> DataFrame:
    """Rules about what a row refers to, in one join of all references with all records.

    It gives what ``foreign_keys``, ``polymorphic_keys``, ``unknown_sources``,
    ``retired_assertions``, ``retired_services`` and, for ``publish``,
    ``pending_references`` give one by one. A key used twice counts as closed if
    one of its records is.
    """
    no = F.lit(False)
    closed = {
        "place": F.coalesce(F.col("status") == "retired", no),
        "connection": F.col("retired_at").isNotNull(),
        "area": no,
        "source": F.coalesce(F.col("verification_status") == "pending", no),
    }
    records = _all(
        t[table].select(F.lit(kind).alias("target"), F.col("id").alias("ref"), closed[kind].alias("closed"))
        for kind, table in {**ENTITIES, "source": "sources"}.items()
    )
    records = records.groupBy("target", "ref").agg(F.bool_or("closed").alias("closed"))
    seen = references(t).join(records, ["target", "ref"], "left")
    ref, rule = F.col("ref"), F.col("rule")
    lost = (
        F.when(rule == "foreign_key", _text("%s '%s' does not resolve", F.col("column"), ref))
        .when(rule == "polymorphic_key", _text("entity_id '%s' does not resolve as %s", ref, F.col("kind")))
        .otherwise(_text("source_refs[%s] unknown source '%s'", F.col("pos"), ref))
    )
    ends = (F.col("column") == "place_id", F.col("column") == "connection_id")
    stale = (
        F.when(ends[0], F.struct(F.lit("retired_place").alias("rule"), _text("active assertion on retired place '%s'", ref).alias("message")))
        .when(ends[1], F.struct(F.lit("retired_connection").alias("rule"), _text("active service on retired connection '%s'", ref).alias("message")))
    )
    if publish:
        pending = _text("current assertion references pending source '%s'", ref)
        stale = stale.when(rule == "unknown_source", F.struct(F.lit("pending_reference").alias("rule"), pending.alias("message")))
    broken = F.when(F.col("closed").isNull(), F.struct("rule", lost.alias("message"))).when(F.col("closed") & F.col("live"), stale)
    return (
        seen.withColumn("_b", broken)
        .where(F.col("_b").isNotNull())
        .select("table", "_b.rule", F.col("id").cast("string").alias("key"), "_b.message")
    )


def violations(t: Tables, publish: bool = False, schema: bool = True) -> DataFrame:
    """Every violation of the canonical tables; ``publish`` adds the rules that only block a release."""
    found = [
        record_violations(t, publish, schema),
        reference_violations(t, publish),
        duplicate_ids(t),
        one_official_name(t),
        one_classification(t),
        slug_collisions(t),
        duplicate_edges(t),
        duplicate_identifiers(t),
    ]
    return _all(found)


def record_counts(t: Tables) -> DataFrame:
    """Rows (table, records), and their sum as ``total``."""
    counts = _all(t[name].agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("table"), "records") for name in TABLES)
    total = counts.agg(F.sum("records").alias("records")).select(F.lit("total").alias("table"), "records")
    return counts.unionByName(total)


def publication_blockers(found: DataFrame, sources: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Rows (code, message, severity) that stand against a release, without repeats."""
    rule = F.col("rule")
    code = (
        F.when(rule.isin("pending_source", "pending_reference"), "pending_provenance")
        .when(rule == "verified_source_url", "verified_source_missing_url")
        .when(rule == "verified_source_retrieved_at", "verified_source_missing_retrieved_at")
        .otherwise("validation_error")
    )
    where = _text("%s:%s: %s", F.col("table"), F.col("key"), F.col("message"))
    rows = [found.select(code.alias("code"), where.alias("message"), F.lit("blocker").alias("severity"))]
    bare = sources.where((F.col("verification_status") == "verified") & F.col("licence").isNull())
    rows.append(
        bare.select(
            F.lit("unknown_source_licence").alias("code"),
            _text("Verified source '%s' has no licence field", F.col("id")).alias("message"),
            F.lit("warning").alias("severity"),
        )
    )
    if snapshots is not None:
        status = F.col("licence_status")
        grade = (
            F.when(status == "unknown", F.struct(F.lit("unknown_redistribution_status").alias("code"), F.lit("blocker").alias("severity")))
            .when(status == "restricted", F.struct(F.lit("restricted_redistribution").alias("code"), F.lit("blocker").alias("severity")))
            .when(status == "pending_review", F.struct(F.lit("licence_pending_review").alias("code"), F.lit("warning").alias("severity")))
        )
        rows.append(
            snapshots.withColumn("_g", grade)
            .where(F.col("_g").isNotNull())
            .select(
                F.col("_g.code").alias("code"),
                _text("Snapshot '%s' licence is %s", F.col("id"), status).alias("message"),
                F.col("_g.severity").alias("severity"),
            )
        )
    return _all(rows).groupBy("code", "message").agg(F.min("severity").alias("severity"))


def publish_state(blockers: DataFrame) -> DataFrame:
    """One row: ready when nothing blocks; ``clean`` when there is not even a warning."""
    blocking = F.count_if(F.col("severity") == "blocker")
    return blockers.agg(
        (blocking == 0).alias("publish_ready"),
        (F.count(F.lit(1)) == 0).alias("clean"),
        blocking.alias("blockers"),
        F.count(F.lit(1)).alias("findings"),
    )
