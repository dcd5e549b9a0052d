"""Reconciliation of places with outside authorities, and import of authority rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessgraph.functions.dates import as_date
from accessgraph.functions.text import clean_name, name_key, strip_gid
from accessgraph.operators.denorm import is_canonical, last_by_id
from accessgraph.operators.quality import row_rules
from accessgraph.operators.temporal import Tables, current

# Locality types, and the fields an authority record may carry.
LOCALITY_FEATURES = {21: "town", 23: "settlement"}
AUTHORITY_FIELDS = (
    "namespace", "record_id", "official_name", "feature_type", "longitude", "latitude", "decision_ref", "confirmed_place_id",
)
AUTHORITY_REQUIRED = ("namespace", "record_id", "official_name")


def minted_id(prefix: str, *parts: Column) -> Column:
    """An id in UUID form made from content, so that a rerun mints the same one."""
    h = F.sha2(F.concat_ws("|", F.lit(prefix), *parts), 256)
    cut = lambda start, size: F.substring(h, start, size)
    variant = F.element_at(F.split(F.lit("8,9,a,b"), ","), F.pmod(F.conv(cut(17, 1), 16, 10).cast("int"), F.lit(4)) + 1)
    return F.concat(
        F.lit(f"{prefix}_"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-4"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12)
    )


# --- authority records ------------------------------------------------------------


def check_authority(records: DataFrame, authorities: Sequence[str]) -> DataFrame:
    """Violations of authority records; the key is ``namespace/record_id``."""
    keyed = records.withColumn(
        "_key", F.concat_ws("/", F.coalesce("namespace", F.lit("?")), F.coalesce("record_id", F.lit("?")))
    )
    blank = [F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0 for c in AUTHORITY_REQUIRED]
    lon, lat = F.col("longitude"), F.col("latitude")
    unknown = sorted(set(records.columns) - set(AUTHORITY_FIELDS))
    rules = [
        ("required", blank[0] | blank[1] | blank[2], F.lit("namespace, record_id and official_name must be non-empty")),
        ("namespace", ~F.col("namespace").isin(*authorities), F.lit("unsupported namespace")),
        ("pair", lon.isNull() != lat.isNull(), F.lit("longitude and latitude must be supplied together")),
        ("range", ~lon.between(-180, 180) | ~lat.between(-90, 90), F.lit("invalid WGS84 coordinates")),
    ]
    for name in unknown:
        rules.append(("unknown_field", F.col(name).isNotNull(), F.lit(f"unknown field: {name}")))
    found = row_rules(keyed, "authority", rules, "_key")
    twice = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.unionByName(
        twice.select(
            F.lit("authority").alias("table"),
            F.lit("duplicate_key").alias("rule"),
            F.col("_key").alias("key"),
            F.lit("duplicate authority key").alias("message"),
        )
    )


def unknown_confirmations(t: Tables, records: DataFrame) -> DataFrame:
    known = t["places"].select(F.col("id").alias("confirmed_place_id"))
    return records.where(F.length("confirmed_place_id") > 0).join(known, "confirmed_place_id", "left_anti")


def reconcile_matches(t: Tables, records: DataFrame, authorities: Sequence[str]) -> DataFrame:
    """One row per place and authority: status, chosen record and field differences.

    Records are folded to one row per (authority, place) and per (authority,
    name) before they meet the places, so common names do not multiply.
    """
    names = last_by_id(current(t["place_names"]).where(is_canonical()), ["place_id"], ["value"])
    classes = last_by_id(current(t["place_classifications"]), ["place_id"], ["feature_type"])
    points = last_by_id(current(t["place_geometries"]), ["place_id"], ["geometry"])
    fields = [F.col(c) if c in records.columns else F.lit(None).alias(c) for c in AUTHORITY_FIELDS]
    rows = records.select(*fields)
    body = F.struct("record_id", "official_name", "feature_type", "longitude", "latitude", "decision_ref")
    confirmed = (
        rows.where(F.length("confirmed_place_id") > 0)
        .groupBy("namespace", F.col("confirmed_place_id").alias("place_id"))
        .agg(F.count(F.lit(1)).alias("confirmations"), F.min_by(body, "record_id").alias("_confirmed"))
    )
    by_name = (
        rows.withColumn("_name", name_key(F.col("official_name")))
        .groupBy("namespace", "_name")
        .agg(F.count(F.lit(1)).alias("candidates"), F.min_by(body, "record_id").alias("_candidate"))
    )
    # The authorities are a short fixed list; their totals become one row.
    totals = rows.agg(*[F.count_if(F.col("namespace") == a).alias(a) for a in authorities])
    total = lambda a: totals.select(a).scalar()
    places = (
        t["places"]
        .select(F.col("id").alias("place_id"))
        .join(names, "place_id")
        .join(classes, "place_id", "left")
        .join(points, "place_id", "left")
        .withColumn("_name", name_key(F.col("value")))
    )
    wide = (
        places.withColumn("namespace", F.explode(F.array(*[F.lit(a) for a in authorities])))
        .join(confirmed, ["namespace", "place_id"], "left")
        .join(by_name, ["namespace", "_name"], "left")
    )
    exported = F.lit(False)
    for a in authorities:
        exported = F.when(F.col("namespace") == a, total(a) > 0).otherwise(exported)
    confirmations, candidates = F.coalesce("confirmations", F.lit(0)), F.coalesce("candidates", F.lit(0))
    status = (
        F.when(confirmations > 1, "ambiguous_confirmation")
        .when(confirmations == 1, "confirmed")
        .when(~exported, "waiting_for_export")
        .when(candidates == 1, "candidate_exact_name")
        .when(candidates > 1, "ambiguous_exact_name")
        .otherwise("missing")
    )
    chosen = F.when(F.col("status") == "confirmed", F.col("_confirmed")).when(
        F.col("status") == "candidate_exact_name", F.col("_candidate")
    )
    seed = F.col("geometry.coordinates")
    point = F.array("_chosen.longitude", "_chosen.latitude")

    def difference(field: str, ours: Column, theirs: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), ours.cast("string").alias("seed"), theirs.cast("string").alias("authority"))

    differences = F.array_compact(
        F.array(
            F.when(
                F.col("_chosen.official_name") != F.col("value"),
                difference("official_name", F.col("value"), F.col("_chosen.official_name")),
            ),
            F.when(
                F.col("_chosen.feature_type") != F.col("feature_type"),
                difference("feature_type", F.col("feature_type"), F.col("_chosen.feature_type")),
            ),
            F.when(
                F.col("_chosen.longitude").isNotNull() & seed.isNotNull() & (point != seed),
                difference("geometry", F.array_join(seed.cast("array<string>"), " "), F.array_join(point.cast("array<string>"), " ")),
            ),
        )
    )
    return (
        wide.withColumn("status", status)
        .withColumn("_chosen", chosen)
        .select(
            "place_id",
            "namespace",
            F.col("value").alias("current_official_name"),
            F.col("feature_type").alias("current_feature_type"),
            seed.alias("current_geometry"),
            "status",
            F.col("_chosen.record_id").alias("record_id"),
            candidates.alias("candidate_count"),
            F.col("_chosen.decision_ref").alias("decision_ref"),
            F.when(F.col("_chosen").isNotNull(), differences).otherwise(F.slice(differences, 1, 0)).alias("differences"),
        )
    )


def candidate_records(records: DataFrame) -> DataFrame:
    """(namespace, name_key, record_id) of every authority record; a place's candidates share the key of its name.

    Rows stay per record, so a name that many places and records share is not
    multiplied out.
    """
    return records.select("namespace", name_key(F.col("official_name")).alias("name_key"), "record_id")


def match_differences(matches: DataFrame) -> DataFrame:
    """One row per differing field of a match: (place_id, namespace, record_id, field, seed, authority)."""
    return matches.select("place_id", "namespace", "record_id", F.explode("differences").alias("_d")).select(
        "place_id", "namespace", "record_id", "_d.*"
    )


def reconcile(t: Tables, records: DataFrame, authorities: Sequence[str]) -> DataFrame:
    """One row per place with its overall status and the match per authority (a short fixed list)."""
    rows = reconcile_matches(t, records, authorities)
    match = F.struct("namespace", "status", "record_id", "candidate_count", "decision_ref", "differences")
    folded = rows.groupBy("place_id", "current_official_name", "current_feature_type", "current_geometry").agg(
        F.sort_array(F.collect_list(match)).alias("authority_matches"),
        F.bool_and(F.col("status") == "confirmed").alias("_all_confirmed"),
        F.bool_or(F.col("status") == "missing").alias("_missing"),
        F.bool_or(F.col("status").isin("ambiguous_confirmation", "ambiguous_exact_name")).alias("_ambiguous"),
        F.max(F.size("differences")).alias("_differences"),
    )
    status = (
        F.when(F.col("_all_confirmed"), F.when(F.col("_differences") > 0, "conflicting").otherwise("matched"))
        .when(F.col("_missing"), "missing")
        .when(F.col("_ambiguous"), "conflicting")
        .otherwise("unresolved")
    )
    return folded.withColumn("status", status).drop("_all_confirmed", "_missing", "_ambiguous", "_differences")


def reconcile_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("places"))


# --- normalisation and import -------------------------------------------------------


def normalize_authority(features: DataFrame, namespace: str, excluded: Sequence[int] = (), ref: str = "ID=") -> DataFrame:
    """Localities of a register feed as authority rows; broken rows are left to :func:`authority_problems`."""
    label = F.lit(None).cast("string")
    for code, kind in LOCALITY_FEATURES.items():
        label = F.when(F.col("type_code") == code, kind).otherwise(label)
    gid, name = strip_gid(F.col("global_id")), clean_name(F.col("official_name"))
    rows = features.where(F.col("type_code").isin(*LOCALITY_FEATURES))
    if excluded:
        rows = rows.where(~F.coalesce(F.col("record_id").isin(*excluded), F.lit(False)))
    return rows.where((F.length(gid) > 0) & name.isNotNull() & F.col("record_id").isNotNull()).select(
        F.lit(namespace).alias("namespace"),
        gid.alias("record_id"),
        name.alias("official_name"),
        label.alias("feature_type"),
        F.concat(F.lit(ref), F.col("record_id").cast("string")).alias("decision_ref"),
    )


def authority_problems(features: DataFrame, excluded: Sequence[int] = ()) -> DataFrame:
    """Rows (global_id, problem) that a normalisation must not pass over in silence."""
    rows = features.where(F.col("type_code").isin(*LOCALITY_FEATURES)).withColumn("gid", strip_gid(F.col("global_id")))
    checked = rows.where(~F.coalesce(F.col("record_id").isin(*excluded), F.lit(False))) if excluded else rows
    problem = (
        F.when(F.coalesce(F.length("gid"), F.lit(0)) == 0, "missing GlobalID")
        .when(F.col("record_id").isNull(), "missing numeric ID")
        .when(clean_name(F.col("official_name")).isNull(), "missing official name")
    )
    bad = checked.select(F.col("gid").alias("global_id"), problem.alias("problem")).where(F.col("problem").isNotNull())
    twice = rows.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return bad.unionByName(twice.select(F.col("gid").alias("global_id"), F.lit("duplicate GlobalID").alias("problem")))


def carry_confirmations(rows: DataFrame, previous: DataFrame) -> DataFrame:
    """Keep confirmed place ids across extracts: by stable reference, else by record id."""
    old = previous.where(F.length("confirmed_place_id") > 0)
    by_ref = old.where(F.length("decision_ref") > 0).groupBy("decision_ref").agg(F.max("confirmed_place_id").alias("_by_ref"))
    by_record = old.where(F.length("record_id") > 0).groupBy("record_id").agg(F.max("confirmed_place_id").alias("_by_record"))
    kept = F.col("confirmed_place_id") if "confirmed_place_id" in rows.columns else F.lit(None).cast("string")
    return (
        rows.withColumn("_own", kept)
        .drop("confirmed_place_id")
        .join(by_ref, "decision_ref", "left")
        .join(by_record, "record_id", "left")
        .withColumn("confirmed_place_id", F.coalesce("_by_ref", "_by_record", "_own"))
        .drop("_own", "_by_ref", "_by_record")
    )


def select_imports(
    authority: DataFrame, names: DataFrame | None = None, record_ids: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(selected rows, problems (wanted, problem)) by official ``name`` or by ``record_id``."""
    if (names is None) == (record_ids is None):
        raise ValueError("pass exactly one of names or record_ids")
    taken = F.length("confirmed_place_id") > 0
    if record_ids is not None:
        wanted = record_ids.select(strip_gid(F.col("record_id")).alias("record_id")).distinct()
        found = authority.join(wanted, "record_id", "left_semi")
        missing = wanted.join(authority, "record_id", "left_anti").select(
            F.col("record_id").alias("wanted"), F.lit("missing").alias("problem")
        )
        confirmed = found.where(taken).select(F.col("record_id").alias("wanted"), F.lit("already confirmed").alias("problem"))
        return found.where(~F.coalesce(taken, F.lit(False))), missing.unionByName(confirmed)
    wanted = names.select(F.col("name").alias("official_name")).distinct()
    free = authority.where(~F.coalesce(taken, F.lit(False)))
    counts = free.groupBy("official_name").agg(F.count(F.lit(1)).alias("_n"))
    graded = wanted.join(counts, "official_name", "left")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "homonym")
    problems = graded.select(F.col("official_name").alias("wanted"), problem.alias("problem")).where(F.col("problem").isNotNull())
    return free.join(graded.where("_n = 1").select("official_name"), "official_name", "left_semi"), problems


def mint_localities(
    selected: DataFrame,
    attributes: DataFrame,
    areas: DataFrame,
    existing: DataFrame,
    source_id: str,
    namespace: str,
    observed_at: str | date,
    created_at: str | date,
) -> dict[str, DataFrame]:
    """New rows for five tables, and ``problems`` for what cannot be minted.

    ``attributes`` has (record_id, municipality_code, danish_name), ``areas``
    (municipality_code, administrative_area_id), ``existing`` the external ids.
    """
    present = existing.where(
        (F.col("namespace") == namespace) & (F.col("entity_type") == "place") & F.col("valid_to").isNull()
    ).select(F.col("value").alias("record_id"), F.lit(True).alias("_present")).distinct()
    wide = (
        selected.select("record_id", "official_name", "feature_type")
        .join(attributes.withColumn("_listed", F.lit(True)), "record_id", "left")
        .join(areas, "municipality_code", "left")
        .join(present, "record_id", "left")
    )
    problem = (
        F.when(F.col("_present"), "id already in source")
        .when(F.col("_listed").isNull(), "no attributes")
        .when(F.col("administrative_area_id").isNull(), "unknown municipality code")
    )
    graded = wide.withColumn("problem", problem)
    refs = F.array(F.struct(F.lit(source_id).alias("source_id"), F.col("record_id")))
    rows = graded.where(F.col("problem").isNull()).select(
        "*", minted_id("plc", F.lit(namespace), F.col("record_id")).alias("place_id"), refs.alias("source_refs")
    )
    seen, made, open_end = as_date(observed_at), as_date(created_at), F.lit(None).cast("date")
    window = [open_end.alias("valid_from"), open_end.alias("valid_to"), "source_refs"]

    def names(df: DataFrame, value: str, language: str, kind: str) -> DataFrame:
        return df.select(
            minted_id("nam", F.col("place_id"), F.lit(language), F.lit(kind)).alias("id"),
            "place_id",
            F.col(value).alias("value"),
            F.lit(language).alias("language"),
            F.lit(kind).alias("kind"),
            *window,
            seen.alias("observed_at"),
        )

    danish = rows.withColumn("danish_name", clean_name(F.col("danish_name"))).where(F.col("danish_name").isNotNull())
    return {
        "places": rows.select(
            F.col("place_id").alias("id"), F.lit("active").alias("status"), made.alias("created_at"),
            open_end.alias("retired_at"), "source_refs",
        ),
        "place_classifications": rows.select(
            minted_id("cls", F.col("place_id")).alias("id"), "place_id", "feature_type", *window, seen.alias("observed_at")
        ),
        "place_names": names(rows, "official_name", "kl", "official").unionByName(names(danish, "danish_name", "da", "exonym")),
        "external_identifiers": rows.select(
            minted_id("xid", F.col("place_id"), F.lit(namespace)).alias("id"), F.lit("place").alias("entity_type"),
            F.col("place_id").alias("entity_id"), F.lit(namespace).alias("namespace"), F.col("record_id").alias("value"), *window,
        ),
        "administrative_memberships": rows.select(
            minted_id("mem", F.col("place_id"), F.col("administrative_area_id")).alias("id"), "place_id",
            "administrative_area_id", *window, seen.alias("observed_at"),
        ),
        "problems": graded.where(F.col("problem").isNotNull()).select("record_id", "official_name", "problem"),
    }


def rotated_ids(t: Tables, authority: DataFrame, namespace: str) -> DataFrame:
    """Rows (old, new) where a confirmed place carries an outdated record id."""
    held = current(t["external_identifiers"]).where(
        (F.col("namespace") == namespace) & (F.col("entity_type") == "place")
    ).select(F.col("entity_id").alias("confirmed_place_id"), F.col("value").alias("old"))
    return (
        authority.where((F.length("confirmed_place_id") > 0) & (F.length("record_id") > 0))
        .join(held, "confirmed_place_id")
        .where(F.col("old") != F.col("record_id"))
        .select("old", F.col("record_id").alias("new"))
        .distinct()
    )


def rewrite_refs(df: DataFrame, mapping: DataFrame, source_id: str) -> DataFrame:
    """Replace record ids inside ``source_refs`` of one source; only rows that cite a mapped id are touched."""
    cited = df.select("id", F.posexplode("source_refs").alias("_pos", "_ref")).where(F.col("_ref.source_id") == source_id)
    changed = (
        cited.join(mapping, cited["_ref.record_id"] == mapping["old"])
        .groupBy("id")
        .agg(F.map_from_entries(F.collect_set(F.struct("_pos", "new"))).alias("_new"))
    )
    swap = F.transform(
        "source_refs",
        lambda r, i: F.struct(
            r["source_id"].alias("source_id"),
            F.coalesce(F.try_element_at(F.col("_new"), i), r["record_id"]).alias("record_id"),
        ),
    )
    return (
        df.join(changed, "id", "left")
        .withColumn("source_refs", F.when(F.col("_new").isNotNull(), swap).otherwise(F.col("source_refs")))
        .select(*df.columns)
    )


def rewrite_ids(t: Tables, mapping: DataFrame, source_id: str, namespace: str) -> dict[str, DataFrame]:
    """Names, classifications and external ids with rotated record ids rewritten."""
    swapped = {
        name: rewrite_refs(t[name], mapping, source_id)
        for name in ("place_names", "place_classifications", "external_identifiers")
    }
    xids = swapped["external_identifiers"]
    target = (F.col("namespace") == namespace) & (F.col("entity_type") == "place") & F.col("valid_to").isNull()
    moved = xids.join(mapping.select(F.col("old").alias("value"), "new"), "value", "left").withColumn(
        "value", F.when(target, F.coalesce("new", "value")).otherwise(F.col("value"))
    )
    swapped["external_identifiers"] = moved.select(*xids.columns)
    return swapped


def update_source(sources: DataFrame, source_id: str, checksum: str, retrieved_at: str | date, note: str) -> DataFrame:
    """Refresh checksum, date and the snapshot sentence in the notes of one source."""
    hit = F.col("id") == source_id
    notes = F.coalesce("notes", F.lit(""))
    sentence = f"Raw snapshot: {note}"
    written = F.when(
        F.contains(notes, F.lit("Raw snapshot:")),
        F.concat(F.substring_index(notes, "Raw snapshot:", 1), F.lit(sentence)),
    ).otherwise(F.concat(F.rtrim(notes), F.lit(" " + sentence)))
    return (
        sources.withColumn("retrieved_at", F.when(hit, as_date(retrieved_at)).otherwise(F.col("retrieved_at")))
        .withColumn("checksum", F.when(hit, F.lit(checksum)).otherwise(F.col("checksum")))
        .withColumn("notes", F.when(hit, written).otherwise(F.col("notes")))
    )


def seed_names(t: Tables) -> DataFrame:
    """Distinct current official names."""
    return current(t["place_names"]).where(is_canonical()).select(F.col("value").alias("name")).distinct()


def filter_by_names(features: DataFrame, names: DataFrame) -> DataFrame:
    """Features whose official name equals one of the names."""
    return features.join(names.select(F.col("name").alias("official_name")), "official_name", "left_semi")


def scope_filter(features: DataFrame, scope: str = "all") -> DataFrame:
    """Localities only, or all; a plain predicate that reaches the scan."""
    return features.where(F.col("type_code").isin(*LOCALITY_FEATURES)) if scope == "localities" else features


def merged(t: Mapping[str, DataFrame], minted: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The canonical tables with minted rows appended."""
    return {name: df.unionByName(minted[name]) if name in minted else df for name, df in t.items()}
