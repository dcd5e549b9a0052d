"""Fixed record shapes, and the rules each field must meet."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

STRING, DATE, DOUBLE = T.StringType(), T.DateType(), T.DoubleType()

REFS = T.ArrayType(
    T.StructType([T.StructField("source_id", STRING), T.StructField("record_id", STRING)])
)
SEASONALITY = T.StructType(
    [T.StructField("kind", STRING), T.StructField("months", T.ArrayType(T.IntegerType()))]
)
POINT = T.StructType(
    [T.StructField("type", STRING), T.StructField("coordinates", T.ArrayType(DOUBLE))]
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_VALIDITY = {"valid_from": DATE, "valid_to": DATE}
_SOURCED = {"source_refs": REFS, "observed_at": DATE}

# The ten canonical tables and their columns.
TABLES: dict[str, T.StructType] = {
    "places": _struct(id=STRING, status=STRING, created_at=DATE, retired_at=DATE, source_refs=REFS),
    "place_classifications": _struct(
        id=STRING, place_id=STRING, feature_type=STRING, **_VALIDITY, **_SOURCED
    ),
    "place_names": _struct(
        id=STRING, place_id=STRING, value=STRING, language=STRING, kind=STRING, **_VALIDITY, **_SOURCED
    ),
    "place_geometries": _struct(
        id=STRING, place_id=STRING, geometry=POINT, **_VALIDITY, **_SOURCED
    ),
    "administrative_areas": _struct(id=STRING, name=STRING, level=STRING, source_refs=REFS),
    "administrative_memberships": _struct(
        id=STRING, place_id=STRING, administrative_area_id=STRING, **_VALIDITY, **_SOURCED
    ),
    "external_identifiers": _struct(
        id=STRING, entity_type=STRING, entity_id=STRING, namespace=STRING, value=STRING,
        **_VALIDITY, source_refs=REFS,
    ),
    "connections": _struct(
        id=STRING, origin_place_id=STRING, destination_place_id=STRING, direction=STRING,
        mode=STRING, created_at=DATE, retired_at=DATE,
    ),
    "connection_services": _struct(
        id=STRING, connection_id=STRING, operator=STRING, capabilities=T.ArrayType(STRING),
        seasonality=SEASONALITY, frequency_band=STRING, frequency_basis=STRING, status=STRING,
        **_VALIDITY, **_SOURCED,
    ),
    "sources": _struct(
        id=STRING, title=STRING, publisher=STRING, url=STRING, retrieved_at=DATE,
        effective_from=DATE, effective_to=DATE, media_type=STRING, checksum=STRING,
        licence=STRING, verification_status=STRING, notes=STRING,
    ),
}

STAMP, LONG = T.TimestampType(), T.LongType()
BLOCKER = _struct(code=STRING, message=STRING, severity=STRING)

# The five meta tables and their columns.
META_TABLES: dict[str, T.StructType] = {
    "source_datasets": _struct(
        id=STRING, title=STRING, publisher=STRING, authority_scope=STRING, access_method=STRING,
        terms_url=STRING, licence=STRING, expected_cadence=STRING, notes=STRING,
    ),
    "source_snapshots": _struct(
        id=STRING, source_dataset_id=STRING, url=STRING, retrieved_at=STAMP, checksum=STRING,
        media_type=STRING, schema_fingerprint=STRING, licence_status=STRING, storage_path=STRING,
        byte_size=LONG, record_count=LONG, notes=STRING,
    ),
    "import_runs": _struct(
        id=STRING, source_snapshot_id=STRING, previous_snapshot_id=STRING, adapter_name=STRING,
        adapter_version=STRING, started_at=STAMP, completed_at=STAMP, status=STRING,
        record_counts=T.MapType(STRING, LONG), warnings=T.ArrayType(STRING), errors=T.ArrayType(STRING),
    ),
    "change_events": _struct(
        id=STRING, import_run_id=STRING, release_id=STRING, kind=STRING, entity_type=STRING,
        entity_id=STRING, upstream_record_id=STRING, summary=STRING, observed_at=DATE,
    ),
    "release_manifests": _struct(
        release_id=STRING, created_at=STAMP, data_as_of=DATE,
        schema_versions=T.MapType(STRING, STRING), record_counts=T.MapType(STRING, LONG),
        source_snapshot_ids=T.ArrayType(STRING), checksums=T.MapType(STRING, STRING),
        publication_blockers=T.ArrayType(BLOCKER),
    ),
}

TRACK_POINT = _struct(
    trip_id=STRING, sequence=LONG, latitude=DOUBLE, longitude=DOUBLE,
    horizontal_accuracy_m=DOUBLE, altitude_m=DOUBLE, vertical_accuracy_m=DOUBLE,
    speed_mps=DOUBLE, course_deg=DOUBLE, recorded_at=STAMP, provider=STRING,
    mocked=T.BooleanType(), quality=STRING,
)

UUID4 = "[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
RELEASE_ID = r"\d{4}\.\d{2}\.\d{2}\.\d+"
DIGEST = "sha256:[0-9a-f]{64}"


def minted(prefix: str) -> str:
    """Pattern of an id minted under ``prefix``."""
    return f"^{prefix}_{UUID4}$"


def named(prefix: str) -> str:
    """Pattern of an id that is minted or hand-named under ``prefix``."""
    return f"^{prefix}_([a-z0-9_]+|{UUID4})$"


@dataclass(frozen=True)
class FieldRules:
    """What the columns of one table must satisfy beyond their types."""

    required: tuple[str, ...]
    patterns: dict[str, str] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)


_PLACE = {"place_id": minted("plc")}

# Required fields, id patterns and enumerations of the records.
RULES: dict[str, FieldRules] = {
    "places": FieldRules(
        ("id", "status", "created_at", "source_refs"),
        {"id": minted("plc")},
        {"status": ("active", "historical", "retired")},
    ),
    "place_classifications": FieldRules(
        ("id", "place_id", "feature_type", "source_refs", "observed_at"),
        {"id": minted("cls"), **_PLACE},
    ),
    "place_names": FieldRules(
        ("id", "place_id", "value", "language", "kind", "source_refs", "observed_at"),
        {"id": minted("nam"), **_PLACE},
        {"kind": ("official", "exonym", "historical", "alias")},
    ),
    "place_geometries": FieldRules(
        ("id", "place_id", "geometry", "source_refs", "observed_at"),
        {"id": minted("geo"), **_PLACE},
    ),
    "administrative_areas": FieldRules(
        ("id", "name", "level", "source_refs"), {"id": minted("adm")}
    ),
    "administrative_memberships": FieldRules(
        ("id", "place_id", "administrative_area_id", "source_refs", "observed_at"),
        {"id": minted("mem"), "administrative_area_id": minted("adm"), **_PLACE},
    ),
    "external_identifiers": FieldRules(
        ("id", "entity_type", "entity_id", "namespace", "value", "source_refs"),
        {"id": minted("xid")},
        {"entity_type": ("place", "connection", "area")},
    ),
    "connections": FieldRules(
        ("id", "origin_place_id", "destination_place_id", "direction", "mode", "created_at"),
        {"id": minted("con"), "origin_place_id": minted("plc"), "destination_place_id": minted("plc")},
        {
            "direction": ("one_way", "bidirectional"),
            "mode": ("air", "helicopter", "sea", "local_boat", "road"),
        },
    ),
    "connection_services": FieldRules(
        ("id", "connection_id", "capabilities", "seasonality", "frequency_band",
         "frequency_basis", "status", "source_refs", "observed_at"),
        {"id": minted("svc"), "connection_id": minted("con")},
        {
            "frequency_band": ("multiple_daily", "daily", "multiple_weekly", "weekly",
                               "less_than_weekly", "irregular", "unknown"),
            "frequency_basis": ("published_maximum", "typical", "minimum_guaranteed", "unknown"),
            "status": ("active", "suspended", "retired"),
        },
    ),
    "sources": FieldRules(
        ("id", "title", "verification_status"),
        {"id": f"^src_([a-z]+(_[a-z]+)*|{UUID4})$"},
        {"verification_status": ("verified", "pending")},
    ),
    "source_datasets": FieldRules(
        ("id", "title", "authority_scope", "access_method"),
        {"id": named("dsd")},
        {"access_method": ("rest_api", "bulk_export", "manual", "partner_feed")},
    ),
    "source_snapshots": FieldRules(
        ("id", "source_dataset_id", "url", "retrieved_at", "checksum", "media_type",
         "licence_status", "storage_path", "byte_size", "record_count"),
        {"id": named("snp"), "source_dataset_id": named("dsd"), "checksum": f"^{DIGEST}$",
         "schema_fingerprint": f"^({DIGEST})?$"},
        {"licence_status": ("verified", "unknown", "pending_review", "restricted")},
    ),
    "import_runs": FieldRules(
        ("id", "source_snapshot_id", "adapter_name", "adapter_version", "started_at",
         "completed_at", "status", "record_counts", "warnings", "errors"),
        {"id": minted("imp"), "source_snapshot_id": named("snp"),
         "previous_snapshot_id": f"^(snp_([a-z0-9_]+|{UUID4}))?$"},
        {"status": ("completed", "failed", "partial")},
    ),
    "change_events": FieldRules(
        ("id", "kind", "entity_type", "summary", "observed_at"),
        {"id": minted("chg"), "import_run_id": f"^(imp_{UUID4})?$",
         "release_id": f"^({RELEASE_ID})?$"},
        {"kind": ("added", "modified", "removed", "conflicted", "remapped")},
    ),
    "release_manifests": FieldRules(
        ("release_id", "created_at", "data_as_of", "schema_versions", "record_counts",
         "source_snapshot_ids", "checksums", "publication_blockers"),
        {"release_id": f"^{RELEASE_ID}$"},
    ),
}

CAPABILITIES = ("passenger", "freight", "emergency")
SEASON_KINDS = ("year_round", "seasonal", "irregular", "unknown")
