"""Queries over data quality, file integrity and release comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from accessgraph.operators import integrity, quality, releases
from accessgraph.plans.access import SQL_BASE
from accessgraph.plans.registry import query
from accessgraph.plans.views import base, domain_tables, view
from accessgraph.schemas import TABLES

KEYED = ("table", "rule", "key")


RULE_SQL: list[str] = []


def _rule(name: str, fn, sql: str) -> None:
    RULE_SQL.append(sql)

    @query(name, sql)
    def _(spark, sf):
        return fn(domain_tables(spark, sf)).select(*KEYED)


@query(
    "f1_schema_services",
    """SELECT 'required' AS rule, count(*) AS n FROM v_connection_services WHERE frequency_band IS NULL
       UNION ALL SELECT 'pattern', 2 * count(*) FROM v_connection_services""",
)
def _(spark, sf):
    found = quality.schema_violations("connection_services", domain_tables(spark, sf)["connection_services"])
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "f1_schema_points",
    """SELECT id AS key, CASE WHEN lon * 3 < -180 THEN 1 ELSE 0 END + CASE WHEN lat * 1.2 > 90 THEN 1 ELSE 0 END AS n
       FROM v_place_geometries WHERE lon * 3 < -180 OR lat * 1.2 > 90""",
)
def _(spark, sf):
    far = F.struct(
        F.lit("Point").alias("type"),
        F.array(
            F.col("geometry.coordinates")[0] * 3.0, F.col("geometry.coordinates")[1] * 1.2
        ).alias("coordinates"),
    )
    rows = domain_tables(spark, sf)["place_geometries"].withColumn("geometry", far)
    found = quality.schema_violations("place_geometries", rows).where(F.col("rule") == "range")
    return found.groupBy("key").agg(F.count("*").alias("n"))


SQL_LINE = """CASE WHEN event_id % 50 = 0 THEN '{"id": ' ELSE '{"id": "e' || CAST(event_id AS STRING) || '", "status": '
    || CASE WHEN user_id % 11 = 0 THEN '5' ELSE '"active"' END || CASE WHEN user_id % 7 = 0 THEN ', "colour": 3' ELSE '' END
    || ', "created_at": "2023-02-2' || CAST(event_id % 10 AS STRING) || '"}' END"""


@query(
    "f1_raw_lines",
    """SELECT 'json' AS rule, count(*) AS n FROM events WHERE event_id % 50 = 0
       UNION ALL SELECT 'unknown_field', count(*) FROM events WHERE event_id % 50 <> 0 AND user_id % 7 = 0
       UNION ALL SELECT 'type', count(*) FROM events WHERE event_id % 50 <> 0 AND user_id % 11 = 0
       UNION ALL SELECT 'date', count(*) FROM events WHERE event_id % 50 <> 0 AND event_id % 10 = 9""",
)
def _(spark, sf):
    lines = base(spark, sf, "events").select(F.expr(SQL_LINE).alias("value"))
    return quality.raw_violations("places", lines).groupBy("rule").agg(F.count("*").alias("n"))


SQL_ALL_IDS = " UNION ALL ".join(f"SELECT id, '{n}' AS t FROM v_{n}" for n in TABLES)
_rule(
    "f2_duplicate_ids",
    quality.duplicate_ids,
    f"SELECT min(t) AS \"table\", 'duplicate_id' AS rule, id AS key FROM ({SQL_ALL_IDS}) GROUP BY id HAVING count(*) > 1",
)
_rule(
    "f3_foreign_keys",
    quality.foreign_keys,
    " UNION ALL ".join(
        [f"SELECT '{n}' AS \"table\", 'foreign_key' AS rule, id AS key FROM v_{n} WHERE place_id NOT IN (SELECT id FROM v_places)"
         for n in quality.PLACE_ASSERTIONS]
        + ["SELECT 'administrative_memberships', 'foreign_key', id FROM v_administrative_memberships WHERE administrative_area_id NOT IN (SELECT id FROM v_administrative_areas)",
           "SELECT 'connection_services', 'foreign_key', id FROM v_connection_services WHERE connection_id NOT IN (SELECT id FROM v_connections)"]
    ),
)
_rule(
    "f4_polymorphic_keys",
    quality.polymorphic_keys,
    """SELECT 'external_identifiers' AS "table", 'polymorphic_key' AS rule, id AS key FROM v_external_identifiers
       WHERE (entity_type = 'place' AND entity_id NOT IN (SELECT id FROM v_places))
          OR (entity_type = 'connection' AND entity_id NOT IN (SELECT id FROM v_connections))
          OR (entity_type = 'area' AND entity_id NOT IN (SELECT id FROM v_administrative_areas))""",
)
_rule(
    "f5_unknown_sources",
    quality.unknown_sources,
    " UNION ALL ".join(
        f"SELECT '{n}' AS \"table\", 'unknown_source' AS rule, id AS key FROM v_{n} WHERE source_id NOT IN (SELECT id FROM v_sources)"
        for n in quality.WITH_SOURCES
    ),
)
_rule(
    "f6_validity_order",
    quality.validity_order,
    " UNION ALL ".join(
        f"SELECT '{n}' AS \"table\", 'validity_order' AS rule, id AS key FROM v_{n} WHERE valid_from > valid_to"
        for n in quality.WITH_VALIDITY
    ),
)


def _one(name: str, fn, table: str, rule: str, where: str) -> None:
    _rule(
        name,
        fn,
        f"""SELECT '{table}' AS "table", '{rule}' AS rule, p.id AS key FROM v_places p
            LEFT JOIN (SELECT place_id, count(*) AS n FROM v_{table} WHERE {where} GROUP BY place_id) c ON c.place_id = p.id
            WHERE p.status = 'active' AND coalesce(c.n, 0) <> 1""",
    )


_one("f7_one_official_name", quality.one_official_name, "place_names", "one_official_name",
     "valid_to IS NULL AND kind = 'official' AND language = 'kl'")
_one("f8_one_classification", quality.one_classification, "place_classifications", "one_classification", "valid_to IS NULL")
_rule(
    "f9_lifecycle",
    quality.place_row_rules,
    """SELECT 'places' AS "table", 'lifecycle' AS rule, id AS key FROM v_places
       WHERE (status = 'retired') <> (retired_at IS NOT NULL)""",
)
_rule(
    "f10_self_connections",
    quality.self_connections,
    """SELECT 'connections' AS "table", 'self_connection' AS rule, id AS key FROM v_connections
       WHERE origin_place_id = destination_place_id""",
)
_rule(
    "f11_duplicate_edges",
    quality.duplicate_edges,
    """SELECT 'connections' AS "table", 'duplicate_edge' AS rule, id AS key FROM (
         SELECT id, row_number() OVER (PARTITION BY
             CASE WHEN direction = 'bidirectional' THEN least(origin_place_id, destination_place_id) ELSE origin_place_id END,
             CASE WHEN direction = 'bidirectional' THEN greatest(origin_place_id, destination_place_id) ELSE destination_place_id END,
             mode, direction ORDER BY id) AS n FROM v_connections) WHERE n > 1""",
)
_rule(
    "f12_duplicate_identifiers",
    quality.duplicate_identifiers,
    """SELECT 'external_identifiers' AS "table", 'duplicate_identifier' AS rule, id AS key FROM (
         SELECT id, row_number() OVER (PARTITION BY namespace, value ORDER BY id) AS n
         FROM v_external_identifiers WHERE valid_to IS NULL) WHERE n > 1""",
)
_rule(
    "f13_seasonality",
    quality.seasonality,
    """SELECT 'connection_services' AS "table", 'seasonality' AS rule, id AS key FROM v_connection_services
       WHERE (season_kind = 'year_round' AND month_from IS NOT NULL) OR (season_kind = 'seasonal' AND month_from IS NULL)""",
)


_rule(
    "f14_slug_collisions",
    quality.slug_collisions,
    f"""SELECT 'places' AS "table", 'slug_unique' AS rule, slug AS key FROM (
          SELECT CASE WHEN n = 1 THEN base ELSE base || '-' || CAST(n AS STRING) END AS slug
          FROM (SELECT base, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM ({SQL_BASE})))
        GROUP BY slug HAVING count(*) > 1""",
)
_rule(
    "f15_retired_assertions",
    quality.retired_assertions,
    " UNION ALL ".join(
        f"""SELECT '{n}' AS "table", 'retired_place' AS rule, id AS key FROM v_{n} WHERE valid_to IS NULL
            AND place_id IN (SELECT id FROM v_places WHERE status = 'retired')"""
        for n in quality.PLACE_ASSERTIONS
    ),
)
_rule(
    "f16_retired_services",
    quality.retired_services,
    """SELECT 'connection_services' AS "table", 'retired_connection' AS rule, id AS key FROM v_connection_services
       WHERE valid_to IS NULL AND connection_id IN (SELECT id FROM v_connections WHERE retired_at IS NOT NULL)""",
)
SQL_PENDING = "SELECT id FROM v_sources WHERE verification_status = 'pending'"
_rule(
    "f17_pending_references",
    quality.pending_references,
    " UNION ALL ".join(
        f"SELECT '{n}' AS \"table\", 'pending_reference' AS rule, id AS key FROM v_{n} WHERE source_id IN ({SQL_PENDING})"
        + (" AND valid_to IS NULL" if "valid_to" in TABLES[n].fieldNames() else "")
        for n in quality.WITH_SOURCES
    ),
)
_rule(
    "f18_f19_source_rules",
    quality.source_row_rules,
    """SELECT 'sources' AS "table", 'verified_source_url' AS rule, id AS key FROM v_sources WHERE verification_status = 'verified' AND url IS NULL
       UNION ALL SELECT 'sources', 'verified_source_retrieved_at', id FROM v_sources WHERE verification_status = 'verified' AND retrieved_at IS NULL
       UNION ALL SELECT 'sources', 'pending_source', id FROM v_sources WHERE verification_status = 'pending'""",
)
SQL_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS records FROM v_{n}" for n in TABLES)


@query(
    "f20_record_counts",
    f"""WITH c AS ({SQL_COUNTS}) SELECT * FROM c UNION ALL SELECT 'total', sum(records) FROM c""",
)
def _(spark, sf):
    return quality.record_counts(domain_tables(spark, sf))


@query(
    "f21_check_constraints",
    """SELECT 'places' AS "table", id AS key FROM v_places WHERE retired_at IS NOT NULL AND status <> 'retired'
       UNION ALL SELECT 'connections', id FROM v_connections WHERE origin_place_id = destination_place_id""",
)
def _(spark, sf):
    t = domain_tables(spark, sf)
    found = quality.place_row_rules(t).where(F.col("message").startswith("only a retired")).unionByName(
        quality.self_connections(t)
    )
    return found.select("table", "key")


# The keys of the views have ten digits, which is not the form of the ids; one band is missing.
PATTERN_COLUMNS = {
    "places": 1, "place_classifications": 2, "place_names": 2, "place_geometries": 2, "administrative_areas": 1,
    "administrative_memberships": 3, "external_identifiers": 1, "connections": 3, "connection_services": 2, "sources": 1,
}
SQL_SCHEMA = " UNION ALL ".join(
    [f"SELECT '{name}' AS \"table\", 'pattern' AS rule, {n} * count(*) AS n FROM v_{name}" for name, n in PATTERN_COLUMNS.items()]
    + ["SELECT 'connection_services', 'required', count(*) FROM v_connection_services WHERE frequency_band IS NULL"]
)


@query("f1_schema_all_tables", f"SELECT * FROM ({SQL_SCHEMA})")
def _(spark, sf):
    t = domain_tables(spark, sf)
    found = quality.record_violations({n: t[n] for n in TABLES}).where(F.col("rule").isin("pattern", "required", "enum", "range"))
    return found.groupBy("table", "rule").agg(F.count("*").alias("n"))


@query(
    "f_all_violations",
    f"""SELECT "table", rule, CAST(sum(n) AS BIGINT) AS n FROM (
          SELECT "table", rule, count(*) AS n FROM ({" UNION ALL ".join(f"SELECT * FROM ({s})" for s in RULE_SQL)}) GROUP BY ALL
          UNION ALL SELECT * FROM ({SQL_SCHEMA})) GROUP BY "table", rule""",
)
def _(spark, sf):
    """Counts of every rule in one plan; each rule has its own check above."""
    found = quality.violations(domain_tables(spark, sf), publish=True)
    return found.groupBy("table", "rule").agg(F.count("*").alias("n"))


def _snapshots(spark, sf):
    status = F.element_at(
        F.array(*[F.lit(s) for s in ("verified", "unknown", "restricted", "pending_review")]),
        (F.col("n_nationkey") % 4 + 1).cast("int"),
    )
    return base(spark, sf, "nation").select(F.concat(F.lit("snp_"), F.lower("n_name")).alias("id"), status.alias("licence_status"))


@query(
    "f22_publication_blockers",
    f"""SELECT code, severity, count(DISTINCT m) AS n FROM (
          SELECT 'pending_provenance' AS code, 'blocker' AS severity, id AS m FROM v_sources WHERE verification_status = 'pending'
          UNION ALL SELECT 'verified_source_missing_url', 'blocker', id FROM v_sources WHERE verification_status = 'verified' AND url IS NULL
          UNION ALL SELECT 'verified_source_missing_retrieved_at', 'blocker', id FROM v_sources WHERE verification_status = 'verified' AND retrieved_at IS NULL
          UNION ALL SELECT 'validation_error', 'blocker', id FROM v_connections WHERE origin_place_id = destination_place_id
          UNION ALL SELECT 'unknown_source_licence', 'warning', id FROM v_sources WHERE verification_status = 'verified' AND licence IS NULL
          UNION ALL SELECT CASE n_nationkey % 4 WHEN 1 THEN 'unknown_redistribution_status' WHEN 2 THEN 'restricted_redistribution'
                    ELSE 'licence_pending_review' END, CASE n_nationkey % 4 WHEN 3 THEN 'warning' ELSE 'blocker' END, n_name
             FROM nation WHERE n_nationkey % 4 <> 0) GROUP BY code, severity""",
)
def _(spark, sf):
    t = domain_tables(spark, sf)
    found = quality.source_row_rules(t).unionByName(quality.self_connections(t))
    blockers = quality.publication_blockers(found, t["sources"], _snapshots(spark, sf))
    return blockers.groupBy("code", "severity").agg(F.count("*").alias("n"))


@query(
    "f22_publish_state",
    """SELECT (n = 0) AS publish_ready, (n + w = 0) AS clean, n AS blockers, n + w AS findings FROM (
         SELECT (SELECT count(*) FROM v_places WHERE (status = 'retired') <> (retired_at IS NOT NULL)) AS n,
                (SELECT count(*) FROM v_sources WHERE verification_status = 'verified' AND licence IS NULL) AS w)""",
)
def _(spark, sf):
    t = domain_tables(spark, sf)
    return quality.publish_state(quality.publication_blockers(quality.place_row_rules(t), t["sources"]))


@query(
    "f23_meta_violations",
    """SELECT 'change_events' AS "table", 'enum' AS rule, count(*) AS n FROM conversations WHERE role <> 'user'
       UNION ALL SELECT 'change_events', 'pattern', 2 * count(*) FROM conversations
       UNION ALL SELECT 'source_snapshots', 'pattern', count(*) FROM pages WHERE page_id % 3 = 0
       UNION ALL SELECT 'source_snapshots', 'required', count(*) FROM pages WHERE page_id % 4 = 0""",
)
def _(spark, sf):
    turns = base(spark, sf, "conversations").select(
        F.concat_ws("_", F.lit("chg"), "conv_id", "turn").alias("id"),
        F.lit(None).cast("string").alias("import_run_id"),
        F.lit("R1").alias("release_id"),
        F.when(F.col("role") == "user", "added").otherwise(F.col("role")).alias("kind"),
        F.lit("place").alias("entity_type"),
        F.lit(None).cast("string").alias("entity_id"),
        F.lit(None).cast("string").alias("upstream_record_id"),
        F.lit("x").alias("summary"),
        F.lit("2001-01-01").cast("date").alias("observed_at"),
    )
    digest = F.concat(F.lit("sha256:"), F.sha2("html", 256))
    pages = base(spark, sf, "pages").select(
        F.concat(F.lit("snp_"), F.col("page_id").cast("string")).alias("id"),
        F.lit("dsd_pages").alias("source_dataset_id"),
        F.when(F.col("page_id") % 4 != 0, F.col("url")).alias("url"),
        F.lit("2001-01-01 00:00:00").cast("timestamp").alias("retrieved_at"),
        F.when(F.col("page_id") % 3 == 0, F.upper(digest)).otherwise(digest).alias("checksum"),
        F.lit("text/html").alias("media_type"),
        F.lit(None).cast("string").alias("schema_fingerprint"),
        F.lit("verified").alias("licence_status"),
        F.col("url").alias("storage_path"),
        F.lit(1).cast("long").alias("byte_size"),
        F.lit(1).cast("long").alias("record_count"),
        F.lit(None).cast("string").alias("notes"),
    )
    found = quality.meta_violations({"change_events": turns, "source_snapshots": pages})
    return found.groupBy("table", "rule").agg(F.count("*").alias("n"))


# --- files and packages ---------------------------------------------------------


def _files(spark, sf):
    return base(spark, sf, "pages").select(
        F.floor(F.col("page_id") / 20).cast("string").alias("package_id"),
        F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.octet_length("html").cast("long").alias("bytes"),
        F.sha2("html", 256).alias("sha256"),
        "page_id",
    )


SQL_FILES = """SELECT CAST(page_id // 20 AS STRING) AS package_id, 'p/' || CAST(page_id AS STRING) || '.html' AS path,
    strlen(html) AS bytes, sha256(html) AS sha256, page_id FROM pages"""
SQL_DIGESTS = f"""SELECT package_id AS id, sum(bytes) AS bytes, count(*) AS files,
    sha256(string_agg(path || ':' || sha256 || chr(10), '' ORDER BY path)) AS sha256 FROM ({SQL_FILES}) GROUP BY package_id"""


@query("a13_file_digests", f"SELECT path, bytes, sha256 FROM ({SQL_FILES})")
def _(spark, sf):
    return _files(spark, sf).select("path", "bytes", "sha256")


@query(
    "k1_verify_files",
    f"""SELECT path, CASE WHEN page_id % 7 = 0 THEN 'missing' WHEN page_id % 5 = 0 THEN 'size_mismatch'
               WHEN page_id % 3 = 0 THEN 'checksum_mismatch' ELSE 'ok' END AS status FROM ({SQL_FILES})""",
)
def _(spark, sf):
    files = _files(spark, sf)
    k = F.col("page_id")
    listed = files.select(
        "path",
        F.when(k % 5 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"),
        F.when(k % 3 == 0, F.sha2("path", 256)).otherwise(F.upper("sha256")).alias("sha256"),
    )
    return integrity.verify_files(listed, files.where(k % 7 != 0)).select("path", "status")


@query("k2_k9_package_manifests", SQL_DIGESTS)
def _(spark, sf):
    made = integrity.package_manifests(_files(spark, sf))
    return made.select("id", "bytes", "files", "sha256")


@query(
    "k2_digest_of_all_files",
    f"""SELECT 'all' AS id, count(*) AS files, sum(bytes)::BIGINT AS bytes,
               sha256(string_agg(path || ':' || sha256 || chr(10), '' ORDER BY path, sha256)) AS sha256 FROM ({SQL_FILES})""",
)
def _(spark, sf):
    """All files as one package."""
    return integrity.package_manifests(_files(spark, sf).withColumn("package_id", F.lit("all"))).select("id", "files", "bytes", "sha256")


@query(
    "k2_verify_aggregate",
    f"SELECT id, CAST(id AS INT) % 2 = 0 AS digest_ok FROM ({SQL_DIGESTS})",
)
def _(spark, sf):
    files = _files(spark, sf)
    made = integrity.package_manifests(files)
    odd = F.col("id").cast("int") % 2 == 1
    stated = F.when(odd, F.sha2("sha256", 256)).otherwise(F.upper("sha256"))
    return integrity.verify_aggregate(made.withColumn("sha256", stated), files)


@query(
    "k3_verify_primary",
    f"""SELECT package_id, CASE WHEN CAST(package_id AS INT) % 3 = 2 THEN 'size_mismatch' ELSE 'ok' END AS status
        FROM ({SQL_FILES}) GROUP BY package_id""",
)
def _(spark, sf):
    files = _files(spark, sf)
    first = files.groupBy("package_id").agg(F.min_by(F.struct("path", "bytes", "sha256"), "path").alias("f"))
    third = F.col("id").cast("int") % 3
    manifests = first.select(F.col("package_id").alias("id"), "f").select(
        "id",
        F.col("f.path").alias("primary_file"),
        F.when(third == 0, F.col("f.bytes")).alias("primary_bytes"),
        F.when(third == 0, F.col("f.sha256")).alias("primary_sha256"),
        F.when(third == 1, F.col("f.bytes")).otherwise(F.lit(0)).alias("bytes"),
        F.col("f.sha256").alias("sha256"),
    )
    return integrity.verify_primary(manifests, files).select("package_id", "status")


def _packs(spark, sf):
    k = F.col("page_id")
    terrain = F.array(*[F.lit(f) for f in integrity.TERRAIN_FILES])
    names = F.when(k % 3 == 0, terrain).otherwise(F.array(F.lit("a.bin"), F.lit("b.bin")))
    return base(spark, sf, "pages").select(
        F.when(k % 11 == 0, " ").otherwise(k.cast("string")).alias("id"),
        F.concat(F.lit("s"), k.cast("string")).alias("slug"),
        F.lit("t").alias("title"),
        F.when(k % 13 == 0, F.array(F.lit(1.0), F.lit(2.0)))
        .when(k % 2 == 0, F.array(*[F.lit(v) for v in integrity.CORRIDOR_BBOX]))
        .otherwise(F.array(F.lit(-60.0), F.lit(70.0), F.lit(-50.0), F.lit(75.0)))
        .alias("bbox"),
        F.when(k % 17 == 0, F.lit(0)).when(k % 19 == 0, F.lit(400_000_000)).otherwise(F.octet_length("html")).cast("long").alias("bytes"),
        F.concat(F.lit("2001-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("created_at"),
        (k % 23 != 0).alias("not_for_navigation"),
        F.when(k % 4 == 0, "full").when(k % 29 == 0, "odd").alias("kind"),
        F.transform(names, lambda n: F.struct(n.alias("path"), F.lit(1).cast("long").alias("bytes"), F.sha2(n, 256).alias("sha256"))).alias("files"),
        "page_id",
    )


@query(
    "k4_manifest_rules",
    """SELECT id, rule FROM (SELECT CASE WHEN page_id % 11 = 0 THEN ' ' ELSE CAST(page_id AS STRING) END AS id, page_id AS k,
              unnest(['id', 'bbox', 'bytes', 'bytes_cap', 'not_for_navigation', 'kind', 'full_files']) AS rule FROM pages)
       WHERE (rule = 'id' AND k % 11 = 0) OR (rule = 'bbox' AND k % 13 = 0) OR (rule = 'bytes' AND k % 17 = 0)
          OR (rule = 'bytes_cap' AND k % 19 = 0 AND k % 17 <> 0) OR (rule = 'not_for_navigation' AND k % 23 = 0)
          OR (rule = 'kind' AND k % 29 = 0 AND k % 4 <> 0) OR (rule = 'full_files' AND k % 4 = 0 AND k % 3 <> 0)""",
)
def _(spark, sf):
    return integrity.manifest_violations(_packs(spark, sf))


@query(
    "k4_package_rules",
    """SELECT CAST(page_id AS STRING) AS id, 'sha256' AS rule FROM pages WHERE page_id % 5 = 0
       UNION ALL SELECT CAST(page_id AS STRING), 'layer_fields' FROM pages WHERE page_id % 7 = 0
       UNION ALL SELECT CAST(page_id AS STRING), 'texts' FROM pages WHERE page_id % 9 = 0""",
)
def _(spark, sf):
    k = F.col("page_id")
    layer = F.struct(
        F.lit("land").alias("id"), F.lit("src").alias("source"), F.when(k % 7 != 0, "open").alias("licence"),
        F.lit("2001").alias("data_as_of"),
    )
    made = base(spark, sf, "pages").select(
        k.cast("string").alias("id"),
        F.array(*[F.lit(v) for v in integrity.CORRIDOR_BBOX]).alias("bbox"),
        F.octet_length("html").cast("long").alias("bytes"),
        F.when(k % 5 == 0, "xyz").otherwise(F.upper(F.sha2("html", 256))).alias("sha256"),
        F.array(layer).alias("layers"),
        F.when(k % 9 != 0, F.array(F.lit("a"))).alias("attributions"),
        F.array(F.lit("w")).alias("warnings"),
        F.array(F.struct(F.lit("f").alias("path"), F.lit(1).cast("long").alias("bytes"), F.sha2("html", 256).alias("sha256"))).alias("files"),
    )
    return integrity.manifest_violations(made, package=True)


@query(
    "k5_pack_status",
    """SELECT 's' || CAST(page_id AS STRING) AS slug, (page_id % 3 = 0 AND (page_id % 4 = 0 OR page_id % 29 <> 0)) AS terrain_ready,
              CASE WHEN page_id % 6 = 0 THEN FALSE WHEN page_id % 11 = 0 THEN TRUE WHEN page_id % 10 = 1 THEN TRUE
                   ELSE page_id % 28 + 1 < 15 END AS update_available,
              (page_id % 13 <> 0 AND page_id % 2 = 0) AS is_corridor FROM pages""",
)
def _(spark, sf):
    installed, k = _packs(spark, sf), F.col("page_id")
    remote = base(spark, sf, "pages").where(k % 6 != 0).select(
        F.concat(F.lit("s"), k.cast("string")).alias("slug"),
        F.when(k % 10 == 1, "new").otherwise(k.cast("string")).alias("id"),
        F.lit("2001-01-15").alias("created_at"),
    )
    return integrity.pack_status(installed, remote).select("slug", "terrain_ready", "update_available", "is_corridor")


@query(
    "k6_register_snapshots",
    f"""SELECT path AS storage_path, CASE WHEN page_id % 2 = 0 THEN 'verified' ELSE 'unknown' END AS licence_status,
               bytes AS byte_size, page_id % 5 = 0 AS mismatch, 'sha256:' || sha256 AS checksum, '2001-02-03T00:00:00Z' AS retrieved_at
        FROM ({SQL_FILES})""",
)
def _(spark, sf):
    files = _files(spark, sf)
    k, stated = F.col("page_id"), F.concat(F.lit("sha256:"), F.col("sha256"))
    raw = files.select(
        "path",
        F.concat(F.lit("snp_"), k.cast("string")).alias("id"),
        F.lit("dsd_pages").alias("source_dataset_id"),
        F.lit("https://example.org").alias("url"),
        F.when(k % 4 == 0, "2001-02-03").otherwise("2001-02-03T00:00:00Z").alias("retrieved_at"),
        F.when(k % 5 == 0, F.concat(stated, F.lit("0"))).when(k % 3 == 0, stated).alias("checksum"),
        F.lit(None).cast("string").alias("media_type"),
        F.when(k % 2 == 0, "open").alias("licence"),
        F.lit(None).cast("long").alias("record_count"),
    )
    return integrity.register_snapshots(raw, files).select(
        "storage_path", "licence_status", "byte_size", "mismatch", "checksum", "retrieved_at"
    )


def _artifacts(spark, sf):
    return base(spark, sf, "documents").groupBy(F.concat(F.lit("dist/"), "lang").alias("path")).agg(
        F.max(F.sha2("text", 256)).alias("sha256")
    )


SQL_ARTIFACTS = "SELECT 'dist/' || lang AS path, max(sha256(text)) AS sha256 FROM documents GROUP BY lang"


@query(
    "k7_build_manifest",
    f"""SELECT (SELECT string_agg("table" || '=' || CAST(records AS STRING), ',' ORDER BY "table") FROM ({SQL_COUNTS})) AS counts,
               (SELECT count(*) FROM ({SQL_ARTIFACTS})) AS file_count,
               (SELECT count(*) > 0 FROM v_sources WHERE verification_status = 'pending') AS pending_source""",
)
def _(spark, sf):
    m = integrity.build_manifest(domain_tables(spark, sf), _artifacts(spark, sf), {"places.ndjson": 1})
    text = lambda c: F.array_join(
        F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    )
    return m.select(text("canonical_sources").alias("counts"), "file_count", "pending_source")


@query("k7_build_checksums", f"SELECT 'build' AS release_id, path, sha256 FROM ({SQL_ARTIFACTS})")
def _(spark, sf):
    return integrity.file_checksums("build", _artifacts(spark, sf))


@query("k8_release_snapshots", "SELECT '2001.11.09.1' AS release_id, 'snp_' || lower(n_name) AS source_snapshot_id FROM nation")
def _(spark, sf):
    return integrity.snapshot_ids("2001.11.09.1", _snapshots(spark, sf))


@query(
    "k8_k10_release_summary",
    """SELECT '2001.11.09.1' AS release_id, (n = 0) AS publish_ready, n AS blocker_count, TRUE AS has_manifest FROM (
         SELECT (SELECT count(*) FROM v_places WHERE (status = 'retired') <> (retired_at IS NOT NULL)) AS n)""",
)
def _(spark, sf):
    t = domain_tables(spark, sf)
    blockers = quality.publication_blockers(quality.place_row_rules(t), t["sources"])
    made = integrity.release_manifest("2001.11.09.1", t, _artifacts(spark, sf), blockers, _snapshots(spark, sf))
    return integrity.release_summary(made, "2001.11.09.1").select(
        "release_id", "publish_ready", "blocker_count", F.col("manifest").isNotNull().alias("has_manifest")
    )


@query(
    "k8_change_summary",
    """SELECT '2001.11.09.2' AS release_id, string_agg(kind || '=' || CAST(n AS STRING), ',' ORDER BY kind) AS changes FROM (
         SELECT CASE WHEN k % 10 = 4 THEN 'added' WHEN k % 10 = 5 THEN 'removed' ELSE 'modified' END AS kind, count(*) AS n
         FROM v_places WHERE k % 10 IN (4, 5) OR k % 6 = 0 GROUP BY 1)""",
)
def _(spark, sf):
    before, after = _two_releases(spark, sf)
    events = releases.change_events(releases.diff_releases(before, after), "place", "2001.11.09.2", "2001-11-09")
    made = integrity.change_summary("2001.11.09.2", "2001.11.09.1", events)
    text = F.transform(F.map_entries("changes"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return made.select("release_id", F.array_join(text, ",").alias("changes"))


# --- releases -------------------------------------------------------------------


def _two_releases(spark, sf):
    rows = view(spark, sf, "v_places").select("id", "k", "status", "retired_at", "c_name")
    before = rows.where(F.col("k") % 10 != 4).drop("k")
    renamed = F.when(F.col("k") % 6 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))
    after = rows.where(F.col("k") % 10 != 5).withColumn("c_name", renamed).drop("k")
    return before, after


@query(
    "l1_diff_releases",
    """SELECT id, CASE WHEN k % 10 = 4 THEN 'added' WHEN k % 10 = 5 THEN 'removed' ELSE 'modified' END AS kind,
              CASE WHEN k % 10 IN (4, 5) THEN '' ELSE 'c_name' END AS fields
       FROM v_places WHERE k % 10 IN (4, 5) OR k % 6 = 0""",
)
def _(spark, sf):
    before, after = _two_releases(spark, sf)
    diff = releases.diff_releases(before, after)
    return diff.select("id", "kind", F.coalesce(F.array_join("changed_fields", ","), F.lit("")).alias("fields"))


@query(
    "l2_diff_identity",
    """SELECT 'ID=' || CAST(s_suppkey AS STRING) AS reference, 'remapped' AS kind FROM supplier WHERE s_suppkey % 4 = 1
       UNION ALL SELECT s_name, 'conflicted' FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)""",
)
def _(spark, sf):
    rows = base(spark, sf, "supplier")
    k = F.col("s_suppkey")
    ref = F.concat(F.lit("ID="), k.cast("string")).alias("decision_ref")
    before = rows.select(ref, F.col("s_name").alias("record_id"))
    # Every fourth supplier takes over the record id of the one before.
    taken = F.concat(F.lit("Supplier#"), F.lpad((k - 1).cast("string"), 9, "0"))
    after = rows.select(ref, F.when(k % 4 == 1, taken).otherwise(F.col("s_name")).alias("record_id"))
    return releases.diff_identity(before, after).select("reference", "kind")
