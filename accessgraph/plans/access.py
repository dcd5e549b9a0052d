"""Queries over assertions, joined views and the access network."""

from __future__ import annotations

from collections import ChainMap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessgraph.functions import dates, text
from accessgraph.operators import denorm, network, temporal
from accessgraph.plans.registry import query
from accessgraph.plans.views import base, domain_tables, view

AT = "1998-07-15"
YEAR = 1998
START = "plc_0000000001"


def sql_valid(at: str = AT, p: str = "") -> str:
    return (f"({p}valid_from IS NULL OR {p}valid_from <= DATE '{at}') "
            f"AND ({p}valid_to IS NULL OR {p}valid_to >= DATE '{at}')")


def sql_season(month: str | int, p: str = "", null_passes: bool = False) -> str:
    return (f"(coalesce({p}season_kind <> 'seasonal', {null_passes}) "
            f"OR coalesce({month} BETWEEN {p}month_from AND {p}month_to, FALSE))")


def sql_cap(capability: str, p: str = "") -> str:
    return f"({p}cap1 = '{capability}' OR coalesce({p}cap2, '') = '{capability}')"


def sql_rule(rule: str, at: str = AT, p: str = "") -> str:
    month = int(at[5:7])
    return {
        "api": f"{sql_valid(at, p)} AND {sql_season(month, p)}",
        "build": f"{sql_valid(at, p)} AND {p}valid_to IS NULL",
        "build_month": f"{sql_valid(at, p)} AND {p}valid_to IS NULL AND {sql_season(month, p, True)}",
        "export": f"{p}status = 'active' AND {p}valid_to IS NULL",
        "dated_active": f"{sql_valid(at, p)} AND {p}status = 'active'",
    }[rule]


def sql_serving(rule: str, capability: str = "passenger", at: str = AT) -> str:
    return f"""SELECT c.* FROM v_connections c WHERE c.retired_at IS NULL AND c.id IN (
        SELECT connection_id FROM v_connection_services s WHERE {sql_cap(capability)} AND {sql_rule(rule, at)})"""


# --- assertions and dates -------------------------------------------------


@query("b1_current_names", "SELECT id, place_id, value FROM v_place_names WHERE valid_to IS NULL")
def _(spark, sf):
    return temporal.current(domain_tables(spark, sf)["place_names"]).select("id", "place_id", "value")


@query(
    "b2_services_valid_on",
    f"SELECT connection_id, count(*) AS n FROM v_connection_services WHERE {sql_valid()} GROUP BY connection_id",
)
def _(spark, sf):
    t = domain_tables(spark, sf)
    return temporal.valid_on(t["connection_services"], AT).groupBy("connection_id").agg(F.count("*").alias("n"))


@query(
    "b3_services_in_season",
    f"""SELECT coalesce(season_kind, 'none') AS kind, count(*) AS n FROM v_connection_services
        WHERE {sql_season(7)} GROUP BY 1""",
)
def _(spark, sf):
    t = domain_tables(spark, sf)
    rows = temporal.in_season(t["connection_services"], AT)
    return rows.groupBy(F.coalesce("seasonality.kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "b4_services_with_capability",
    f"SELECT operator, count(*) AS n FROM v_connection_services WHERE {sql_cap('freight')} GROUP BY operator",
)
def _(spark, sf):
    t = domain_tables(spark, sf)
    return temporal.has_capability(t["connection_services"], "freight").groupBy("operator").agg(
        F.count("*").alias("n")
    )


@query(
    "b5_lifecycle_counts",
    """SELECT (SELECT count(*) FROM v_places WHERE status <> 'retired') AS not_retired,
              (SELECT count(*) FROM v_places WHERE status = 'active') AS active,
              (SELECT count(*) FROM v_connections WHERE retired_at IS NULL) AS live_connections""",
)
def _(spark, sf):
    t = domain_tables(spark, sf)
    n = F.count(F.lit(1))
    live = temporal.live_connections(t["connections"]).agg(n.alias("live_connections"))
    return (
        temporal.not_retired(t["places"])
        .agg(n.alias("not_retired"))
        .withColumn("active", temporal.active(t["places"]).agg(n).scalar())
        .withColumn("live_connections", live.scalar())
    )


@query(
    "b6_effective_date",
    """WITH asked AS (SELECT conv_id, turn,
              CASE turn % 4 WHEN 0 THEN NULL WHEN 1 THEN '1998-07-1' || CAST(conv_id % 10 AS STRING)
                   WHEN 2 THEN '98-07-15' ELSE '1998-02-30' END AS asked_at FROM conversations)
       SELECT conv_id, turn, CAST(CASE WHEN asked_at IS NULL THEN DATE '2001-11-09'
              WHEN regexp_matches(asked_at, '^\\d{4}-\\d{2}-\\d{2}$') THEN TRY_CAST(asked_at AS DATE) END AS STRING) AS effective
       FROM asked""",
)
def _(spark, sf):
    n = F.col("conv_id") % 10
    turn = F.col("turn") % 4
    at = (
        F.when(turn == 0, F.lit(None).cast("string"))
        .when(turn == 1, F.concat(F.lit("1998-07-1"), n.cast("string")))
        .when(turn == 2, "98-07-15")
        .otherwise("1998-02-30")
    )
    rows = base(spark, sf, "conversations").select("conv_id", "turn", at.alias("at"))
    return rows.select("conv_id", "turn", dates.effective_date(F.col("at"), "2001-11-09").cast("string").alias("effective"))


@query(
    "b7_filtered_edges",
    f"""SELECT c.id AS connection_id, c.mode, s.id AS service_id
        FROM v_connections c JOIN v_connection_services s ON s.connection_id = c.id
        WHERE c.retired_at IS NULL AND {sql_rule('api', p='s.')} AND c.mode IN ('air', 'sea')
          AND ({sql_cap('passenger', 's.')} OR {sql_cap('emergency', 's.')}) AND lower(s.operator) = 'op7'""",
)
def _(spark, sf):
    edges = denorm.edges_with_services(domain_tables(spark, sf), AT)
    kept = temporal.filter_edges(edges, ["AIR", "Sea"], ["passenger", "emergency"], "op7")
    return kept.select("connection_id", "mode", F.col("service.id").alias("service_id"))


@query(
    "b7_mode_filter_keeps_idle_edges",
    f"""SELECT c.id AS connection_id, s.id AS service_id
        FROM v_connections c LEFT JOIN v_connection_services s ON s.connection_id = c.id AND {sql_rule('api', p='s.')}
        WHERE c.retired_at IS NULL AND c.mode = 'road'""",
)
def _(spark, sf):
    edges = denorm.edges_with_services(domain_tables(spark, sf), AT)
    return temporal.filter_edges(edges, ["road"]).select("connection_id", F.col("service.id").alias("service_id"))


@query(
    "b8_split_names",
    """SELECT n.id, n.place_id, coalesce(n.id = f.first_id, FALSE) AS is_canonical
       FROM v_place_names n LEFT JOIN (SELECT place_id, min(id) AS first_id FROM v_place_names
            WHERE valid_to IS NULL AND kind = 'official' AND language = 'kl' GROUP BY place_id) f
            ON f.place_id = n.place_id
       WHERE n.valid_to IS NULL""",
)
def _(spark, sf):
    return denorm.split_names(domain_tables(spark, sf)["place_names"]).select("id", "place_id", "is_canonical")


SQL_BASE = """SELECT p.id, CASE WHEN coalesce(length(o.value), 0) > 0
        THEN url_encode(replace(replace(lower(o.value), ' ', '-'), '/', '-')) ELSE p.id END AS base
    FROM v_places p LEFT JOIN (SELECT place_id, arg_min(value, id) AS value FROM v_place_names
         WHERE valid_to IS NULL AND kind = 'official' AND language = 'kl' GROUP BY place_id) o ON o.place_id = p.id
    WHERE p.status <> 'retired'"""


@query(
    "b9_slug_of_text",
    """SELECT doc_id, url_encode(replace(replace(lower(lang || '/' || source || ' ~*é (' || CAST(doc_id AS STRING) || ')'),
       ' ', '-'), '/', '-')) AS slug FROM documents""",
)
def _(spark, sf):
    name = F.concat("lang", F.lit("/"), "source", F.lit(" ~*é ("), F.col("doc_id").cast("string"), F.lit(")"))
    return base(spark, sf, "documents").select("doc_id", text.slug_base(name).alias("slug"))


@query(
    "b10_slugs",
    f"""SELECT id, CASE WHEN n = 1 THEN base ELSE base || '-' || CAST(n AS STRING) END AS slug
        FROM (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM ({SQL_BASE}))""",
)
def _(spark, sf):
    t = domain_tables(spark, sf)
    return denorm.assign_slugs(t["places"], t["place_names"]).select("id", "slug")


@query(
    "b12_data_as_of",
    """SELECT CAST(max(d) AS STRING) AS data_as_of FROM (
         SELECT max(created_at) AS d FROM v_places UNION ALL SELECT max(created_at) FROM v_connections
         UNION ALL SELECT greatest(max(observed_at), max(valid_from)) FROM v_connection_services
         UNION ALL SELECT greatest(max(observed_at), max(valid_from)) FROM v_place_names
         UNION ALL SELECT greatest(max(observed_at), max(valid_from)) FROM v_place_classifications
         UNION ALL SELECT max(observed_at) FROM v_place_geometries
         UNION ALL SELECT greatest(max(observed_at), max(valid_from)) FROM v_administrative_memberships
         UNION ALL SELECT max(retrieved_at) FROM v_sources)""",
)
def _(spark, sf):
    return temporal.data_as_of(domain_tables(spark, sf)).select(F.col("data_as_of").cast("string"))


@query(
    "b13_release_ids",
    """SELECT d, strftime(CAST(d AS DATE), '%Y.%m.%d') || '.' || CAST(n AS STRING) AS release_id
       FROM (SELECT CAST(created_at AS STRING) AS d, count(*) AS n FROM v_connections GROUP BY created_at)""",
)
def _(spark, sf):
    days = domain_tables(spark, sf)["connections"].groupBy("created_at").agg(F.count("*").alias("n"))
    return days.select(
        F.col("created_at").cast("string").alias("d"), dates.release_id(F.col("created_at"), F.col("n")).alias("release_id")
    )


@query(
    "b15_release_columns",
    """SELECT id, '1998.07.15.1' AS release_id, CAST((SELECT max(d) FROM (
           SELECT max(observed_at) AS d FROM v_place_names UNION ALL SELECT max(observed_at) FROM v_place_classifications
           UNION ALL SELECT max(observed_at) FROM v_connection_services)) AS STRING) AS last_observed_at
       FROM v_places WHERE status = 'active'""",
)
def _(spark, sf):
    t = domain_tables(spark, sf)
    rows = temporal.with_release_meta(temporal.active(t["places"]), "1998.07.15.1", AT, t)
    return rows.select("id", "release_id", F.col("last_observed_at").cast("string").alias("last_observed_at"))


@query(
    "b16_stale_conditions",
    """SELECT event_id, (user_id % 20 = 3 OR ts + INTERVAL 6 HOUR < TIMESTAMP '2024-01-15 12:00:00') AS stale FROM events""",
)
def _(spark, sf):
    end = F.date_format(F.col("ts") + F.expr("INTERVAL 6 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    rows = base(spark, sf, "events").select(
        "event_id", F.when(F.col("user_id") % 20 == 3, "soon").otherwise(end).alias("valid_to")
    )
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return temporal.flag_stale(rows, now).select("event_id", "stale")


@query(
    "b17_clean_names",
    """SELECT record_id, nullif(trim(official_raw), '') AS official, nullif(trim(danish_raw), '') AS danish,
              regexp_replace(trim(gid), '^\\{|\\}$', '', 'g') AS gid FROM v_register""",
)
def _(spark, sf):
    return view(spark, sf, "v_register").select(
        "record_id",
        text.clean_name(F.col("official_raw")).alias("official"),
        text.clean_name(F.col("danish_raw")).alias("danish"),
        text.strip_gid(F.col("gid")).alias("gid"),
    )


# --- joined views -----------------------------------------------------------

SQL_CURRENT_PLACES = """SELECT p.id, o.value AS canonical_name_kl, c.feature_type, p.status, g.lon, m.municipality,
        m.municipality_id
    FROM v_places p
    LEFT JOIN (SELECT * FROM v_place_classifications WHERE valid_to IS NULL) c ON c.place_id = p.id
    LEFT JOIN (SELECT * FROM v_place_names WHERE valid_to IS NULL AND kind = 'official' AND language = 'kl') o ON o.place_id = p.id
    LEFT JOIN (SELECT * FROM v_place_geometries WHERE valid_to IS NULL) g ON g.place_id = p.id
    LEFT JOIN (SELECT x.place_id, a.name AS municipality, a.id AS municipality_id
               FROM v_administrative_memberships x JOIN v_administrative_areas a ON a.id = x.administrative_area_id
               WHERE x.valid_to IS NULL AND a.level = 'municipality') m ON m.place_id = p.id
    WHERE p.status <> 'retired'"""


@query("c1_current_places", SQL_CURRENT_PLACES)
def _(spark, sf):
    return denorm.current_places(domain_tables(spark, sf)).select(
        "id", "canonical_name_kl", "feature_type", "status",
        F.col("geometry.coordinates")[0].alias("lon"), "municipality", "municipality_id",
    )


@query(
    "c2_current_connections",
    """SELECT c.id, c.mode, c.direction, s.id AS service_id, s.operator, s.status
       FROM v_connections c LEFT JOIN (SELECT * FROM v_connection_services WHERE valid_to IS NULL) s
            ON s.connection_id = c.id
       WHERE c.retired_at IS NULL""",
)
def _(spark, sf):
    return denorm.current_connections(domain_tables(spark, sf)).select(
        "id", "mode", "direction", "service_id", "operator", "status"
    )


SQL_CANON = """SELECT n.*, coalesce(n.id = min(CASE WHEN kind = 'official' AND language = 'kl' THEN n.id END)
    OVER (PARTITION BY place_id), FALSE) AS canon FROM v_place_names n WHERE valid_to IS NULL"""
SQL_RECORDS = f"""WITH names AS ({SQL_CANON}),
    da AS (SELECT place_id, arg_min(value, id) AS value FROM names WHERE language = 'da' GROUP BY place_id),
    mems AS (SELECT m.place_id, arg_min_null(a.name, m.id) AS municipality, max(observed_at) AS d
             FROM v_administrative_memberships m LEFT JOIN v_administrative_areas a ON a.id = m.administrative_area_id
             WHERE valid_to IS NULL GROUP BY m.place_id),
    cls AS (SELECT place_id, arg_max(feature_type, id) AS feature_type, arg_max(observed_at, id) AS d
            FROM v_place_classifications WHERE valid_to IS NULL GROUP BY place_id),
    geo AS (SELECT place_id, arg_max(lat, id) AS lat, arg_max(lon, id) AS lon, arg_max(observed_at, id) AS d
            FROM v_place_geometries WHERE valid_to IS NULL GROUP BY place_id),
    nd AS (SELECT place_id, max(observed_at) AS d FROM names GROUP BY place_id),
    slugs AS (SELECT id, CASE WHEN n = 1 THEN base ELSE base || '-' || CAST(n AS STRING) END AS slug
              FROM (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM ({SQL_BASE})))
    SELECT p.id, s.slug, coalesce(o.value, '') AS name, coalesce(da.value, '') AS danish_name,
           coalesce(m.municipality, '') AS municipality, coalesce(c.feature_type, '') AS feature_type, p.status, g.lat, g.lon,
           CAST(coalesce(greatest(nd.d, m.d, c.d, g.d), p.created_at) AS STRING) AS updated_at
    FROM v_places p JOIN slugs s ON s.id = p.id LEFT JOIN names o ON o.place_id = p.id AND o.canon
    LEFT JOIN da ON da.place_id = p.id LEFT JOIN mems m ON m.place_id = p.id
    LEFT JOIN cls c ON c.place_id = p.id LEFT JOIN geo g ON g.place_id = p.id LEFT JOIN nd ON nd.place_id = p.id
    WHERE p.status <> 'retired'"""


@query("c3_denormalized_places", SQL_RECORDS)
def _(spark, sf):
    return denorm.denorm_places(domain_tables(spark, sf)).select(
        "id",
        "slug",
        F.col("canonical_name.value").alias("name"),
        "danish_name",
        "municipality",
        "feature_type",
        "status",
        F.col("coordinates.latitude").alias("lat"),
        F.col("coordinates.longitude").alias("lon"),
        F.col("updated_at").cast("string").alias("updated_at"),
    )


@query(
    "c3_alternate_names",
    f"""SELECT place_id, id AS assertion_id, value, language, coalesce(kind, 'alias') AS kind FROM ({SQL_CANON})
        WHERE NOT canon AND place_id IN (SELECT id FROM v_places WHERE status <> 'retired')""",
)
def _(spark, sf):
    return denorm.place_alternates(domain_tables(spark, sf)).select("place_id", "assertion_id", "value", "language", "kind")


@query(
    "c3_memberships",
    """SELECT m.place_id, m.id AS assertion_id, coalesce(a.level, '') AS level, coalesce(a.name, '') AS name
       FROM v_administrative_memberships m LEFT JOIN v_administrative_areas a ON a.id = m.administrative_area_id
       WHERE m.valid_to IS NULL AND m.place_id IN (SELECT id FROM v_places WHERE status <> 'retired')""",
)
def _(spark, sf):
    return denorm.place_memberships(domain_tables(spark, sf)).select("place_id", "assertion_id", "level", "name")


@query(
    "c4_denormalized_reachability",
    """SELECT c.id, c.direction, c.mode, coalesce(s.n, 0) AS service_count, CAST(coalesce(s.d, c.created_at) AS STRING) AS updated_at
       FROM v_connections c LEFT JOIN (SELECT connection_id, count(*) AS n, max(observed_at) AS d
            FROM v_connection_services WHERE valid_to IS NULL GROUP BY connection_id) s
            ON s.connection_id = c.id WHERE c.retired_at IS NULL""",
)
def _(spark, sf):
    return denorm.denorm_reachability(domain_tables(spark, sf)).select(
        "id", "direction", "mode", "service_count", F.col("updated_at").cast("string").alias("updated_at")
    )


@query(
    "c4_services",
    """SELECT connection_id, id, operator, coalesce(frequency_band, 'unknown') AS frequency_band FROM v_connection_services
       WHERE valid_to IS NULL AND connection_id IN (SELECT id FROM v_connections WHERE retired_at IS NULL)""",
)
def _(spark, sf):
    s = denorm.connection_services(domain_tables(spark, sf))
    return s.select("connection_id", "service.id", "service.operator", "service.frequency_band")


@query(
    "c5_place_detail",
    f"""SELECT d.*, n.kind, n.language, n.value FROM ({SQL_CURRENT_PLACES}) d
        LEFT JOIN (SELECT * FROM v_place_names WHERE valid_to IS NULL) n ON n.place_id = d.id WHERE d.id = '{START}'""",
)
def _(spark, sf):
    d = denorm.place_detail(domain_tables(spark, sf), START)
    return d.select(
        "id", "canonical_name_kl", "feature_type", "status", F.col("geometry.coordinates")[0].alias("lon"),
        "municipality", "municipality_id", "name.kind", "name.language", "name.value",
    )


@query(
    "c6_place_identifiers",
    """SELECT id, namespace, value FROM v_external_identifiers WHERE entity_type = 'place'
         AND entity_id = 'plc_0000000007' AND (valid_to IS NULL OR valid_to >= DATE '2000-10-01')""",
)
def _(spark, sf):
    return denorm.place_identifiers(domain_tables(spark, sf), "plc_0000000007", "2000-10-01").select(
        "id", "namespace", "value"
    )


SQL_TOUCHING = f"""SELECT c.id AS connection_id, c.origin_place_id, c.destination_place_id, c.mode, s.id AS service_id
    FROM v_connections c LEFT JOIN v_connection_services s ON s.connection_id = c.id AND {sql_rule('api', p='s.')}
    WHERE c.retired_at IS NULL"""


@query(
    "c7_place_connections",
    f"""SELECT connection_id, mode, service_id, CASE WHEN origin_place_id = '{START}' THEN 'origin' ELSE 'destination' END AS role,
               CASE WHEN origin_place_id = '{START}' THEN destination_place_id ELSE origin_place_id END AS peer_place_id
        FROM ({SQL_TOUCHING}) WHERE origin_place_id = '{START}' OR destination_place_id = '{START}'""",
)
def _(spark, sf):
    d = denorm.place_connections(domain_tables(spark, sf), START, AT)
    return d.select("connection_id", "mode", F.col("service.id").alias("service_id"), "role", "peer_place_id")


@query(
    "c7_all_place_connections",
    f"""SELECT origin_place_id AS place_id, 'origin' AS role, destination_place_id AS peer_place_id, connection_id, service_id
        FROM ({SQL_TOUCHING}) UNION ALL
        SELECT destination_place_id, 'destination', origin_place_id, connection_id, service_id FROM ({SQL_TOUCHING})
        WHERE origin_place_id <> destination_place_id""",
)
def _(spark, sf):
    d = denorm.all_place_connections(domain_tables(spark, sf), AT)
    return d.select("place_id", "role", "peer_place_id", "connection_id", F.col("service.id").alias("service_id"))


@query(
    "c8_reachable_neighbours",
    f"""SELECT c.id AS connection_id, s.id AS service_id, CASE WHEN c.origin_place_id = '{START}' THEN c.destination_place_id
               ELSE c.origin_place_id END AS peer_place_id, n.value AS peer_name
        FROM v_connections c JOIN v_connection_services s ON s.connection_id = c.id AND {sql_rule('dated_active', p='s.')}
        LEFT JOIN v_place_names n ON n.valid_to IS NULL AND n.kind = 'official' AND n.language = 'kl'
             AND n.place_id = CASE WHEN c.origin_place_id = '{START}' THEN c.destination_place_id ELSE c.origin_place_id END
        WHERE c.retired_at IS NULL AND (c.origin_place_id = '{START}'
              OR (c.direction = 'bidirectional' AND c.destination_place_id = '{START}'))""",
)
def _(spark, sf):
    d = denorm.reachable_neighbours(domain_tables(spark, sf), START, AT)
    return d.select("connection_id", "service_id", "peer_place_id", "peer_name")


SQL_NODES = """SELECT p.id AS place_id, n.official_name, n.danish_name, n.historical_name, g.longitude, g.latitude
    FROM v_places p
    JOIN (SELECT place_id,
            coalesce(arg_max(value, id) FILTER (WHERE kind = 'official' AND language = 'kl'),
                     arg_min(value, id) FILTER (WHERE kind = 'official' AND language <> 'kl')) AS official_name,
            arg_max(value, id) FILTER (WHERE kind = 'exonym' AND language = 'da') AS danish_name,
            arg_max(value, id) FILTER (WHERE kind = 'historical') AS historical_name
          FROM v_place_names GROUP BY place_id) n ON n.place_id = p.id AND n.official_name IS NOT NULL
    JOIN (SELECT place_id, arg_max(lon, id) AS longitude, arg_max(lat, id) AS latitude
          FROM v_place_geometries GROUP BY place_id) g ON g.place_id = p.id
    WHERE p.id IN (SELECT origin_place_id FROM v_connections WHERE retired_at IS NULL
                   UNION SELECT destination_place_id FROM v_connections WHERE retired_at IS NULL)"""
SQL_EDGES = f"""SELECT c.id, c.origin_place_id AS from_place_id, c.destination_place_id AS to_place_id, a.official_name AS from_name,
        b.official_name AS to_name, c.direction, c.mode, coalesce(s.n, 0) AS service_count, s.operator,
        s.season_kind, s.month_from, s.month_to, s.first_id
    FROM v_connections c JOIN ({SQL_NODES}) a ON a.place_id = c.origin_place_id
    JOIN ({SQL_NODES}) b ON b.place_id = c.destination_place_id
    LEFT JOIN (SELECT connection_id, count(*) AS n, arg_min_null(operator, id) AS operator, min(id) AS first_id,
               arg_min_null(season_kind, id) AS season_kind, arg_min_null(month_from, id) AS month_from,
               arg_min_null(month_to, id) AS month_to
               FROM v_connection_services WHERE {sql_rule('export')} GROUP BY connection_id) s ON s.connection_id = c.id
    WHERE c.retired_at IS NULL"""


@query("c9_graph_nodes", SQL_NODES)
def _(spark, sf):
    return denorm.graph_nodes(domain_tables(spark, sf))


@query(
    "c9_graph_edges",
    f"SELECT id, from_place_id, to_place_id, from_name, to_name, direction, mode, service_count, operator FROM ({SQL_EDGES})",
)
def _(spark, sf):
    t = domain_tables(spark, sf)
    e = denorm.graph_edges(t, denorm.graph_nodes(t))
    return e.select(
        "id", "from_place_id", "to_place_id", "from_name", "to_name", "direction", "mode", "service_count", "operator"
    )


@query(
    "c9_edge_services",
    f"""SELECT e.id, s.id AS service_id, s.operator FROM ({SQL_EDGES}) e
        JOIN v_connection_services s ON s.connection_id = e.id AND {sql_rule('export', p='s.')}""",
)
def _(spark, sf):
    t = domain_tables(spark, sf)
    s = denorm.edge_services(t, denorm.graph_edges(t, denorm.graph_nodes(t)))
    return s.select("id", F.col("service.id").alias("service_id"), "service.operator")


SQL_MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"
SQL_LABEL = f"""CASE WHEN first_id IS NULL THEN 'unknown' WHEN season_kind = 'year_round' THEN 'Year-round'
    WHEN season_kind = 'seasonal' AND month_from IS NOT NULL
         THEN array_to_string(list_slice({SQL_MONTHS}, month_from, month_to), ', ')
    ELSE coalesce(nullif(season_kind, ''), 'Unknown seasonality') END"""
SQL_LINKS = f"""SELECT from_place_id AS place_id, id, to_place_id AS other_place_id, to_name AS other_name, {SQL_LABEL} AS season_label
    FROM ({SQL_EDGES}) UNION ALL
    SELECT to_place_id, id, from_place_id, from_name, {SQL_LABEL} FROM ({SQL_EDGES})
    WHERE direction = 'bidirectional' AND from_place_id <> to_place_id"""


@query("c10_links_with_season", SQL_LINKS)
def _(spark, sf):
    t = domain_tables(spark, sf)
    links = denorm.links_from(denorm.graph_edges(t, denorm.graph_nodes(t)))
    return links.select("place_id", "id", "other_place_id", "other_name", "season_label")


@query(
    "c11_link_lines",
    f"""SELECT l.place_id, l.id, a.longitude AS x1, a.latitude AS y1, b.longitude AS x2, b.latitude AS y2
        FROM ({SQL_LINKS}) l JOIN ({SQL_NODES}) a ON a.place_id = l.place_id JOIN ({SQL_NODES}) b ON b.place_id = l.other_place_id""",
)
def _(spark, sf):
    t = domain_tables(spark, sf)
    nodes = denorm.graph_nodes(t)
    lines = denorm.link_lines(denorm.graph_edges(t, nodes), nodes)
    c = F.col("geometry.coordinates")
    return lines.select(
        "place_id", F.col("properties.id").alias("id"), c[0][0].alias("x1"), c[0][1].alias("y1"),
        c[1][0].alias("x2"), c[1][1].alias("y2"),
    )


@query(
    "c12_season_labels",
    f"""SELECT label, count(*) AS n FROM (SELECT {SQL_LABEL} AS label FROM (SELECT id AS first_id, * FROM v_connection_services))
        GROUP BY label""",
)
def _(spark, sf):
    t = domain_tables(spark, sf)
    return t["connection_services"].groupBy(denorm.season_label().alias("label")).agg(F.count("*").alias("n"))


@query(
    "c13_service_structs",
    """SELECT id, operator, coalesce(frequency_band, 'unknown') AS frequency_band, coalesce(season_kind, 'none') AS kind, status
       FROM v_connection_services""",
)
def _(spark, sf):
    s = domain_tables(spark, sf)["connection_services"].select(denorm.service_struct().alias("s"))
    return s.select(
        "s.id", "s.operator", "s.frequency_band", F.coalesce("s.seasonality.kind", F.lit("none")).alias("kind"), "s.status"
    )


# --- access network -----------------------------------------------------------

SQL_CONNECTED = "SELECT origin_place_id AS place_id FROM ({0}) UNION SELECT destination_place_id FROM ({0})"


@query("d1_connected_places", SQL_CONNECTED.format(sql_serving("api")))
def _(spark, sf):
    return network.connected_places(domain_tables(spark, sf), AT)


def _isolation(rule: str, capability: str, name: str) -> None:
    linked = SQL_CONNECTED.format(sql_serving(rule, capability))

    @query(
        name,
        f"""SELECT id AS place_id, id IN ({linked}) AS connected FROM v_places WHERE status = 'active'""",
    )
    def _(spark, sf):
        return network.isolation(domain_tables(spark, sf), AT, capability, rule)


_isolation("api", "passenger", "d2_isolation_api")
_isolation("build", "passenger", "d2_isolation_build")
_isolation("api", "freight", "d2_freight_gap")
_isolation("build", "emergency", "d2_emergency_gap")
_isolation("export", "passenger", "d2_isolation_export")
_isolation("dated_active", "passenger", "d2_isolation_dated_active")


@query(
    "d2_isolation_counts",
    f"""SELECT count(*) AS places, count(*) FILTER (WHERE connected) AS connected, count(*) FILTER (WHERE NOT connected) AS isolated
        FROM (SELECT id IN ({SQL_CONNECTED.format(sql_serving('build_month'))}) AS connected FROM v_places WHERE status = 'active')""",
)
def _(spark, sf):
    return network.isolation_counts(network.isolation(domain_tables(spark, sf), AT, rule="build_month"))


def _single(rule: str) -> None:
    rows = f"""SELECT e.place_id, c.id AS connection, c.mode, nullif(s.operator, '') AS operator
        FROM v_connections c JOIN v_connection_services s ON s.connection_id = c.id
        CROSS JOIN LATERAL (SELECT unnest([c.origin_place_id, c.destination_place_id]) AS place_id) e
        WHERE c.retired_at IS NULL AND {sql_cap('passenger', 's.')} AND {sql_rule(rule, p='s.')}"""
    parts = " UNION ALL ".join(
        f"SELECT place_id, '{k}' AS kind, min({k}) AS value FROM ({rows}) GROUP BY place_id HAVING count(DISTINCT {k}) = 1"
        for k in ("connection", "mode", "operator")
    )

    @query(f"d3_single_dependency_{rule}", parts)
    def _(spark, sf):
        return network.single_dependency(domain_tables(spark, sf), AT, rule=rule)


_single("api")
_single("build")


def _loss(rule: str, sql_probe) -> None:
    months = " UNION ALL ".join(
        f"SELECT DISTINCT {m} AS m, place_id FROM ({SQL_CONNECTED.format(sql_serving(rule, at=f'{YEAR}-{m:02d}-15'))})"
        for m in range(1, 13)
    )

    @query(
        f"d4_seasonal_loss_{sql_probe}",
        f"""WITH on_months AS ({months}), on_list AS (SELECT place_id, list(m) AS l FROM on_months GROUP BY place_id)
            SELECT place_id, array_to_string(list_filter(range(1, 13), lambda x: list_contains(l, x)), ',') AS connected_months,
                   array_to_string(list_filter(range(1, 13), lambda x: NOT list_contains(l, x)), ',') AS isolated_months
            FROM on_list WHERE len(l) < 12 AND place_id IN (SELECT id FROM v_places WHERE status = 'active')""",
    )
    def _(spark, sf):
        d = network.seasonal_loss(domain_tables(spark, sf), YEAR, rule=rule)
        as_text = lambda c: F.array_join(F.transform(c, lambda m: m.cast("string")), ",")
        return d.select(
            "place_id", as_text("connected_months").alias("connected_months"), as_text("isolated_months").alias("isolated_months")
        )


_loss("api", "api")
_loss("build_month", "build")


def _sql_reach(where_source: str, path: bool) -> str:
    """Breadth first over all hops; a place keeps its least hop count and, of equal ones, the least path."""
    edges = f"""SELECT origin_place_id AS src, destination_place_id AS dst, id FROM ({sql_serving('api')})
        UNION ALL SELECT destination_place_id, origin_place_id, id FROM ({sql_serving('api')}) WHERE direction = 'bidirectional'"""
    carried, start, step = (
        (", path, connections", ", id AS path, '' AS connections",
         """, arg_min(f.path || ',' || e.dst, CASE WHEN f.connections = '' THEN e.id ELSE f.connections || ',' || e.id END),
            min(CASE WHEN f.connections = '' THEN e.id ELSE f.connections || ',' || e.id END)""")
        if path else ("", "", "")
    )
    return f"""WITH RECURSIVE edges AS MATERIALIZED (SELECT src, dst, min(id) AS id FROM ({edges}) WHERE src <> dst GROUP BY src, dst),
        reach(source, place_id, hops{carried}) USING KEY (source, place_id) AS (
          SELECT id, id, 0{start} FROM v_places WHERE {where_source}
          UNION
          SELECT f.source, e.dst, min(f.hops) + 1{step} FROM reach f JOIN edges e ON e.src = f.place_id
          LEFT JOIN recurring.reach r ON r.source = f.source AND r.place_id = e.dst
          WHERE r.place_id IS NULL GROUP BY f.source, e.dst)
        SELECT * FROM reach"""


@query("d5_hop_paths_from_place", _sql_reach(f"id = '{START}'", True))
def _(spark, sf):
    t = domain_tables(spark, sf)
    start = t["places"].where(F.col("id") == START).select(F.col("id").alias("place_id"))
    found = network.hop_distances(t, start, AT)
    return found.withColumn("path", F.array_join("path", ",")).withColumn("connections", F.array_join("connections", ","))


def _path_query(name: str, target: str, max_transfers: int | None) -> None:
    limit = "NULL::INT" if max_transfers is None else str(max_transfers)
    within = "TRUE" if max_transfers is None else f"hops <= {max_transfers + 1}"

    @query(
        name,
        f"""SELECT '{START}' AS from_place_id, '{target}' AS to_place_id, {limit} AS max_transfers, r.hops IS NOT NULL AS reachable, r.hops,
                   coalesce(r.path, '') AS path, coalesce(r.connections, '') AS connections
            FROM (SELECT 1) LEFT JOIN (SELECT * FROM ({_sql_reach(f"id = '{START}'", True)}) WHERE place_id = '{target}' AND {within}) r ON TRUE""",
    )
    def _(spark, sf):
        found = network.hop_path(domain_tables(spark, sf), START, target, AT, max_transfers=max_transfers)
        text = lambda c: F.array_join(c, ",").alias(c)
        return found.select("from_place_id", "to_place_id", "max_transfers", "reachable", "hops", text("path"), text("connections"))


_path_query("d5_hop_path", "plc_0000000077", None)
_path_query("d5_hop_path_direct_only", "plc_0000000077", 0)
_path_query("d5_hop_path_to_itself", START, None)
_path_query("d5_hop_path_unreachable", "plc_none", None)


@query("d6_hop_distances", _sql_reach("k % 50 = 0", False))
def _(spark, sf):
    """From all places whose number is divisible by 50 to every place they reach."""
    t = domain_tables(spark, sf)
    number = F.substring("id", 5, 20).cast("long")
    starts = t["places"].where(number % 50 == 0).select(F.col("id").alias("place_id"))
    return network.hops_from_many(t, starts, AT)


@query(
    "d7_edge_list",
    f"""SELECT origin_place_id AS src, destination_place_id AS dst, id AS connection_id FROM ({sql_serving('api', 'freight')})
        UNION ALL SELECT destination_place_id, origin_place_id, id FROM ({sql_serving('api', 'freight')}) WHERE direction = 'bidirectional'""",
)
def _(spark, sf):
    return network.edge_list(domain_tables(spark, sf), AT, "freight")


@query(
    "d8_access_change",
    f"""WITH old AS (SELECT id AS place_id, id IN ({SQL_CONNECTED.format(sql_serving('api'))}) AS was FROM v_places
                     WHERE status = 'active' AND k % 10 <> 4),
             upd AS (SELECT id AS place_id, id IN ({SQL_CONNECTED.format(sql_serving('api') + " AND c.mode <> 'road'")}) AS now
                     FROM v_places WHERE status = 'active' AND k % 10 <> 5)
        SELECT coalesce(o.place_id, u.place_id) AS place_id, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed'
               WHEN was AND NOT now THEN 'lost' ELSE 'gained' END AS change
        FROM old o FULL JOIN upd u ON u.place_id = o.place_id WHERE was IS DISTINCT FROM now""",
)
def _(spark, sf):
    t = domain_tables(spark, sf)
    last = F.substring("id", -1, 1)
    before = ChainMap({"places": t["places"].where(last != "4")}, t)
    connections = t["connections"].where(F.col("mode") != "road")
    after = ChainMap({"places": t["places"].where(last != "5"), "connections": connections}, t)
    return network.access_change(before, after, AT).select("place_id", "change")
