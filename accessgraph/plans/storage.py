"""Queries that read and write records, features and releases."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessgraph.operators import reconcile
from accessgraph.plans.registry import query
from accessgraph.plans.views import base, domain_tables, view
from accessgraph.schemas import TABLES
from accessgraph.session import durable_dir
from accessgraph.sources import features, files, records, sinks


def _folder(spark) -> str:
    return f"{durable_dir(spark)}/data-{uuid4().hex}"


@query("a1_a8_ndjson_round_trip", "SELECT id, mode, direction, CAST(created_at AS STRING) AS created_at FROM v_connections")
def _(spark, sf):
    path = _folder(spark)
    sinks.write_ndjson(domain_tables(spark, sf)["connections"], path)
    back = records.read_records(spark, path, TABLES["connections"])
    missing = records.read_records(spark, path + "-none", TABLES["connections"])
    return back.unionByName(missing).select("id", "mode", "direction", F.col("created_at").cast("string").alias("created_at"))


@query(
    "a2_strict_read",
    """SELECT 'good' AS t, count(*) AS n FROM events WHERE event_id % 50 <> 0 AND event_id % 60 <> 1
       UNION ALL SELECT 'bad', count(*) FROM events WHERE event_id % 50 = 0""",
)
def _(spark, sf):
    k = F.col("event_id")
    line = (
        F.when(k % 50 == 0, '{"id": "broken')
        .when(k % 60 == 1, "   ")
        .otherwise(F.concat(F.lit('{"id": "e'), k.cast("string"), F.lit('", "status": "active"}')))
    )
    path = _folder(spark)
    base(spark, sf, "events").select(line.alias("value")).write.text(path)
    rows, bad = records.read_records_strict(spark, path, TABLES["places"])
    n = F.count(F.lit(1)).alias("n")
    return rows.agg(n).select(F.lit("good").alias("t"), "n").unionByName(bad.agg(n).select(F.lit("bad").alias("t"), "n"))


@query(
    "a2_broken_lines",
    """SELECT bucket, line, message_end FROM (
         SELECT event_id % 8 AS bucket, event_id, row_number() OVER (PARTITION BY event_id % 8 ORDER BY event_id) AS line,
                ': invalid JSON: {"id": "broken' || event_id AS message_end
         FROM events) WHERE event_id % 50 = 0""",
)
def _(spark, sf):
    k = F.col("event_id")
    line = F.when(k % 50 == 0, F.concat(F.lit('{"id": "broken'), k.cast("string"))).when(k % 60 == 1, "   ").otherwise(
        F.concat(F.lit('{"id": "e'), k.cast("string"), F.lit('", "status": "active"}'))
    )
    path = _folder(spark)
    lines = base(spark, sf, "events").select((k % 8).alias("bucket"), "event_id", line.alias("value"))
    lines = lines.repartition(8, "bucket").sortWithinPartitions("bucket", "event_id").drop("event_id")
    lines.write.partitionBy("bucket").text(path)
    _, bad = records.read_records_strict(spark, path, TABLES["places"])
    return bad.select(
        F.regexp_extract("path", r"bucket=(\d+)", 1).cast("long").alias("bucket"),
        "line",
        F.regexp_extract("message", r":\d+(: invalid JSON: .*)$", 1).alias("message_end"),
    )


@query(
    "a3_feature_pages",
    """SELECT record_id, replace(replace(gid, '{', ''), '}', '') AS global_id, trim(official_raw) AS official_name, CAST(type_code AS INT) AS type_code
       FROM v_register WHERE trim(official_raw) <> '' AND lon IS NOT NULL AND record_id % 20 <> 4""",
)
def _(spark, sf):
    r = view(spark, sf, "v_register")
    number = lambda c: F.col(c).cast("double")
    attributes = F.struct(
        number("record_id").alias("OBJECTID"),
        F.when(F.col("record_id") % 20 != 4, number("record_id")).alias("ID"),
        number("type_code").alias("Type"),
        number("municipality_code").alias("MunicipalityCode"),
        F.col("gid").alias("GlobalID"),
        F.col("official_raw").alias("PlacenameOfficial"),
        F.col("old_raw").alias("PlacenameOfficialOld"),
        F.col("danish_raw").alias("PlacenameDanish"),
        F.lit(None).cast("string").alias("LokalityCode"),
    )
    page = F.floor(F.col("record_id") / 500)
    pages = r.groupBy(page.alias("page")).agg(
        F.collect_list(
            F.struct(attributes.alias("attributes"), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("geometry"))
        ).alias("features")
    )
    return features.ingest_feature_pages(pages).select("record_id", "global_id", "official_name", "type_code")


@query(
    "a6_point_features",
    """SELECT record_id, official_name, danish_name, record_id % 4 < 2 AS is_locality, longitude, latitude FROM v_features WHERE record_id % 9 <> 0""",
)
def _(spark, sf):
    k = F.col("record_id")
    flags = F.element_at(F.array(*[F.lit(v) for v in ('"true"', "1", "false", "null")]), (k % 4 + 1).cast("int"))
    quote = lambda c: F.coalesce(F.concat(F.lit('"'), F.col(c), F.lit('"')), F.lit("null"))
    shape = F.when(k % 9 == 0, "LineString").otherwise("Point")
    value = F.concat(
        F.lit('{"type": "Feature", "properties": {"recordId": '), k.cast("string"), F.lit(', "officialName": '), quote("official_name"),
        F.lit(', "danishName": '), quote("danish_name"), F.lit(', "isLocality": '), flags, F.lit('}, "geometry": {"type": "'), shape,
        F.lit('", "coordinates": ['), F.col("longitude").cast("string"), F.lit(", "), F.col("latitude").cast("string"), F.lit("]}}"),
    )
    rows = features.point_features(view(spark, sf, "v_features").select(value.alias("value")))
    return rows.select("record_id", "official_name", "danish_name", "is_locality", "longitude", "latitude")


@query(
    "a7_land_polygons",
    """SELECT round(w, 4) AS west, round(s, 4) AS south, round(w + 0.5, 4) AS east, 2 AS rings FROM v_land WHERE polygon_id % 6 <> 5
       UNION ALL SELECT round(w + 2, 4), round(s, 4), round(w + 2.5, 4), 1 FROM v_land WHERE polygon_id % 3 = 1 AND polygon_id % 6 <> 5""",
)
def _(spark, sf):
    k = F.col("polygon_id")

    def ring(dx: float, scale: float):
        corners = [(0, 0), (scale, 0), (scale, scale), (0, scale), (0, 0)]
        spot = lambda x, y: F.format_string("[%s, %s]", F.col("w") + x + dx, F.col("s") + y)
        return F.concat(F.lit("["), F.array_join(F.array(*[spot(x, y) for x, y in corners]), ", "), F.lit("]"))

    with_hole = F.concat(F.lit("["), ring(0, 0.5), F.lit(", "), ring(0.1, 0.2), F.lit("]"))
    short = F.lit("[[[0, 0], [1, 1], [0, 0]]]")
    polygon = F.format_string('{"type": "Polygon", "coordinates": %s}', with_hole)
    multi = F.format_string(
        '{"type": "MultiPolygon", "coordinates": [%s, %s, [%s]]}', with_hole, short, ring(2.0, 0.5)
    )
    nested = F.format_string('{"type": "GeometryCollection", "geometries": [{"type": "GeometryCollection", "geometries": [%s]}]}', polygon)
    geometry = F.when(k % 3 == 0, polygon).when(k % 3 == 1, multi).otherwise(nested)
    kind = F.when(k % 6 == 5, '"kind": "lake"').when(k % 6 == 4, '"kind": "land"').otherwise("")
    value = F.format_string('{"type": "Feature", "properties": {%s}, "geometry": %s}', kind, geometry)
    rows = features.read_land_polygons(view(spark, sf, "v_land").select(value.alias("value")))
    return rows.select(
        F.round("west", 4).alias("west"), F.round("south", 4).alias("south"), F.round("east", 4).alias("east"), F.size("rings").alias("rings")
    )


@query(
    "a15_latest_snapshots",
    """WITH f AS (SELECT DISTINCT 'src_' || CAST(user_id AS STRING) AS source, strftime(ts, '%Y-%m-%d') AS d,
            CASE event_type WHEN 'click' THEN 'full.json' WHEN 'view' THEN 'seed.json' ELSE 'notes.txt' END AS name FROM events)
       SELECT source, arg_max(d, (rank, d)) AS snapshot_date, arg_max(name, (rank, d)) AS name FROM (
         SELECT *, CASE name WHEN 'full.json' THEN 2 ELSE 1 END AS rank FROM f WHERE name <> 'notes.txt') GROUP BY source""",
)
def _(spark, sf):
    name = F.when(F.col("event_type") == "click", "full.json").when(F.col("event_type") == "view", "seed.json").otherwise("notes.txt")
    rows = base(spark, sf, "events").select(
        F.concat(F.lit("src_"), F.col("user_id").cast("string")).alias("source"),
        F.date_format("ts", "yyyy-MM-dd").alias("snapshot_date"),
        name.alias("name"),
    )
    return files.latest_snapshot(rows, ("full.json", "seed.json"))


@query(
    "a13_scanned_files",
    "SELECT 'p/' || CAST(page_id AS STRING) || '.html' AS path, strlen(html) AS bytes, sha256(html) AS sha256 FROM pages",
)
def _(spark, sf):
    root = _folder(spark)
    named = F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".html"))
    files.write_named_files(base(spark, sf, "pages").select(named.alias("path"), F.col("html").alias("content")), root)
    return files.scan_files(spark, f"{root}/p/*.html", root.rsplit("/", 1)[-1])


@query(
    "a14_snapshot_manifests",
    """SELECT 'snp_' || CAST(s_suppkey AS STRING) AS id, 'src_' || CAST(s_nationkey AS STRING) AS source,
              '2001-02-' || lpad(CAST(1 + s_suppkey % 28 AS STRING), 2, '0') AS snapshot_date, s_name AS notes, s_suppkey * 10 AS byte_size
       FROM supplier WHERE s_suppkey % 6 <> 5""",
)
def _(spark, sf):
    k = F.col("s_suppkey")
    record = F.struct(
        F.concat(F.when(k % 6 == 5, "other_").otherwise("snp_"), k.cast("string")).alias("id"),
        F.col("s_name").alias("notes"),
        (k * 10).alias("byte_size"),
    )
    folder = F.concat(
        F.lit("src_"), F.col("s_nationkey").cast("string"), F.lit("/2001-02-"), F.lpad((1 + k % 28).cast("string"), 2, "0")
    )
    # A folder is one snapshot; the supplier key keeps those of one day apart.
    rows = base(spark, sf, "supplier").select(
        F.concat(F.lit("set_"), k.cast("string"), F.lit("/"), folder, F.lit("/manifest.json")).alias("path"),
        F.to_json(record).alias("content"),
    )
    root = _folder(spark)
    files.write_named_files(rows, root)
    return files.snapshot_manifests(spark, f"{root}/*").select("id", "source", "snapshot_date", "notes", "byte_size")


@query(
    "a16_loaded_tables",
    " UNION ALL ".join(f"SELECT '{n}' AS t, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM v_{n}" for n in TABLES),
)
def _(spark, sf):
    root, t = _folder(spark), domain_tables(spark, sf)
    for name in TABLES:
        sinks.write_ndjson(t[name], f"{root}/{records.file_name(name)}", compression="gzip", lines_per_file=500_000)
    out = None
    for name, df in records.load_tables(spark, root).items():
        row = df.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
        row = row.select(F.lit(name).alias("t"), "n", "first_id", "last_id")
        out = row if out is None else out.unionByName(row)
    return out


# What a published table holds beside its ids, as one text.
DETAIL = {"places": "status", "connections": "mode", "connection_services": "connection_id"}


@query(
    "a16_a17_published_release",
    " UNION ALL ".join(f"SELECT '{t}' AS t, id, {detail} AS detail FROM v_{t}" for t, detail in DETAIL.items()),
)
def _(spark, sf):
    root, t = _folder(spark), domain_tables(spark, sf)
    chosen = {name: t[name] for name in DETAIL}
    records.publish_release({"places": t["places"].limit(0)}, root, "2001.01.01.1", update_current=True)
    records.publish_release(chosen, root, "2001.01.01.2")
    opened = records.open_release(spark, root)
    rows = [df.select(F.lit(name).alias("t"), "id", F.col(DETAIL[name]).alias("detail")) for name, df in opened.items()]
    return reduce(DataFrame.unionByName, rows)


def sql_minted(prefix: str, text: str) -> str:
    """The id that is made from the parts of ``text`` (SQL, joined by |): digits of its digest in UUID form."""
    h = f"sha256('{prefix}|' || {text})"
    variant = f"substr('89ab', (strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1, 1)"
    parts = [f"substr({h}, {start}, {size})" for start, size in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return f"'{prefix}_' || {parts[0]} || '-' || {parts[1]} || '-4' || {parts[2]} || '-' || {variant} || {parts[3]} || '-' || {parts[4]}"


SQL_AREA = sql_minted("adm", "'area ' || CAST(nk AS STRING)")
SQL_FLAT = f"""SELECT 'places' AS t, id, status AS detail FROM v_places
    UNION ALL SELECT 'place_classifications', {sql_minted('cls', 'id')}, id || ' town' FROM v_places
    UNION ALL SELECT 'place_names', {sql_minted('nam', "id || '|0'")}, id || ' ' || p_name || ' kl official' FROM v_places
    UNION ALL SELECT 'place_names', {sql_minted('nam', "id || '|1'")}, id || ' ' || c_name || ' da exonym' FROM v_places WHERE k % 2 = 0
    UNION ALL SELECT 'place_geometries', {sql_minted('geo', 'id')}, id || ' Point -50.0 64.0' FROM v_places
    UNION ALL SELECT DISTINCT 'administrative_areas', {SQL_AREA}, 'area ' || CAST(nk AS STRING) || ' municipality' FROM v_places
    UNION ALL SELECT 'administrative_memberships', {sql_minted('mem', "id || '|0'")}, id || ' ' || {SQL_AREA} FROM v_places"""


@query("a18_split_flat_places", SQL_FLAT)
def _(spark, sf):
    k = F.col("k")
    no_date = F.lit(None).cast("string")
    other = F.struct(F.col("c_name").alias("value"), F.lit("da").alias("language"), no_date.alias("kind"))
    member = lambda name, level: F.struct(
        name.alias("name"), F.lit(level).alias("level"), no_date.alias("valid_from"), no_date.alias("valid_to")
    )
    flat = view(spark, sf, "v_places").select(
        "id",
        "status",
        F.lit("town").alias("feature_type"),
        F.lit("2000-01-01").alias("updated_at"),
        F.struct(F.col("p_name").alias("value"), F.lit("kl").alias("language")).alias("canonical_name"),
        F.filter(F.array(other), lambda n: k % 2 == 0).alias("alternate_names"),
        F.struct(F.lit(-50.0).alias("longitude"), F.lit(64.0).alias("latitude")).alias("coordinates"),
        F.array(member(F.concat(F.lit("area "), F.col("nk").cast("string")), "municipality"), member(F.lit("r"), "region")).alias(
            "administrative_memberships"
        ),
    )
    made = records.split_flat_places(flat)
    detail = {
        "places": ["status"],
        "place_classifications": ["place_id", "feature_type"],
        "place_names": ["place_id", "value", "language", "kind"],
        "place_geometries": ["place_id", "geometry.type", F.array_join(F.col("geometry.coordinates").cast("array<string>"), " ")],
        "administrative_areas": ["name", "level"],
        "administrative_memberships": ["place_id", "administrative_area_id"],
    }
    rows = [df.select(F.lit(name).alias("t"), "id", F.concat_ws(" ", *detail[name]).alias("detail")) for name, df in made.items()]
    return reduce(DataFrame.unionByName, rows)


@query(
    "e25_merged_places",
    f"""SELECT id, status FROM v_places
        UNION ALL SELECT {sql_minted('plc', 'global_id')}, 'active' FROM v_features WHERE type_code IN (21, 23)""",
)
def _(spark, sf):
    t = domain_tables(spark, sf)
    rows = reconcile.scope_filter(view(spark, sf, "v_features"), "localities")
    fresh = rows.select(
        reconcile.minted_id("plc", F.col("global_id")).alias("id"), F.lit("active").alias("status"),
        F.lit(None).cast("date").alias("created_at"), F.lit(None).cast("date").alias("retired_at"),
        F.lit(None).cast(TABLES["places"]["source_refs"].dataType).alias("source_refs"),
    )
    return reconcile.merged({"places": t["places"]}, {"places": fresh})["places"].select("id", "status")
