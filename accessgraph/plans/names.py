"""Queries over the gazetteer, name search, resolution and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from accessgraph.functions import text
from accessgraph.operators import gazetteer, reconcile, resolve, search, token_index
from accessgraph.plans.access import SQL_CURRENT_PLACES
from accessgraph.plans.registry import query
from accessgraph.plans.views import base, domain_tables, view
from accessgraph.session import written

BOX = (-60.0, 62.0, -40.0, 76.0)


def _features(spark, sf):
    return view(spark, sf, "v_features")


def _crosswalk(spark, sf):
    """Every seventh feature has a canonical or candidate identity."""
    rows = _features(spark, sf).where(F.col("record_id") % 7 == 1)
    gid = F.upper("global_id")
    return rows.select(
        F.concat(F.lit("register:"), gid).alias("feature_id"),
        gid.alias("global_id"),
        F.concat(F.lit("plc_"), F.lpad(F.col("record_id").cast("string"), 10, "0")).alias("place_id"),
        F.when(F.col("record_id") % 2 == 0, "canonical").otherwise("candidate").alias("identity_status"),
    )


def _enriched(spark, sf):
    return gazetteer.enrich_gazetteer(_features(spark, sf), _crosswalk(spark, sf))


def sql_types() -> str:
    codes = sorted(set(gazetteer.TYPE_LABELS) | set(gazetteer.TYPE_RANKS))
    rows = ", ".join(
        "({}, '{}', {}, CAST({} AS DOUBLE))".format(
            c, gazetteer.TYPE_LABELS.get(c, f"Type {c}"), *gazetteer.TYPE_RANKS.get(c, gazetteer.DEFAULT_RANK)
        )
        for c in codes
    )
    return f"(SELECT * FROM (VALUES {rows}) t(code, label, importance, min_zoom))"


def sql_label(code: str) -> str:
    areas = {**gazetteer.MUNICIPALITIES, **gazetteer.OTHER_AREAS}
    return f"CASE {code} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in areas.items()) + " END"


COASTAL = ", ".join(map(str, gazetteer.COASTAL_CODES))
SQL_BAND = """CASE WHEN type_code = 21 THEN 'town' WHEN type_code = 23 THEN 'settlement' WHEN importance >= 650 THEN 'major'
    WHEN importance >= 500 THEN 'regional' WHEN importance >= 280 THEN 'local' ELSE 'detail' END"""
SQL_RANKED = f"""SELECT f.*, type_code IN (21, 23) AS is_locality, coalesce(t.label, 'Type ' || CAST(type_code AS STRING)) AS type_label,
    coalesce(t.importance, 180) AS importance, coalesce(t.min_zoom, 10.5) AS min_zoom,
    CASE type_code WHEN 21 THEN 'town' WHEN 23 THEN 'settlement' ELSE 'other' END AS feature_kind,
    {sql_label('municipality_code')} AS municipality_name,
    lower(regexp_replace(trim(official_name), '\\s+', ' ', 'g')) AS folded
    FROM v_features f LEFT JOIN {sql_types()} t ON t.code = f.type_code"""


def sql_near(a: str, b: str) -> str:
    return f"""(least(length({a}), length({b})) > 0 AND ({a} = {b}
        OR (greatest(length({a}), length({b})) <= 7 AND levenshtein({a}, {b}) <= 2)
        OR (greatest(length({a}), length({b})) <= 12 AND levenshtein({a}, {b}) <= 1)
        OR (abs(length({a}) - length({b})) <= 2 AND least(length({a}), length({b})) >= 4
            AND (starts_with({a}, {b}) OR starts_with({b}, {a})))))"""


SQL_PLACES = f"""SELECT r.*, {SQL_BAND} AS zoom_band, (NOT is_locality AND type_code NOT IN ({COASTAL}) AND EXISTS (
      SELECT 1 FROM ({SQL_RANKED}) l WHERE l.is_locality AND {sql_near('r.folded', 'l.folded')}
        AND (l.municipality_code = r.municipality_code OR (r.longitude - l.longitude) * (r.longitude - l.longitude)
             + (r.latitude - l.latitude) * (r.latitude - l.latitude) <= 0.04 * 0.04))) AS is_locality_shadow
    FROM ({SQL_RANKED}) r"""


# --- gazetteer --------------------------------------------------------------------


@query(
    "g1_g2_type_ranks",
    f"SELECT record_id, type_label, importance, min_zoom FROM ({SQL_RANKED})",
)
def _(spark, sf):
    return gazetteer.rank_types(_features(spark, sf)).select("record_id", "type_label", "importance", "min_zoom")


@query(
    "g3_g4_classified_features",
    f"""SELECT record_id, feature_kind, is_locality, municipality_name, zoom_band, CASE zoom_band WHEN 'town' THEN 2.2 WHEN 'settlement' THEN 5.6
        WHEN 'major' THEN 5.8 WHEN 'regional' THEN 7.0 WHEN 'local' THEN 8.6 ELSE 10.6 END::DOUBLE AS band_zoom
        FROM (SELECT *, {SQL_BAND} AS zoom_band FROM ({SQL_RANKED}))""",
)
def _(spark, sf):
    rows = gazetteer.rank_types(gazetteer.classify_features(_features(spark, sf)))
    rows = rows.withColumn("zoom_band", gazetteer.zoom_band())
    return rows.select(
        "record_id", "feature_kind", "is_locality", "municipality_name", "zoom_band",
        gazetteer.band_min_zoom(F.col("zoom_band")).alias("band_zoom"),
    )


@query(
    "g5_enriched_gazetteer",
    f"""SELECT record_id, is_locality_shadow, importance, zoom_band,
               CASE WHEN record_id % 7 = 1 THEN 'register:' || upper(global_id) ELSE 'register:' || global_id END AS feature_id,
               CASE WHEN record_id % 7 <> 1 THEN 'upstream_only' WHEN record_id % 2 = 0 THEN 'canonical' ELSE 'candidate' END AS identity_status
        FROM ({SQL_PLACES})""",
)
def _(spark, sf):
    return _enriched(spark, sf).select(
        "record_id", "is_locality_shadow", "importance", "zoom_band", "feature_id", "identity_status"
    )


@query(
    "g6_geography_groups",
    f"""SELECT coalesce(CASE WHEN is_locality THEN NULL WHEN type_code IN {gazetteer.WATER_TYPES} THEN 'waters'
          WHEN type_code IN {gazetteer.ISLAND_TYPES} THEN 'islands' ELSE 'landforms' END, 'none') AS g, count(*) AS n
        FROM ({SQL_RANKED}) GROUP BY 1""",
)
def _(spark, sf):
    rows = gazetteer.classify_features(_features(spark, sf))
    return rows.groupBy(F.coalesce(gazetteer.geography_group(), F.lit("none")).alias("g")).agg(F.count("*").alias("n"))


@query(
    "g7_visible_outside",
    f"""SELECT record_id FROM ({SQL_PLACES}) WHERE NOT is_locality_shadow AND municipality_code IN (961, 999)
        AND (feature_kind = 'town' OR (NOT is_locality AND (type_code IN {gazetteer.WATER_TYPES} OR type_code IN {gazetteer.ISLAND_TYPES})))""",
)
def _(spark, sf):
    return gazetteer.visible(_enriched(spark, sf), "geography", "outside", ("waters", "islands")).select("record_id")


@query(
    "g7_visible_inhabited",
    f"SELECT record_id FROM ({SQL_PLACES}) WHERE NOT is_locality_shadow AND municipality_code = 956 AND is_locality",
)
def _(spark, sf):
    return gazetteer.visible(_enriched(spark, sf), "inhabited", 956).select("record_id")


@query(
    "g8_visible_at_zoom",
    f"""SELECT record_id FROM (SELECT *, {SQL_BAND} AS zoom_band FROM ({SQL_RANKED})) WHERE CASE WHEN type_code IN ({COASTAL}) THEN min_zoom
        ELSE CASE zoom_band WHEN 'town' THEN 2.2 WHEN 'settlement' THEN 5.6 WHEN 'major' THEN 5.8 WHEN 'regional' THEN 7.0
             WHEN 'local' THEN 8.6 ELSE 10.6 END END <= 7.5""",
)
def _(spark, sf):
    rows = gazetteer.rank_types(gazetteer.classify_features(_features(spark, sf)))
    return gazetteer.visible_at_zoom(rows.withColumn("zoom_band", gazetteer.zoom_band()), 7.5).select("record_id")


@query(
    "g9_coastal_features",
    """SELECT f.record_id, c.kind, c.glyph FROM v_features f JOIN (VALUES (143, 'skerry', '×'), (181, 'island', '○'),
         (182, 'island_part', '·'), (183, 'island_group', '◎')) c(code, kind, glyph) ON c.code = f.type_code""",
)
def _(spark, sf):
    rows = _features(spark, sf).join(gazetteer.coastal_registry(spark), "type_code")
    return rows.select("record_id", "kind", "glyph")


@query(
    "g10_provenance",
    f"SELECT global_id, type_label, 'midpoint' AS geometry_kind, 'open register' AS register_name FROM ({SQL_RANKED})",
)
def _(spark, sf):
    rows = gazetteer.rank_types(_features(spark, sf))
    rows = gazetteer.with_provenance(rows, "register_midpoint", "open register", "https://example.org/layer")
    return rows.select("global_id", "type_label", "geometry_kind", "register_name")


@query(
    "g11_coverage_audit",
    f"""SELECT type_code, count(*) AS expected, count(*) AS seen_once, 0 AS missing, 0 AS repeated, 0 AS unexpected
        FROM v_features WHERE type_code IN ({COASTAL}) GROUP BY type_code""",
)
def _(spark, sf):
    return gazetteer.coverage_audit(_features(spark, sf), gazetteer.visible(_enriched(spark, sf)))


@query("g12_scope_geography", f"SELECT record_id FROM ({SQL_RANKED}) WHERE NOT is_locality")
def _(spark, sf):
    return gazetteer.scope_places(gazetteer.classify_features(_features(spark, sf)), "geography").select("record_id")


@query(
    "g13_region_extract",
    f"""WITH inside AS (SELECT * FROM ({SQL_RANKED}) WHERE longitude BETWEEN {BOX[0]} AND {BOX[2]} AND latitude BETWEEN {BOX[1]} AND {BOX[3]})
        SELECT record_id FROM inside WHERE is_locality UNION ALL
        SELECT record_id FROM (SELECT * FROM inside WHERE NOT is_locality AND importance >= 400)""",
)
def _(spark, sf):
    rows = gazetteer.rank_types(gazetteer.classify_features(_features(spark, sf)))
    return gazetteer.region_extract(rows, BOX).select("record_id")


@query(
    "g14_corridor_localities",
    f"""SELECT record_id FROM ({SQL_RANKED}) WHERE is_locality AND longitude BETWEEN {BOX[0]} AND {BOX[2]}
        AND latitude BETWEEN {BOX[1]} AND {BOX[3]}""",
)
def _(spark, sf):
    return gazetteer.corridor_extract(gazetteer.classify_features(_features(spark, sf)), BOX).select("record_id")


@query("a4_scope_localities", "SELECT record_id FROM v_features WHERE type_code IN (21, 23)")
def _(spark, sf):
    return reconcile.scope_filter(_features(spark, sf), "localities").select("record_id")


@query(
    "a5_filter_by_seed_names",
    """SELECT record_id FROM v_features WHERE official_name IN (SELECT value FROM v_place_names
         WHERE valid_to IS NULL AND kind = 'official' AND language = 'kl')""",
)
def _(spark, sf):
    names = reconcile.seed_names(domain_tables(spark, sf))
    return reconcile.filter_by_names(_features(spark, sf), names).select("record_id")


# --- search -----------------------------------------------------------------------

SQL_SEARCH_NAMES = """SELECT place_id, value, language, kind FROM v_place_names WHERE valid_to IS NULL
    UNION ALL SELECT entity_id, value, 'und', 'external_identifier' FROM v_external_identifiers
    WHERE valid_to IS NULL AND entity_type = 'place'"""


def sql_hits(names: str) -> str:
    return f"""SELECT place_id, canonical_name_kl, municipality, matched_name, matched_kind FROM (
        SELECT DISTINCT p.id AS place_id, p.canonical_name_kl, p.feature_type, p.municipality, n.value AS matched_name,
               n.language, n.kind AS matched_kind FROM ({SQL_CURRENT_PLACES}) p JOIN ({names}) n ON n.place_id = p.id)
        """


def sql_word(word: str) -> str:
    return f"contains(strip_accents(lower(' ' || trim(regexp_replace(value, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))), ' {word}')"


HIT_COLUMNS = ("place_id", "canonical_name_kl", "municipality", "matched_name", "matched_kind")


@query("e1_e4_prefix_search", sql_hits(f"SELECT * FROM ({SQL_SEARCH_NAMES}) WHERE {sql_word('wid')} AND {sql_word('bl')}"))
def _(spark, sf):
    return search.prefix_search(domain_tables(spark, sf), "WID bl").select(*HIT_COLUMNS)


def sql_hits_of_many(names: str, met: str, queries: str) -> str:
    return f"""SELECT query_id, place_id, canonical_name_kl, municipality, matched_name, matched_language, matched_kind FROM (
        SELECT DISTINCT q.query_id, p.id AS place_id, p.canonical_name_kl, p.feature_type, p.municipality, n.value AS matched_name, n.language AS matched_language, n.kind AS matched_kind
        FROM ({queries}) q JOIN ({names}) n ON {met} JOIN ({SQL_CURRENT_PLACES}) p ON n.place_id = p.id)"""


MANY_COLUMNS = ("query_id", "place_id", "canonical_name_kl", "municipality", "matched_name", "matched_language", "matched_kind")
SQL_WORD_QUERIES = """SELECT c_custkey AS query_id, upper(substr(split_part(p_name, ' ', 2), 1, 2)) || '  ' || substr(split_part(p_name, ' ', 1), 1, 4)
    || ' ' || CAST(c_custkey % 4 AS STRING) AS q FROM customer JOIN part ON p_partkey = c_custkey WHERE c_custkey % 50 = 0"""
SQL_PART_QUERIES = "SELECT c_custkey AS query_id, ' ' || upper(substr(p_name, 3, 4 + c_custkey % 9)) || ' ' AS q FROM customer JOIN part ON p_partkey = c_custkey WHERE c_custkey % 50 = 0"
SQL_ALL_WORDS = """len(list_filter(regexp_split_to_array(trim(q), '\\s+'), lambda w: NOT contains(
    strip_accents(lower(' ' || trim(regexp_replace(value, '[^\\p{L}\\p{N}]+', ' ', 'g')))), ' ' || strip_accents(lower(w))))) = 0"""


def _place_queries(spark, sf, q):
    named = base(spark, sf, "customer").join(base(spark, sf, "part"), F.col("p_partkey") == F.col("c_custkey"))
    return named.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("query_id"), q.alias("q"))


def _word_queries(spark, sf):
    word = lambda n, size: F.substring(F.split_part("p_name", F.lit(" "), F.lit(n)), 1, size)
    last = (F.col("c_custkey") % 4).cast("string")
    return _place_queries(spark, sf, F.concat(F.upper(word(2, 2)), F.lit("  "), word(1, 4), F.lit(" "), last))


def _part_queries(spark, sf):
    part = F.substring(F.col("p_name"), F.lit(3), (F.col("c_custkey") % 9 + 4).cast("int"))
    return _place_queries(spark, sf, F.concat(F.lit(" "), F.upper(part), F.lit(" ")))


@query("e1_prefix_search_of_many", sql_hits_of_many(SQL_SEARCH_NAMES, SQL_ALL_WORDS, SQL_WORD_QUERIES))
def _(spark, sf):
    """The queries of all customers whose number is divisible by 50, in one pass over an index of words."""
    return token_index.prefix_search_many(domain_tables(spark, sf), _word_queries(spark, sf)).select(*MANY_COLUMNS)


@query(
    "e2_substring_search_of_many",
    sql_hits_of_many("SELECT * FROM v_place_names WHERE valid_to IS NULL", "contains(lower(value), lower(trim(q)))", SQL_PART_QUERIES),
)
def _(spark, sf):
    return token_index.substring_search_many(domain_tables(spark, sf), _part_queries(spark, sf)).select(*MANY_COLUMNS)


@query(
    "e4_first_hits_of_many",
    f"""SELECT query_id, position, place_id, matched_name FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY
          CASE WHEN lower(matched_name) = lower(q) THEN 0 ELSE 1 END, canonical_name_kl, place_id, matched_name, matched_language, matched_kind, municipality) AS position
        FROM ({sql_hits_of_many(SQL_SEARCH_NAMES, SQL_ALL_WORDS, SQL_WORD_QUERIES)}) JOIN ({SQL_WORD_QUERIES}) USING (query_id)) WHERE position <= 10""",
)
def _(spark, sf):
    hits = token_index.prefix_search_many(domain_tables(spark, sf), _word_queries(spark, sf), limit=10)
    return hits.select("query_id", "position", "place_id", "matched_name")


@query(
    "e2_substring_search",
    sql_hits("SELECT * FROM v_place_names WHERE valid_to IS NULL AND contains(lower(value), 'idget 1')"),
)
def _(spark, sf):
    return search.substring_search(domain_tables(spark, sf), " idGET 1 ").select(*HIT_COLUMNS)


@query(
    "e3_search_falls_back",
    sql_hits("SELECT * FROM v_place_names WHERE valid_to IS NULL AND contains(lower(value), 'dget 2')"),
)
def _(spark, sf):
    return search.search_places(domain_tables(spark, sf), "dget 2").select(*HIT_COLUMNS)


@query(
    "e3_search_by_id",
    f"SELECT id AS place_id, canonical_name_kl, municipality FROM ({SQL_CURRENT_PLACES}) WHERE id = 'plc_0000000009'",
)
def _(spark, sf):
    return search.search_places(domain_tables(spark, sf), "plc_0000000009").select("place_id", "canonical_name_kl", "municipality")


@query(
    "e3_list_places",
    f"""SELECT id AS place_id, canonical_name_kl FROM ({SQL_CURRENT_PLACES})""",
)
def _(spark, sf):
    return search.list_places(domain_tables(spark, sf)).select("place_id", "canonical_name_kl")


def sql_field_score(f: str, q: str = "q") -> str:
    return f"""CASE WHEN length({f}) = 0 THEN NULL WHEN {f} = {q} THEN 1000 WHEN starts_with({f}, {q}) THEN 820 - least(80, length({f}) - length({q}))
        WHEN list_contains(regexp_split_to_array({f}, '[\\s,/:-]+'), {q}) THEN 700
        WHEN len(list_filter(regexp_split_to_array({f}, '[\\s,/:-]+'), lambda w: starts_with(w, {q}))) > 0 THEN 640
        WHEN contains({f}, {q}) THEN 420 - least(100, position({q} IN {f}) - 1) END"""


def sql_fuzzy(f: str, q: str = "q") -> str:
    two = f"""((abs(length({f}) - length({q})) <= 1 AND greatest(length({f}), length({q})) <= 8)
        OR (length({q}) <= 5 AND length({f}) = length({q})))"""
    return f"""CASE WHEN is_locality AND length({q}) BETWEEN 3 AND 12 AND length({f}) BETWEEN 1 AND 18 THEN
        CASE WHEN {two} THEN CASE WHEN levenshtein({f}, {q}) <= 2 THEN 940 END
             WHEN levenshtein({f}, {q}) <= 1 THEN 980 END END"""


SQL_FOLD = "lower(regexp_replace(trim({}), '\\s+', ' ', 'g'))"
SQL_SCORED = f"""SELECT *, {sql_field_score('o')} * 1.0 AS so, {sql_field_score('d')} * 0.96 AS sd, {sql_field_score('h')} * 0.72 AS sh,
        {sql_fuzzy('o')} AS fo, {sql_fuzzy('d')} AS fd
    FROM (SELECT p.*, {SQL_FOLD.format('official_name')} AS o, coalesce({SQL_FOLD.format('danish_name')}, '') AS d,
                 coalesce({SQL_FOLD.format('old_official_name')}, '') AS h FROM ({SQL_PLACES}) p WHERE NOT is_locality_shadow),
         (SELECT query_id, {SQL_FOLD.format('q')} AS q FROM v_name_queries) qs WHERE length(q) >= 2"""
SQL_RANK = f"""SELECT query_id, global_id, importance, danish_name, old_official_name, official_name,
        CASE WHEN best IS NULL THEN (CASE WHEN fo IS NOT NULL THEN 'official' ELSE 'danish' END)
             WHEN so = best THEN 'official' WHEN sd = best THEN 'danish' ELSE 'historical' END AS matched_field,
        coalesce(best, fo, fd) + CASE WHEN feature_kind = 'town' THEN 500 WHEN feature_kind = 'settlement' THEN 420
            WHEN importance >= 700 THEN 80 WHEN importance >= 500 THEN 40 ELSE 0 END + importance / 100.0
            - least(20, length(official_name)) * 0.15 AS score
    FROM (SELECT *, greatest(so, sd, sh) AS best FROM ({SQL_SCORED})) WHERE coalesce(best, fo, fd) IS NOT NULL"""


@query(
    "e6_e10_ranked_search",
    f"""SELECT query_id, global_id, CAST(round(score, 4) AS DOUBLE) AS score, matched_field, position, CASE
            WHEN matched_field = 'danish' AND danish_name <> official_name THEN danish_name
            WHEN matched_field = 'historical' AND old_official_name <> official_name THEN old_official_name END AS alternate
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, importance DESC, length(official_name), global_id) AS position
              FROM ({SQL_RANK})) WHERE position <= 12""",
)
def _(spark, sf):
    places = written(_enriched(spark, sf))
    hits = search.rank_search(places, view(spark, sf, "v_name_queries"), 12).drop("importance")
    names = places.select("global_id", "official_name", "danish_name", "old_official_name").hint("merge")
    shown = hits.join(names, "global_id")
    return shown.select(
        "query_id", "global_id", F.round("score", 4).alias("score"), "matched_field", "position",
        search.alternate_text(shown).alias("alternate"),
    )


@query(
    "e9_all_scored_hits",
    f"SELECT query_id, global_id, CAST(round(score, 4) AS DOUBLE) AS score, matched_field FROM ({SQL_RANK})",
)
def _(spark, sf):
    hits = search.rank_search(_enriched(spark, sf), view(spark, sf, "v_name_queries"), digits=4)
    return hits.select("query_id", "global_id", "score", "matched_field")


@query(
    "e7_best_field_of_pairs",
    f"""SELECT record_id, CAST(round(greatest(so, sd, sh), 4) AS DOUBLE) AS score FROM (
          SELECT record_id, {sql_field_score('o')} * 1.0 AS so, {sql_field_score('d')} * 0.96 AS sd, {sql_field_score('h')} * 0.72 AS sh
          FROM (SELECT record_id, {SQL_FOLD.format('official_name')} AS o, coalesce({SQL_FOLD.format('danish_name')}, '') AS d,
                coalesce({SQL_FOLD.format('old_official_name')}, '') AS h, substr(old_official_name, 3, 9) AS q FROM v_features))""",
)
def _(spark, sf):
    q = F.substring("old_official_name", 3, 9)
    best = search.best_field(F.col("official_name"), F.col("danish_name"), F.col("old_official_name"), q)
    return _features(spark, sf).select("record_id", F.round(best["score"], 4).alias("score"))


@query(
    "e8_fuzzy_pairs",
    f"""SELECT record_id, {sql_fuzzy('o')} AS score FROM (SELECT record_id, TRUE AS is_locality, official_name AS o,
          substr(official_name, 1, 4) || substr(official_name, 6, 7) AS q FROM v_features)""",
)
def _(spark, sf):
    o = F.col("official_name")
    q = F.concat(F.substring(o, 1, 4), F.substring(o, 6, 7))
    return _features(spark, sf).select("record_id", search.locality_fuzzy(o, q).cast("int").alias("score"))


@query(
    "e11_unaccent_search",
    f"""SELECT record_id FROM ({SQL_RANKED}) WHERE contains(strip_accents(lower(official_name || ' ' || coalesce(danish_name, '') || ' '
          || coalesce(old_official_name, '') || ' ' || coalesce(municipality_name, ''))), 'kommuneqarfik')""",
)
def _(spark, sf):
    rows = gazetteer.classify_features(_features(spark, sf))
    return search.unaccent_search(rows, "  KÓMMUNEqarfik").select("record_id")


@query(
    "e11_unaccent_search_of_many",
    f"""SELECT q.record_id AS query_id, r.record_id FROM (SELECT record_id, strip_accents(lower(trim(substr(official_name, 3, 6)))) AS q FROM v_features
          WHERE record_id % 50 = 0) q JOIN ({SQL_RANKED}) r ON q.q <> '' AND contains(strip_accents(lower(r.official_name || ' ' || coalesce(r.danish_name, '')
          || ' ' || coalesce(r.old_official_name, '') || ' ' || coalesce(r.municipality_name, ''))), q.q)""",
)
def _(spark, sf):
    """A piece of the name of every feature whose number is divisible by 50."""
    rows = _features(spark, sf)
    queries = rows.where("record_id % 50 = 0").select(F.col("record_id").alias("query_id"), F.substring("official_name", 3, 6).alias("q"))
    return token_index.unaccent_search_many(gazetteer.classify_features(rows), queries).select("query_id", "record_id")


@query(
    "e12_near_duplicate_pairs",
    f"""SELECT record_id, {sql_near('a', 'b')} AS near FROM (SELECT record_id, substr(official_name, 1, 5 + CAST(record_id % 6 AS INT)) AS a,
          substr(official_name, 2, 4 + CAST(record_id % 5 AS INT)) AS b FROM v_features)""",
)
def _(spark, sf):
    k = F.col("record_id")
    a = F.substring(F.col("official_name"), F.lit(1), (k % 6 + 5).cast("int"))
    b = F.substring(F.col("official_name"), F.lit(2), (k % 5 + 4).cast("int"))
    return _features(spark, sf).select("record_id", text.near_duplicate(a, b).alias("near"))


@query("e13_locality_shadows", f"SELECT global_id, is_locality_shadow FROM ({SQL_PLACES})")
def _(spark, sf):
    rows = gazetteer.classify_features(_features(spark, sf))
    return gazetteer.flag_shadows(rows).select("global_id", "is_locality_shadow")


# --- resolution -------------------------------------------------------------------

SQL_LIVE_NAMES = """SELECT DISTINCT n.place_id, lower(n.value) AS v FROM v_place_names n JOIN v_places p ON p.id = n.place_id
    WHERE n.valid_to IS NULL AND p.status <> 'retired'"""
SQL_REQUESTS = """SELECT s_suppkey AS request_id, 'ns_' || CAST(s_nationkey % 3 AS STRING) AS ns,
      CASE WHEN s_suppkey % 3 = 0 THEN 'X' || CAST(s_suppkey AS STRING) END AS idv,
      CASE s_suppkey % 4 WHEN 0 THEN p_name || ' ' || CAST(s_suppkey % 40 AS STRING) WHEN 1 THEN ' ' || substr(upper(p_name), 3, 7) || ' '
           WHEN 2 THEN 'Customer#00000' || CAST(1000 + s_suppkey AS STRING) END AS name,
      CASE WHEN s_suppkey % 11 = 5 THEN s_nationkey END AS code
    FROM supplier JOIN part ON p_partkey = s_suppkey"""


def _requests(spark, sf):
    rows = base(spark, sf, "supplier").join(
        base(spark, sf, "part").select(F.col("p_partkey").alias("s_suppkey"), "p_name"), "s_suppkey"
    )
    k = F.col("s_suppkey")
    ns = F.concat(F.lit("ns_"), (F.col("s_nationkey") % 3).cast("string"))
    one = F.array(F.struct(ns.alias("namespace"), F.concat(F.lit("X"), k.cast("string")).alias("value")))
    name = (
        F.when(k % 4 == 0, F.concat_ws(" ", "p_name", (k % 40).cast("string")))
        .when(k % 4 == 1, F.concat(F.lit(" "), F.substring(F.upper("p_name"), 3, 7), F.lit(" ")))
        .when(k % 4 == 2, F.concat(F.lit("Customer#00000"), (k + 1000).cast("string")))
    )
    return rows.select(
        k.alias("request_id"),
        F.when(k % 3 == 0, one).alias("identifiers"),
        name.alias("name"),
        F.when(k % 11 == 5, F.col("s_nationkey")).alias("municipality_code"),
    )


SQL_EVIDENCE = f"""
    SELECT request_id, x.entity_id AS place_id, 1.0 AS confidence, 'external_identifier_exact' AS reason
    FROM req JOIN v_external_identifiers x ON x.namespace = ns AND x.value = idv AND x.entity_type = 'place'
         AND (x.valid_to IS NULL OR x.valid_to >= DATE '2000-10-01')
    UNION ALL SELECT request_id, place_id, 0.95, 'official_name_exact' FROM exact
    UNION ALL SELECT request_id, place_id, 0.6, 'name_partial' FROM (
        SELECT DISTINCT request_id, place_id FROM req JOIN ({SQL_LIVE_NAMES}) ON contains(v, lower(trim(name)))
        WHERE request_id NOT IN (SELECT request_id FROM exact))"""
SQL_HINT = f"""SELECT DISTINCT request_id, p.id AS place_id, 0.5 AS confidence, 'municipality_hint' AS reason
    FROM req JOIN v_administrative_areas a ON contains(a.name, CAST(code AS STRING))
    JOIN ({SQL_CURRENT_PLACES}) p ON p.municipality_id = a.id"""
SQL_REQ_CTE = f"""WITH req AS ({SQL_REQUESTS}), exact AS (SELECT DISTINCT request_id, place_id FROM req
    JOIN ({SQL_LIVE_NAMES}) ON v = lower(trim(name))), evidence AS ({SQL_EVIDENCE} UNION ALL {SQL_HINT})"""


SQL_CODE_HINTS = f"""SELECT DISTINCT request_id, a.id AS municipality_id FROM req
    JOIN v_administrative_areas a ON a.id = 'adm_' || lpad(CAST(code AS STRING), 10, '0')
    WHERE a.id IN (SELECT municipality_id FROM ({SQL_CURRENT_PLACES}))"""


@query(
    "e5_resolve_candidates",
    f"""WITH req AS ({SQL_REQUESTS}), exact AS (SELECT DISTINCT request_id, place_id FROM req
          JOIN ({SQL_LIVE_NAMES}) ON v = lower(trim(name))), named AS MATERIALIZED ({SQL_EVIDENCE}), hints AS MATERIALIZED ({SQL_CODE_HINTS}),
        evidence AS (SELECT * FROM named UNION ALL SELECT h.request_id, p.id, 0.5, 'municipality_hint' FROM hints h
          JOIN ({SQL_CURRENT_PLACES}) p ON p.municipality_id = h.municipality_id)
        SELECT request_id, place_id, CAST(max(confidence) AS DOUBLE) AS confidence,
          string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM evidence GROUP BY request_id, place_id""",
)
def _(spark, sf):
    """Hints by code, each as all current places of the municipality."""
    codes = base(spark, sf, "nation").select(
        F.col("n_nationkey").alias("municipality_code"),
        F.concat(F.lit("adm_"), F.lpad(F.col("n_nationkey").cast("string"), 10, "0")).alias("municipality_id"),
    )
    rows = resolve.all_candidates(domain_tables(spark, sf), _requests(spark, sf), "2000-10-01", codes)
    return rows.withColumn("reasons", F.array_join(F.array_sort("reasons"), ","))


@query(
    "e5_resolve_verdicts",
    f"""{SQL_REQ_CTE} SELECT r.request_id, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous'
          WHEN c >= 0.95 AND by_id THEN 'resolved' ELSE 'candidate' END AS result
        FROM req r LEFT JOIN (SELECT request_id, count(DISTINCT place_id) AS n, max(confidence) AS c,
             bool_or(reason = 'external_identifier_exact') AS by_id FROM evidence GROUP BY request_id) e ON e.request_id = r.request_id""",
)
def _(spark, sf):
    return resolve.resolve_places(domain_tables(spark, sf), _requests(spark, sf), "2000-10-01").select("request_id", "result")


SQL_SEEDS = """SELECT {0} AS place_id, CASE k % 5 WHEN 0 THEN 'matched' WHEN 1 THEN 'missing' ELSE 'candidate_exact_name' END AS status,
    '{{x' || CAST(k % 400 AS STRING) || '}}' AS record_id, c_name AS official_name FROM v_places""".format("id")


def _seeds(spark, sf):
    k = F.col("k")
    return view(spark, sf, "v_places").select(
        F.col("id").alias("place_id"),
        F.when(k % 5 == 0, "matched").when(k % 5 == 1, "missing").otherwise("candidate_exact_name").alias("status"),
        F.concat(F.lit("{x"), (k % 400).cast("string"), F.lit("}")).alias("record_id"),
        F.col("c_name").alias("official_name"),
    )


@query(
    "e14_crosswalk",
    f"""SELECT global_id, arg_min(place_id, (rank, place_id)) AS place_id, arg_min(status, (rank, place_id)) AS identity_status FROM (
          SELECT upper(value) AS global_id, entity_id AS place_id, 'canonical' AS status, 0 AS rank FROM v_external_identifiers
          WHERE entity_type = 'place' AND namespace = 'ns_1'
          UNION ALL SELECT upper(replace(replace(record_id, '{{', ''), '}}', '')), place_id,
                 CASE status WHEN 'matched' THEN 'canonical' ELSE 'candidate' END, 1 FROM ({SQL_SEEDS}) WHERE status <> 'missing')
        GROUP BY global_id""",
)
def _(spark, sf):
    made = resolve.build_crosswalk(domain_tables(spark, sf)["external_identifiers"], _seeds(spark, sf), "ns_1")
    return made.select("global_id", "place_id", "identity_status")


@query(
    "e15_attached_identity",
    """SELECT record_id, CASE WHEN record_id % 7 = 1 OR record_id % 3 = 0 THEN 'plc_' || lpad(CAST(record_id AS STRING), 10, '0') END AS place_id,
              CASE WHEN record_id % 7 = 1 THEN CASE WHEN record_id % 2 = 0 THEN 'canonical' ELSE 'candidate' END
                   WHEN record_id % 3 = 0 THEN 'candidate' ELSE 'upstream_only' END AS identity_status FROM v_features""",
)
def _(spark, sf):
    third = F.col("record_id") % 3 == 0
    rows = _features(spark, sf).withColumn(
        "place_id", F.when(third, F.concat(F.lit("plc_"), F.lpad(F.col("record_id").cast("string"), 10, "0"))).otherwise("")
    ).withColumn("identity_status", F.when(third, "candidate").otherwise("odd"))
    return resolve.attach_identity(rows, _crosswalk(spark, sf)).select("record_id", "place_id", "identity_status")


@query(
    "e16_operational_identity",
    """SELECT record_id, 'register:' || upper(global_id) AS feature_id, 'plc_' || lpad(CAST(record_id AS STRING), 10, '0') AS place_id,
              CASE WHEN record_id % 2 = 0 THEN 'canonical' ELSE 'candidate' END AS identity_status FROM v_features WHERE record_id % 7 = 1""",
)
def _(spark, sf):
    rows = resolve.attach_identity(_features(spark, sf), _crosswalk(spark, sf))
    return resolve.has_operational_identity(rows).select("record_id", "feature_id", "place_id", "identity_status")


@query(
    "e17_shared_lookup",
    """SELECT id, min(global_id) AS global_id FROM (SELECT record_id, global_id,
            CASE record_id % 3 WHEN 0 THEN lower(global_id) WHEN 1 THEN 'plc_' || lpad(CAST(record_id AS STRING), 10, '0') ELSE 'gone' END AS id
            FROM v_features) WHERE id <> 'gone' AND (record_id % 3 = 0 OR record_id % 7 = 1) GROUP BY id""",
)
def _(spark, sf):
    places = resolve.attach_identity(_features(spark, sf), _crosswalk(spark, sf))
    k = F.col("record_id")
    ids = _features(spark, sf).select(
        F.when(k % 3 == 0, F.lower("global_id"))
        .when(k % 3 == 1, F.concat(F.lit("plc_"), F.lpad(k.cast("string"), 10, "0")))
        .otherwise("gone")
        .alias("id")
    )
    return resolve.lookup_shared(places, ids)


@query(
    "e18_name_keys",
    """SELECT doc_id, turn, k FROM (SELECT conv_id AS doc_id, turn, array_to_string(list_filter(regexp_split_to_array(
         replace(nfc_normalize(lower(text)), 'ß', 'ss'), '\\s+'), lambda w: w <> ''), ' ') AS k FROM conversations)""",
)
def _(spark, sf):
    return base(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), "turn", text.name_key(F.col("text")).alias("k")
    )


# --- reconciliation -----------------------------------------------------------------

AUTHORITIES = ("names", "survey", "later")
SQL_AUTHORITY = """SELECT CASE k % 2 WHEN 0 THEN 'names' ELSE 'survey' END AS namespace, 'r' || CAST(k AS STRING) AS record_id,
      CASE WHEN k % 9 = 0 THEN c_name ELSE p_name || ' ' || CAST(k % 40 AS STRING) END AS official_name,
      CASE WHEN k % 5 <> 0 THEN 'town' END AS feature_type, CASE WHEN k % 4 = 0 THEN -50.0 END AS longitude,
      CASE WHEN k % 4 = 0 THEN 64.0 END AS latitude, 'ID=' || CAST(k AS STRING) AS decision_ref,
      CASE WHEN k % 3 = 0 THEN id WHEN k % 31 = 1 THEN 'plc_' || lpad(CAST(k + 5 AS STRING), 10, '0') END AS confirmed_place_id
    FROM v_places"""


def _authority(spark, sf):
    places = view(spark, sf, "v_places")
    k = F.col("k")
    return places.select(
        F.when(k % 2 == 0, "names").otherwise("survey").alias("namespace"),
        F.concat(F.lit("r"), k.cast("string")).alias("record_id"),
        F.when(k % 9 == 0, F.col("c_name")).otherwise(F.concat_ws(" ", "p_name", (k % 40).cast("string"))).alias("official_name"),
        F.when(k % 5 != 0, "town").alias("feature_type"),
        F.when(k % 4 == 0, F.lit(-50.0)).alias("longitude"),
        F.when(k % 4 == 0, F.lit(64.0)).alias("latitude"),
        F.concat(F.lit("ID="), k.cast("string")).alias("decision_ref"),
        F.when(k % 3 == 0, F.col("id"))
        .when(k % 31 == 1, F.concat(F.lit("plc_"), F.lpad((k + 5).cast("string"), 10, "0")))
        .alias("confirmed_place_id"),
    )


@query(
    "e19_check_authority",
    """SELECT 'pair' AS rule, 'survey/r' || CAST(k AS STRING) AS key FROM v_places WHERE k % 2 = 1 AND k % 6 = 5
       UNION ALL SELECT 'namespace', 'odd/r' || CAST(k AS STRING) FROM v_places WHERE k % 2 = 0 AND k % 8 = 2
       UNION ALL SELECT 'range', CASE WHEN k % 8 = 2 THEN 'odd' WHEN k % 2 = 0 THEN 'names' ELSE 'survey' END || '/r' || CAST(k AS STRING)
             FROM v_places WHERE k % 14 = 4""",
)
def _(spark, sf):
    k = F.regexp_extract("record_id", r"(\d+)", 1).cast("long")
    rows = _authority(spark, sf).withColumns(
        {
            "namespace": F.when(k % 8 == 2, "odd").otherwise(F.col("namespace")),
            "longitude": F.when(k % 14 == 4, F.lit(200.0)).when((k % 2 == 1) & (k % 6 == 5), F.lit(1.0)).otherwise(F.col("longitude")),
            "latitude": F.when(k % 14 == 4, F.lit(1.0)).otherwise(F.col("latitude")),
        }
    )
    return reconcile.check_authority(rows, ("names", "survey")).select("rule", "key")


SQL_MATCHES = f"""WITH auth AS ({SQL_AUTHORITY}), nm AS (SELECT place_id, arg_max(value, id) AS value FROM v_place_names
        WHERE valid_to IS NULL AND kind = 'official' AND language = 'kl' GROUP BY place_id),
    cls AS (SELECT place_id, arg_max(feature_type, id) AS feature_type FROM v_place_classifications WHERE valid_to IS NULL GROUP BY place_id),
    geo AS (SELECT place_id, arg_max(lon, id) AS lon, arg_max(lat, id) AS lat FROM v_place_geometries WHERE valid_to IS NULL GROUP BY place_id),
    conf AS (SELECT namespace, confirmed_place_id AS place_id, count(*) AS n, min(record_id) AS r FROM auth
             WHERE confirmed_place_id IS NOT NULL GROUP BY ALL),
    cand AS (SELECT namespace, lower(official_name) AS nk, count(*) AS n, min(record_id) AS r FROM auth GROUP BY ALL),
    m AS (SELECT p.id AS place_id, a.namespace, nm.value, cls.feature_type, geo.lon, geo.lat,
        CASE WHEN conf.n > 1 THEN 'ambiguous_confirmation' WHEN conf.n = 1 THEN 'confirmed' WHEN a.namespace = 'later' THEN 'waiting_for_export'
             WHEN cand.n = 1 THEN 'candidate_exact_name' WHEN cand.n > 1 THEN 'ambiguous_exact_name' ELSE 'missing' END AS status,
        CASE WHEN conf.n = 1 THEN conf.r WHEN conf.n IS NULL AND cand.n = 1 THEN cand.r END AS record_id, coalesce(cand.n, 0) AS candidate_count
      FROM v_places p JOIN nm ON nm.place_id = p.id CROSS JOIN (VALUES ('names'), ('survey'), ('later')) a(namespace)
      LEFT JOIN cls ON cls.place_id = p.id LEFT JOIN geo ON geo.place_id = p.id
      LEFT JOIN conf ON conf.place_id = p.id AND conf.namespace = a.namespace
      LEFT JOIN cand ON cand.nk = lower(nm.value) AND cand.namespace = a.namespace),
    d AS (SELECT m.*, CASE WHEN x.record_id IS NULL THEN 0 ELSE CAST(x.official_name <> m.value AS INT)
          + coalesce(CAST(x.feature_type <> m.feature_type AS INT), 0)
          + coalesce(CAST(x.longitude <> m.lon OR x.latitude <> m.lat AS INT), 0) END AS differences
          FROM m LEFT JOIN auth x ON x.record_id = m.record_id AND x.namespace = m.namespace)"""


@query("e20_reconcile_matches", f"{SQL_MATCHES} SELECT place_id, namespace, status, record_id, candidate_count, differences FROM d")
def _(spark, sf):
    rows = reconcile.reconcile_matches(domain_tables(spark, sf), _authority(spark, sf), AUTHORITIES)
    return rows.select(
        "place_id", "namespace", "status", "record_id", "candidate_count", F.size("differences").alias("differences")
    )


@query("e20_candidate_records", f"SELECT namespace, lower(official_name) AS name_key, record_id FROM ({SQL_AUTHORITY})")
def _(spark, sf):
    return reconcile.candidate_records(_authority(spark, sf))


SQL_CHOSEN = "FROM m JOIN auth x ON x.record_id = m.record_id AND x.namespace = m.namespace"


@query(
    "e20_match_differences",
    f"""{SQL_MATCHES}
        SELECT m.place_id, m.namespace, m.record_id, 'official_name' AS field, m.value AS seed, x.official_name AS authority,
               NULL::DOUBLE AS seed_lon, NULL::DOUBLE AS authority_lat {SQL_CHOSEN} WHERE x.official_name <> m.value
        UNION ALL SELECT m.place_id, m.namespace, m.record_id, 'feature_type', m.feature_type, x.feature_type, NULL, NULL
               {SQL_CHOSEN} WHERE x.feature_type <> m.feature_type
        UNION ALL SELECT m.place_id, m.namespace, m.record_id, 'geometry', NULL, NULL, m.lon, x.latitude
               {SQL_CHOSEN} WHERE x.longitude <> m.lon OR x.latitude <> m.lat""",
)
def _(spark, sf):
    rows = reconcile.match_differences(reconcile.reconcile_matches(domain_tables(spark, sf), _authority(spark, sf), AUTHORITIES))
    spot = F.col("field") == "geometry"
    number = lambda c, i: F.when(spot, F.split(c, " ")[i].cast("double"))
    text = lambda c: F.when(~spot, F.col(c)).alias(c)
    return rows.select(
        "place_id", "namespace", "record_id", "field", text("seed"), text("authority"),
        number("seed", 0).alias("seed_lon"), number("authority", 1).alias("authority_lat"),
    )


@query(
    "e20_e21_reconcile_counts",
    f"""{SQL_MATCHES}, o AS (SELECT place_id, CASE WHEN bool_and(status = 'confirmed') THEN
            CASE WHEN max(differences) > 0 THEN 'conflicting' ELSE 'matched' END
            WHEN bool_or(status = 'missing') THEN 'missing' WHEN bool_or(status LIKE 'ambiguous%') THEN 'conflicting' ELSE 'unresolved' END AS status
          FROM d WHERE namespace <> 'later' GROUP BY place_id) SELECT status, count(*) AS places FROM o GROUP BY status""",
)
def _(spark, sf):
    report = reconcile.reconcile(domain_tables(spark, sf), _authority(spark, sf), AUTHORITIES[:2])
    return reconcile.reconcile_counts(report)


def _feed(spark, sf):
    r = view(spark, sf, "v_register")
    return r.select(
        "record_id", F.col("gid").alias("global_id"), F.col("official_raw").alias("official_name"), "type_code",
        "municipality_code", F.col("danish_raw").alias("danish_name"),
    )


SQL_NORMAL = """SELECT replace(replace(gid, '{', ''), '}', '') AS record_id, trim(official_raw) AS official_name,
    CASE type_code WHEN 21 THEN 'town' ELSE 'settlement' END AS feature_type, 'ID=' || CAST(record_id AS STRING) AS decision_ref,
    record_id AS k, municipality_code, nullif(trim(danish_raw), '') AS danish
    FROM v_register WHERE type_code IN (21, 23) AND record_id <> 10 AND trim(official_raw) <> ''"""


@query("e22_normalized_authority", f"SELECT record_id, official_name, feature_type, decision_ref FROM ({SQL_NORMAL})")
def _(spark, sf):
    return reconcile.normalize_authority(_feed(spark, sf), "names", (10,)).drop("namespace")


@query(
    "e22_authority_problems",
    """SELECT replace(replace(gid, '{', ''), '}', '') AS global_id, 'missing official name' AS problem FROM v_register
       WHERE (type_code IN (21, 23)) AND trim(official_raw) = ''""",
)
def _(spark, sf):
    return reconcile.authority_problems(_feed(spark, sf))


@query(
    "e23_carried_confirmations",
    f"""SELECT record_id, CASE WHEN k % 4 = 0 THEN 'by_ref_' || CAST(k AS STRING) WHEN k % 4 = 1 THEN 'by_rec_' || record_id END AS confirmed_place_id
        FROM ({SQL_NORMAL})""",
)
def _(spark, sf):
    rows = reconcile.normalize_authority(_feed(spark, sf), "names", (10,))
    k = F.substring_index("decision_ref", "=", -1).cast("long")
    previous = rows.where(k % 4 < 2).select(
        F.when(k % 4 == 0, F.concat(F.lit("old"), F.col("record_id"))).otherwise(F.col("record_id")).alias("record_id"),
        F.when(k % 4 == 0, F.col("decision_ref")).alias("decision_ref"),
        F.when(k % 4 == 0, F.concat(F.lit("by_ref_"), k.cast("string")))
        .otherwise(F.concat(F.lit("by_rec_"), F.col("record_id")))
        .alias("confirmed_place_id"),
    )
    return reconcile.carry_confirmations(rows, previous).select("record_id", "confirmed_place_id")


def _open_rows(spark, sf):
    rows = reconcile.normalize_authority(_feed(spark, sf), "names", (10,))
    k = F.substring_index("decision_ref", "=", -1).cast("long")
    return rows.withColumn("confirmed_place_id", F.when(k % 8 == 0, F.lit("plc_x")))


SQL_WANTED = f"SELECT DISTINCT official_name AS name FROM ({SQL_NORMAL}) WHERE k % 3 = 0 UNION SELECT 'no such name'"
SQL_FREE = f"SELECT official_name, count(*) AS n, min(record_id) AS r FROM ({SQL_NORMAL}) WHERE k % 8 <> 0 GROUP BY official_name"


@query(
    "e24_select_imports_by_name",
    f"""SELECT w.name AS wanted, CASE WHEN f.n IS NULL THEN 'missing' WHEN f.n > 1 THEN 'homonym' ELSE 'selected ' || r END AS outcome
        FROM ({SQL_WANTED}) w LEFT JOIN ({SQL_FREE}) f ON f.official_name = w.name""",
)
def _(spark, sf):
    rows = _open_rows(spark, sf)
    k = F.substring_index("decision_ref", "=", -1).cast("long")
    names = rows.where(k % 3 == 0).select(F.col("official_name").alias("name")).union(spark.sql("SELECT 'no such name'"))
    chosen, problems = reconcile.select_imports(rows, names=names)
    return chosen.select(
        F.col("official_name").alias("wanted"), F.concat(F.lit("selected "), F.col("record_id")).alias("outcome")
    ).union(problems)


@query(
    "e24_select_imports_by_id",
    f"""SELECT record_id AS wanted, CASE WHEN k % 8 = 0 THEN 'already confirmed' ELSE 'selected' END AS outcome FROM ({SQL_NORMAL}) WHERE k % 2 = 0
        UNION ALL SELECT record_id || 'zz', 'missing' FROM ({SQL_NORMAL}) WHERE k % 5 = 0""",
)
def _(spark, sf):
    rows = _open_rows(spark, sf)
    k = F.substring_index("decision_ref", "=", -1).cast("long")
    ids = rows.where(k % 2 == 0).select(F.concat(F.lit("{"), F.col("record_id"), F.lit("}")).alias("record_id")).union(
        rows.where(k % 5 == 0).select(F.concat("record_id", F.lit("zz")))
    )
    chosen, problems = reconcile.select_imports(rows, record_ids=ids)
    return chosen.select(F.col("record_id").alias("wanted"), F.lit("selected").alias("outcome")).union(problems)


@query(
    "e25_minted_localities",
    f"""WITH src AS (SELECT * FROM ({SQL_NORMAL})), ok AS (SELECT * FROM src WHERE municipality_code IN (955, 956, 957, 959, 960) AND k % 6 <> 0)
        SELECT 'places' AS kind, record_id, 'active' AS v FROM ok
        UNION ALL SELECT 'place_classifications', record_id, feature_type FROM ok
        UNION ALL SELECT 'place_names', record_id, official_name FROM ok
        UNION ALL SELECT 'place_names', record_id, danish FROM ok WHERE danish IS NOT NULL
        UNION ALL SELECT 'external_identifiers', record_id, record_id FROM ok
        UNION ALL SELECT 'administrative_memberships', record_id, 'adm_' || CAST(municipality_code AS STRING) FROM ok
        UNION ALL SELECT 'problems', record_id, CASE WHEN k % 6 = 0 THEN 'id already in source' ELSE 'unknown municipality code' END
           FROM src WHERE k NOT IN (SELECT k FROM ok)""",
)
def _(spark, sf):
    rows = reconcile.normalize_authority(_feed(spark, sf), "names", (10,))
    k = F.substring_index("decision_ref", "=", -1).cast("long")
    attributes = _feed(spark, sf).select(
        text.strip_gid(F.col("global_id")).alias("record_id"), "municipality_code", "danish_name"
    )
    areas = spark.sql("SELECT * FROM VALUES (955), (956), (957), (959), (960) AS t(municipality_code)").withColumn(
        "administrative_area_id", F.concat(F.lit("adm_"), F.col("municipality_code").cast("string"))
    )
    existing = rows.where(k % 6 == 0).select(
        F.lit("names.gid").alias("namespace"), F.lit("place").alias("entity_type"), F.lit(None).cast("date").alias("valid_to"),
        F.col("record_id").alias("value"),
    )
    made = reconcile.mint_localities(rows, attributes, areas, existing, "src_names", "names.gid", "2001-01-02", "2001-01-01")
    cited = F.col("source_refs")[0]["record_id"]
    parts = [
        ("places", cited, F.col("status")), ("place_classifications", cited, F.col("feature_type")),
        ("place_names", cited, F.col("value")), ("external_identifiers", cited, F.col("value")),
        ("administrative_memberships", cited, F.col("administrative_area_id")),
        ("problems", F.col("record_id"), F.col("problem")),
    ]
    out = None
    for kind, record, value in parts:
        piece = made[kind].select(F.lit(kind).alias("kind"), record.alias("record_id"), value.alias("v"))
        out = piece if out is None else out.unionByName(piece)
    return out


@query(
    "e26_rewritten_ids",
    """SELECT id, CASE WHEN k % 4 = 0 AND nk = 3 AND pre = '' THEN 'new_' || rec ELSE pre || rec END AS record_id FROM (
         SELECT n.id, p.k, p.nk, p.record_id AS rec, CASE WHEN n.record_id LIKE 'old_%' THEN 'old_' ELSE '' END AS pre
         FROM v_place_names n JOIN v_places p ON p.id = n.place_id)""",
)
def _(spark, sf):
    places = view(spark, sf, "v_places").where(F.col("k") % 4 == 0)
    mapping = places.select(F.col("record_id").alias("old"), F.concat(F.lit("new_"), F.col("record_id")).alias("new"))
    t = domain_tables(spark, sf)
    done = reconcile.rewrite_ids(t, mapping, "src_0000000003", "ns_1")
    return done["place_names"].select("id", F.col("source_refs")[0]["record_id"].alias("record_id"))


@query(
    "e26_rotated_ids",
    """SELECT x.value AS old, 'n' || x.value AS new FROM v_external_identifiers x JOIN v_places p ON p.id = x.entity_id
       WHERE x.entity_type = 'place' AND x.namespace = 'ns_1' AND x.valid_to IS NULL AND p.k % 2 = 0 GROUP BY ALL""",
)
def _(spark, sf):
    t = domain_tables(spark, sf)
    held = t["external_identifiers"].where(
        (F.col("entity_type") == "place") & (F.col("namespace") == "ns_1") & F.col("valid_to").isNull()
    )
    even = t["places"].where(F.substring("id", -1, 1).cast("int") % 2 == 0).select(F.col("id").alias("entity_id"))
    authority = held.join(even, "entity_id", "left_semi").groupBy("entity_id").agg(F.max("value").alias("v")).select(
        F.col("entity_id").alias("confirmed_place_id"), F.concat(F.lit("n"), F.col("v")).alias("record_id")
    )
    return reconcile.rotated_ids(t, authority, "ns_1")


@query(
    "e27_updated_source",
    """SELECT id, CASE WHEN id = 'src_0000000002' THEN 'sha256:1' END AS checksum,
              CASE WHEN id = 'src_0000000002' THEN DATE '2002-02-02' ELSE retrieved_at END::STRING AS retrieved_at,
              CASE WHEN id = 'src_0000000002' THEN 'about ' || title || '. Raw snapshot: s/2' ELSE 'about ' || title || '. Raw snapshot: s/1' END AS notes
       FROM v_sources""",
)
def _(spark, sf):
    rows = domain_tables(spark, sf)["sources"].withColumn(
        "notes", F.concat(F.lit("about "), F.col("title"), F.lit(". Raw snapshot: s/1"))
    )
    done = reconcile.update_source(rows, "src_0000000002", "sha256:1", "2002-02-02", "s/2")
    return done.select("id", "checksum", F.col("retrieved_at").cast("string").alias("retrieved_at"), "notes")
