"""Enrichment and selection of gazetteer features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accessgraph.functions import geo, text
from accessgraph.session import written

# Feature type labels of the register.
TYPE_LABELS: dict[int, str] = {
    0: "Banke", 5: "Ankerplads", 8: "Fjeldvæg", 10: "Bredning", 11: "Skråning", 12: "Bræ",
    13: "Dal", 17: "Kombination", 18: "Bugt", 19: "Bund", 21: "By", 22: "Bydel", 23: "Bygd",
    24: "Avlested", 26: "Munding", 29: "Lavning", 31: "Delta", 35: "Elv", 36: "Elve",
    37: "Slette", 40: "Hytte", 41: "Fangstplads", 44: "Fjeldområde", 48: "Fjeldknold",
    49: "Fjeld", 50: "Plateau", 51: "Fjeldryg", 54: "Top", 56: "Fjordarm", 57: "Fjord",
    58: "Landingsbane", 59: "Forbjerg", 64: "Vandfald", 65: "Fuglefjeld", 68: "Nedlagt bosted",
    73: "Halvø", 74: "Havn", 82: "Bakke", 86: "Vig", 87: "Isområde", 88: "Indlandsis",
    95: "Klippe", 96: "Kløft", 101: "Kyst", 105: "Landareal", 117: "Nunatak", 118: "Næs",
    119: "Odde", 123: "Overbæringssted", 124: "Pas", 127: "Pynt", 131: "Ruin",
    132: "Eskimoisk ruin", 134: "Nordboruin", 140: "Skrænt", 143: "Skær", 146: "Slædevej",
    149: "Indsnævring", 155: "Nedlagt station", 158: "Sten", 159: "Varde", 163: "Strand",
    164: "Stræde", 165: "Strøm", 166: "Sund", 167: "Sø", 170: "Søer", 173: "Tange", 178: "Hav",
    181: "Ø", 182: "Del af ø", 183: "Øgruppe", 184: "Andet", 186: "Stor havområde",
    187: "Stor landområde",
}
# Importance and earliest zoom by type.
TYPE_RANKS: dict[int, tuple[int, float]] = {
    8: (270, 10.0), 10: (700, 5.2), 12: (650, 5.8), 13: (440, 8.2), 18: (680, 5.6),
    21: (1000, 2.2), 22: (520, 9.0), 23: (920, 5.6), 35: (450, 8.2), 44: (540, 7.2),
    49: (520, 7.4), 54: (390, 8.8), 56: (660, 6.0), 57: (760, 4.6), 59: (410, 8.5),
    68: (480, 8.0), 73: (670, 5.6), 74: (510, 7.5), 86: (420, 8.5), 88: (780, 4.2),
    96: (260, 10.0), 101: (430, 8.4), 105: (560, 7.0), 117: (400, 8.6), 118: (320, 9.4),
    119: (280, 9.8), 123: (250, 10.2), 127: (290, 9.8), 164: (730, 5.2),
    166: (740, 5.0), 167: (460, 8.0), 178: (820, 3.8), 186: (860, 3.2), 187: (880, 3.2),
}
DEFAULT_RANK = (180, 10.5)
# Coastal types (code, kind, glyph, shape, earliest zoom, importance).
COASTAL_TYPES = (
    (143, "skerry", "×", "cross", 9.6, 300),
    (181, "island", "○", "circle", 7.0, 600),
    (182, "island_part", "·", "dot", 9.0, 380),
    (183, "island_group", "◎", "ring", 5.8, 720),
)
TYPE_RANKS |= {code: (importance, zoom) for code, _, _, _, zoom, importance in COASTAL_TYPES}
COASTAL_CODES = tuple(row[0] for row in COASTAL_TYPES)
# Area labels, locality types, zoom bands and geography groups.
MUNICIPALITIES = {
    955: "Kommune Kujalleq", 956: "Kommuneqarfik Sermersooq", 957: "Qeqqata kommunia",
    959: "Kommune Qeqertalik", 960: "Avannaata kommunia",
}
OTHER_AREAS = {961: "National park / other area", 999: "National park"}
TOWN, SETTLEMENT = 21, 23
LOCALITY_TYPES = (TOWN, SETTLEMENT)
BAND_MIN_ZOOM = {"town": 2.2, "settlement": 5.6, "major": 5.8, "regional": 7.0, "local": 8.6, "detail": 10.6}
WATER_TYPES = (10, 18, 56, 57, 86, 164, 166, 167, 170, 178, 186)
ISLAND_TYPES = (73, 181, 182, 183)

SHADOW_DEGREES = 0.04
REGION_MIN_IMPORTANCE = 400


def type_table(spark: SparkSession) -> DataFrame:
    """Types with label, importance and earliest zoom; a fixed table of about 70 rows."""
    codes = sorted(set(TYPE_LABELS) | set(TYPE_RANKS))
    values = ", ".join(
        "({}, '{}', {}, {}D)".format(code, TYPE_LABELS.get(code, f"Type {code}"), *TYPE_RANKS.get(code, DEFAULT_RANK))
        for code in codes
    )
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(type_code, type_label, importance, min_zoom)")


def coastal_registry(spark: SparkSession) -> DataFrame:
    values = ", ".join("({}, '{}', '{}', '{}', {}D, {})".format(*row) for row in COASTAL_TYPES)
    return spark.sql(
        f"SELECT * FROM VALUES {values} AS t(type_code, kind, glyph, shape, min_zoom, importance)"
    )


def rank_types(features: DataFrame) -> DataFrame:
    """Add ``type_label``, ``importance`` and ``min_zoom``."""
    types = type_table(features.sparkSession)
    importance, min_zoom = DEFAULT_RANK
    return (
        features.join(types, "type_code", "left")
        .withColumn("type_label", F.coalesce("type_label", F.concat(F.lit("Type "), F.col("type_code").cast("string"))))
        .withColumn("importance", F.coalesce("importance", F.lit(importance)))
        .withColumn("min_zoom", F.coalesce("min_zoom", F.lit(min_zoom)))
    )


def zoom_band() -> Column:
    rank = F.col("importance")
    return (
        F.when(F.col("type_code") == TOWN, "town")
        .when((F.col("type_code") == SETTLEMENT) | F.col("is_locality"), "settlement")
        .when(rank >= 650, "major")
        .when(rank >= 500, "regional")
        .when(rank >= 280, "local")
        .otherwise("detail")
    )


def band_min_zoom(band: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, zoom in BAND_MIN_ZOOM.items():
        out = F.when(band == name, F.lit(zoom)).otherwise(out)
    return out


def feature_kind(code: Column) -> Column:
    return F.when(code == TOWN, "town").when(code == SETTLEMENT, "settlement").otherwise("other")


def is_locality_type(code: Column) -> Column:
    return code.isin(*LOCALITY_TYPES)


def area_label(code: Column) -> Column:
    """Label of a municipality or another area; null when unknown."""
    out = F.lit(None).cast("string")
    for number, label in {**MUNICIPALITIES, **OTHER_AREAS}.items():
        out = F.when(code == number, label).otherwise(out)
    return out


def responsibility_label(code: Column, name: Column) -> Column:
    return F.coalesce(area_label(code), name)


def is_municipality(code: Column) -> Column:
    return F.coalesce(code.isin(*MUNICIPALITIES), F.lit(False))


def classify_features(features: DataFrame) -> DataFrame:
    """Kind, locality flag and area label from the type and area codes."""
    baked = text.loose_true(F.col("is_locality")) if "is_locality" in features.columns else F.lit(False)
    given = text.clean_name(F.col("municipality_name")) if "municipality_name" in features.columns else F.lit(None).cast("string")
    return (
        features.withColumn("is_locality", baked | is_locality_type(F.col("type_code")))
        .withColumn("feature_kind", feature_kind(F.col("type_code")))
        .withColumn("municipality_name", F.coalesce(area_label(F.col("municipality_code")), given))
    )


def flag_shadows(places: DataFrame, key: str = "global_id") -> DataFrame:
    """Add ``is_locality_shadow``: a feature that only echoes the name of a locality close by.

    Near-equal spellings are found by equality joins on shared shortened forms,
    over distinct (name, municipality) and (name, position) values, so repeated
    names cost one row each and no group is paired in full. The sides are many
    forms long for each value, which Catalyst does not foresee: they are merged,
    never broadcast.
    """
    named = places.withColumn("_name", text.fold_spaces(F.col("official_name")))
    keys = F.explode(text.near_duplicate_keys(F.col("_name"))).alias("_form")
    locals_ = named.where("is_locality")
    others = named.where(~F.col("is_locality") & ~F.col("type_code").isin(*COASTAL_CODES))

    def near_names() -> Column:
        return text.near_duplicate(F.col("a._name"), F.col("b._name"))

    area = ["municipality_code", "_name"]
    left = others.where(F.col("municipality_code").isNotNull()).select(*area).distinct().select(*area, keys)
    right = locals_.where(F.col("municipality_code").isNotNull()).select(*area).distinct().select(*area, keys).hint("merge")
    same_area = (
        left.alias("a")
        .join(
            right.alias("b"),
            (F.col("a.municipality_code") == F.col("b.municipality_code")) & (F.col("a._form") == F.col("b._form")) & near_names(),
            "left_semi",
        )
        .select(*area)
        .distinct()
        .withColumn("_same_area", F.lit(True))
    )

    spot = ["_name", "longitude", "latitude"]
    cx, cy = geo.cell(F.col("longitude"), SHADOW_DEGREES), geo.cell(F.col("latitude"), SHADOW_DEGREES)
    around = F.explode(
        F.flatten(
            F.transform(
                F.sequence(cx - 1, cx + 1),
                lambda x: F.transform(F.sequence(cy - 1, cy + 1), lambda y: F.struct(x.alias("x"), y.alias("y"))),
            )
        )
    ).alias("_cell")
    left = others.select(*spot).distinct().select(*spot, cx.alias("_x"), cy.alias("_y"), keys)
    right = (
        locals_.select(*spot)
        .distinct()
        .select(*spot, around)
        .select(*spot, F.col("_cell.x").alias("_x"), F.col("_cell.y").alias("_y"), keys)
        .hint("merge")
    )
    close_by = (
        left.alias("a")
        .join(
            right.alias("b"),
            (F.col("a._x") == F.col("b._x"))
            & (F.col("a._y") == F.col("b._y"))
            & (F.col("a._form") == F.col("b._form"))
            & geo.near_degrees(
                F.col("a.longitude"), F.col("a.latitude"), F.col("b.longitude"), F.col("b.latitude"), SHADOW_DEGREES
            )
            & near_names(),
            "left_semi",
        )
        .select(*spot)
        .distinct()
        .withColumn("_close_by", F.lit(True))
    )
    exempt = F.col("is_locality") | F.col("type_code").isin(*COASTAL_CODES)
    return (
        named.join(same_area, area, "left")
        .join(close_by, spot, "left")
        .withColumn(
            "is_locality_shadow", ~exempt & (F.coalesce("_same_area", F.lit(False)) | F.coalesce("_close_by", F.lit(False)))
        )
        .select(*[c for c in places.columns if c != "is_locality_shadow"], "is_locality_shadow")
    )


def enrich_gazetteer(features: DataFrame, crosswalk: DataFrame | None = None, prefix: str = "register") -> DataFrame:
    """Typed, ranked and identified features with the shadow flag, ready to draw in ascending importance."""
    from accessgraph.operators.resolve import attach_identity

    cast = {
        "record_id": "bigint", "type_code": "int", "municipality_code": "int", "longitude": "double", "latitude": "double",
    }
    typed = features
    for name, kind in cast.items():
        typed = typed.withColumn(name, F.col(name).cast(kind))
    for name in ("danish_name", "old_official_name", "locality_code"):
        raw = F.col(name) if name in typed.columns else F.lit(None)
        typed = typed.withColumn(name, text.clean_name(raw.cast("string")))
    ranked = rank_types(classify_features(typed)).withColumn("zoom_band", zoom_band())
    return flag_shadows(attach_identity(ranked, crosswalk, prefix))


def draw_order(places: DataFrame) -> DataFrame:
    """Low importance first, so that important names end on top."""
    return places.orderBy("importance", "global_id")


def geography_group() -> Column:
    code = F.col("type_code")
    return (
        F.when(F.col("is_locality"), F.lit(None).cast("string"))
        .when(code.isin(*WATER_TYPES), "waters")
        .when(code.isin(*ISLAND_TYPES), "islands")
        .otherwise("landforms")
    )


def visible(
    places: DataFrame,
    lens: str | None = None,
    municipality: int | str | None = None,
    groups: tuple[str, ...] = ("waters", "islands", "landforms"),
) -> DataFrame:
    """Places that are not shadows; with a lens also filtered by area and content."""
    shown = places.where(~F.col("is_locality_shadow"))
    if lens is None:
        return shown
    if municipality == "outside":
        shown = shown.where(F.col("municipality_code").isin(*OTHER_AREAS))
    elif municipality is not None:
        shown = shown.where(F.col("municipality_code") == municipality)
    if lens == "inhabited":
        return shown.where("is_locality")
    return shown.where(
        (F.col("feature_kind") == "town") | (~F.col("is_locality") & geography_group().isin(*groups))
    )


def visible_at_zoom(places: DataFrame, zoom: float) -> DataFrame:
    """Coastal types appear from their own zoom, all others from that of their band."""
    coastal = F.col("type_code").isin(*COASTAL_CODES)
    start = F.when(coastal, F.col("min_zoom")).otherwise(band_min_zoom(F.col("zoom_band")))
    return places.where(start <= zoom)


def with_provenance(places: DataFrame, source_kind: str, register: str, layer_url: str) -> DataFrame:
    return (
        places.withColumn("source_kind", F.lit(source_kind))
        .withColumn("register_name", F.lit(register))
        .withColumn("layer_url", F.lit(layer_url))
        .withColumn("geometry_kind", F.lit("midpoint"))
    )


def coverage_audit(before: DataFrame, after: DataFrame, codes: tuple[int, ...] = COASTAL_CODES) -> DataFrame:
    """Per type: how many ids are expected, seen once, missing, repeated or unexpected."""
    key = ["type_code", "global_id"]
    want = before.where(F.col("type_code").isin(*codes)).select(*key).distinct().withColumn("_want", F.lit(1))
    have = after.where(F.col("type_code").isin(*codes)).groupBy(*key).agg(F.count(F.lit(1)).alias("_have"))
    both = want.join(have, key, "full")
    return both.groupBy("type_code").agg(
        F.count("_want").alias("expected"),
        F.count_if((F.col("_want") == 1) & (F.col("_have") == 1)).alias("seen_once"),
        F.count_if(F.col("_have").isNull()).alias("missing"),
        F.count_if(F.col("_have") > 1).alias("repeated"),
        F.count_if(F.col("_want").isNull()).alias("unexpected"),
    )


def scope_places(places: DataFrame, scope: str = "all") -> DataFrame:
    if scope == "localities":
        return places.where("is_locality")
    if scope == "geography":
        return places.where(~F.col("is_locality"))
    return places


def region_extract(places: DataFrame, bbox: tuple[float, float, float, float], geography_limit: int | None = None) -> DataFrame:
    """All localities of a box and its important geography, or the ``geography_limit`` most important of it."""
    inside = places.where(geo.in_bbox(F.col("longitude"), F.col("latitude"), bbox))
    geography = inside.where(~F.col("is_locality") & (F.col("importance") >= REGION_MIN_IMPORTANCE))
    if geography_limit is not None:
        geography = geography.orderBy(F.col("importance").desc(), "global_id").limit(geography_limit)
    return inside.where("is_locality").unionByName(geography)


def corridor_extract(places: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Localities inside a corridor, written once; an empty corridor raises."""
    inside = written(places.where("is_locality").where(geo.in_bbox(F.col("longitude"), F.col("latitude"), bbox)))
    if inside.isEmpty():
        raise ValueError("no localities inside the corridor")
    return inside
