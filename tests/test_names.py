import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from accessgraph.functions import text
from accessgraph.operators import gazetteer, resolve, search

FEATURE = "record_id long, global_id string, official_name string, danish_name string, old_official_name string, type_code int, municipality_code int, longitude double, latitude double"


def features(spark, rows):
    full = []
    for i, row in enumerate(rows):
        base = {"record_id": i, "global_id": f"G{i}", "official_name": "x", "danish_name": None, "old_official_name": None,
                "type_code": 49, "municipality_code": 956, "longitude": -50.0 - i, "latitude": 64.0}
        base.update(row)
        full.append(tuple(base.values()))
    return spark.createDataFrame(full, FEATURE)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near(a, b):
    longest, shortest = max(len(a), len(b)), min(len(a), len(b))
    if not shortest:
        return False
    return (a == b or (longest <= 7 and edits(a, b) <= 2) or (longest <= 12 and edits(a, b) <= 1)
            or (longest - shortest <= 2 and shortest >= 4 and (a.startswith(b) or b.startswith(a))))


def test_blocking_keys_lose_no_near_duplicate(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abn") for _ in range(rng.randrange(1, 15))) for _ in range(150)]
    words += [w + "a" for w in words[:60]] + [w[:3] + w[4:] for w in words[:60]]
    df = spark.createDataFrame([(w,) for w in sorted(set(words))], "w string")
    keys = df.select("w", F.explode(text.near_duplicate_keys(F.col("w"))).alias("k"))
    other = keys.withColumnRenamed("w", "v")
    got = {
        (r["w"], r["v"])
        for r in keys.join(other, "k").where(text.near_duplicate(F.col("w"), F.col("v"))).select("w", "v").distinct().collect()
    }
    assert got == {(a, b) for a in set(words) for b in set(words) if near(a, b)}


def test_shadow_scenarios(spark):
    places = gazetteer.enrich_gazetteer(
        features(
            spark,
            [
                {"official_name": "Naajaat", "type_code": 23, "longitude": -55.0, "latitude": 73.0},
                {"official_name": "Naajat", "type_code": 49, "municipality_code": 960, "longitude": -55.01, "latitude": 73.01},
                {"official_name": "Naajat", "type_code": 181, "longitude": -55.01, "latitude": 73.01},
                {"official_name": "Naajat", "type_code": 49, "municipality_code": 957, "longitude": -45.0, "latitude": 61.0},
                {"official_name": "Nuuk", "type_code": 21, "longitude": -51.7, "latitude": 64.2},
                {"official_name": "Nuuk", "type_code": 49, "longitude": -40.0, "latitude": 70.0},
            ],
        )
    )
    flags = {r["record_id"]: r["is_locality_shadow"] for r in places.collect()}
    assert flags == {0: False, 1: True, 2: False, 3: False, 4: False, 5: True}


def test_ranked_search_scenarios(spark):
    places = gazetteer.enrich_gazetteer(
        features(
            spark,
            [
                {"official_name": "Nuuk", "danish_name": "Godthåb", "type_code": 21},
                {"official_name": "Nuuk", "type_code": 57, "municipality_code": None},
                {"official_name": "Nuussuaq", "type_code": 23},
                {"official_name": "Qaarsut", "old_official_name": "Karsuarsuk", "type_code": 23},
            ],
        )
    )
    asked = spark.createDataFrame([(1, "nuuk"), (2, "Godthåb"), (3, "Nuke"), (4, "karsu"), (5, "n")], "query_id int, q string")
    hits = search.rank_search(places, asked, 12).orderBy("query_id", "position").collect()
    by_query = {}
    for h in hits:
        by_query.setdefault(h["query_id"], []).append((h["global_id"], h["match"], h["matched_field"]))
    assert by_query[1][:2] == [("G0", "exact", "official"), ("G1", "exact", "official")]
    assert by_query[2] == [("G0", "exact", "danish")]
    assert by_query[3] == [("G0", "fuzzy", "official")]
    assert by_query[4] == [("G3", "prefix", "historical")]
    assert 5 not in by_query


def test_substring_pairs_match_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randrange(0, 9))) for _ in range(200)] + ["aaaa"] * 100
    asked = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    got = search.substring_pairs(
        spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(q,) for q in asked], "q string")
    )
    assert {tuple(r) for r in got.collect()} == {(t, q) for t in texts for q in asked if q in t}


def test_name_key_folds_fully(spark):
    df = spark.createDataFrame([("  STRASSE  x ",), ("straße x",), ("é",), ("é",)], "n string")
    assert [r[0] for r in df.select(text.name_key(F.col("n"))).collect()] == ["strasse x", "strasse x", "é", "é"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text("abå /~*-é", max_size=8)), min_size=1, max_size=5))
def test_slug_matches_percent_encoding(spark, rows):
    from urllib.parse import quote

    df = spark.createDataFrame(rows, "n string")
    got = [r[0] for r in df.select(text.slug_base(F.col("n"))).collect()]
    assert got == [quote(n.lower().replace(" ", "-").replace("/", "-"), safe="-") for (n,) in rows]


@pytest.mark.parametrize("query, kind", [("plc_1", "id"), ("naa", "prefix"), ("aja", "text"), ("", "list")])
def test_search_chain(spark, query, kind):
    from frames import name, place, tables

    t = tables(spark, places=[place(1), place(2)], place_names=[name(1, "Naajaat"), name(2, "Ílulissat")])
    got = [r["place_id"] for r in search.search_places(t, query).collect()]
    assert got == (["plc_1", "plc_2"] if kind == "list" else ["plc_1"])
    assert [r["place_id"] for r in search.prefix_search(t, "ilu").collect()] == ["plc_2"]


def test_hints_are_rows_of_their_own_and_reasons_of_named_candidates(spark):
    from frames import name, place, tables

    member = lambda i, area: {"id": f"mem_{i}", "place_id": f"plc_{i}", "administrative_area_id": f"adm_{area}", "observed_at": "2000-01-01"}
    t = tables(
        spark,
        places=[place(i) for i in (1, 2, 3)],
        place_names=[name(1, "Naajaat"), name(2, "Naajaat"), name(3, "Nuuk")],
        administrative_areas=[{"id": f"adm_{a}", "name": a, "level": "municipality"} for a in ("a", "b", "empty")],
        administrative_memberships=[member(1, "a"), member(2, "b"), member(3, "a")],
    )
    requests = spark.createDataFrame(
        [(1, "naajaat", 10), (2, None, 10), (3, "nuuk", None), (4, "none", 12)],
        "request_id int, name string, municipality_code int",
    ).withColumn("identifiers", F.lit(None).cast("array<struct<namespace:string,value:string>>"))
    codes = spark.createDataFrame([(10, "adm_a"), (11, "adm_b"), (12, "adm_empty")], "municipality_code int, municipality_id string")
    got = resolve.resolve_candidates(t, requests, "2001-01-01", codes).collect()
    assert sorted((r["request_id"], r["place_id"] or "", r["municipality_id"] or "", r["confidence"], tuple(r["reasons"])) for r in got) == [
        (1, "", "adm_a", 0.5, ("municipality_hint",)),
        (1, "plc_1", "", 0.95, ("official_name_exact", "municipality_hint")),
        (1, "plc_2", "", 0.95, ("official_name_exact",)),
        (2, "", "adm_a", 0.5, ("municipality_hint",)),
        (3, "plc_3", "", 0.95, ("official_name_exact",)),
    ]
    verdicts = {r["request_id"]: r["result"] for r in resolve.resolve_places(t, requests, "2001-01-01", codes).collect()}
    assert verdicts == {1: "ambiguous", 2: "ambiguous", 3: "candidate", 4: "not_found"}
