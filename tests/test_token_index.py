"""The word index against a scan of all texts per query."""

from __future__ import annotations

import random
import re
import unicodedata

from frames import name, place, tables

from accessgraph.operators import token_index

WORD = re.compile(r"[^\W_]+")


def bare(v):
    return "".join(c for c in unicodedata.normalize("NFD", v.lower()) if not unicodedata.combining(c))


def meets(text, q):
    tokens = WORD.findall(bare(text))
    words = [w for w in (WORD.findall(bare(w)) for w in q.split()) if w]

    def phrase(w):
        return any(tokens[i : i + len(w) - 1] == w[:-1] and tokens[i + len(w) - 1].startswith(w[-1]) for i in range(len(tokens) - len(w) + 1))

    return bool(words) and all(map(phrase, words))


def cases():
    rng = random.Random(3)
    parts = ["Nuuk", "nu", "Ilulissat", "Ílu", "Sø", "søndre", "fjord", "Å", "a", "12", "1", "Kap-Farvel", "kap", "farvel", "St. Paul", "日本"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(120)] + ["", "--", "a a a"]
    asked = [" ".join(rng.choice(parts)[: rng.randrange(1, 9)] for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    asked += ["", "  ", "--", "kap-far", "Kap-Farvel Nu", "KAP farvel-", "a a", "St.Pa", "ilu", "NUUK -- 1"]
    return texts, asked


def test_words_equal_a_scan(spark):
    texts, asked = cases()
    index = token_index.token_index(spark.createDataFrame([(t,) for t in texts * 2], "text string"))
    queries = spark.createDataFrame(list(enumerate(asked + asked[:5])), "query_id int, q string")
    got = token_index.match_words(index, queries).collect()
    want = {(i, t) for i, q in enumerate(asked + asked[:5]) for t in set(texts) if meets(t, q)}
    assert len(got) == len(want) and {(r["query_id"], r["text"]) for r in got} == want and len(want) > 200
    assert token_index.match_words(index, queries.limit(0)).count() == 0


def test_search_falls_back_and_ranks(spark):
    t = tables(
        spark,
        places=[place(i) for i in range(4)],
        place_names=[name(0, "Nuuk"), name(1, "Nuuk Bay"), name(1, "Godthåb", "exonym", "da"), name(2, "Old Nuuk"), name(3, "Tasiilaq")],
    )
    queries = spark.createDataFrame([("a", "nuuk"), ("b", "siil"), ("c", "GODTHAB"), ("d", "none"), ("e", " ")], "query_id string, q string")
    hits = token_index.search_many(t, queries, limit=2).orderBy("query_id", "position").collect()
    assert [(r["query_id"], r["place_id"], r["position"]) for r in hits] == [
        ("a", "plc_0", 1), ("a", "plc_1", 2), ("b", "plc_3", 1), ("c", "plc_1", 1)]
    assert token_index.search_many(t, queries).where("query_id = 'a'").count() == 3
    assert token_index.prefix_search_many(t, queries, language="da").select("query_id").collect() == [("c",)]


def test_unaccent_search(spark):
    places = spark.createDataFrame(
        [(1, "Qaqortoq", "Julianehåb", None, "Kujalleq"), (2, "Nuuk", None, "Godthåb", "Sermersooq")],
        "record_id int, official_name string, danish_name string, old_official_name string, municipality_name string",
    )
    queries = spark.createDataFrame([(1, "hab"), (2, "nuuk  g"), (3, "k j"), (4, "ÅB k"), (5, "")], "query_id int, q string")
    got = token_index.unaccent_search_many(places, queries).select("query_id", "record_id")
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (2, 2)]
