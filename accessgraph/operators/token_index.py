"""Search for a whole table of queries in one pass, over an index of words.

An index has a row per word of every distinct text. A query is a set of
requirements that a text meets all of, found by relational division: matches
are equality joins, and a text is a hit when it met as many requirements as the
query has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accessgraph.functions import text
from accessgraph.operators.denorm import current_places
from accessgraph.operators.search import NOT_WORD, searchable_names, substring_pairs
from accessgraph.operators.spread import spread_join
from accessgraph.operators.temporal import Tables, current

# Letters of a word by which prefixes are looked up; longer ones are tested on what is left.
PIECE = 3


def _words(value: Column) -> Column:
    return F.filter(F.split(text.bare(value), NOT_WORD), lambda w: w != "")


def token_index(texts: DataFrame) -> DataFrame:
    """(text, pos, token): the words of every distinct ``text``, without case and accents."""
    return texts.select("text").distinct().select("text", F.posexplode(_words(F.col("text"))).alias("pos", "token"))


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, word, at, token, n_tokens, n_words) of queries (query_id, q).

    White space separates the words of a query; a word that other characters cut
    in pieces is a phrase of ``n_tokens``. Words without letter or digit do not count.
    """
    words = F.filter(F.split("q", r"\s+"), lambda w: F.regexp_replace(w, NOT_WORD, "") != "")
    asked = queries.select("query_id", words.alias("_words")).withColumn("n_words", F.size("_words"))
    phrases = asked.select("query_id", "n_words", F.posexplode("_words").alias("word", "_w"))
    tokens = phrases.withColumn("_t", _words(F.col("_w"))).withColumn("n_tokens", F.size("_t"))
    return tokens.select("query_id", "word", F.posexplode("_t").alias("at", "token"), "n_tokens", "n_words")


def word_pairs(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Distinct (text, q) where every word of the trimmed query ``q`` begins a word of the text.

    The last token of a phrase may be a beginning, those before must be whole
    words in a row. Equal queries are looked up once.
    """
    asked = queries.select(F.trim("q").alias("q")).distinct().select("q", F.col("q").alias("query_id"))
    wanted = query_tokens(asked).withColumn("whole", F.col("at") < F.col("n_tokens") - 1)
    size = F.when(F.col("whole"), F.lit(0)).otherwise(F.least(F.length("token"), F.lit(PIECE)))
    piece = lambda n: F.when(n == 0, F.col("token")).otherwise(F.substring(F.col("token"), F.lit(1), n))
    wanted = wanted.withColumn("size", size).withColumn("piece", piece(F.col("size"))).withColumnRenamed("token", "_token")
    # Pieces of a size that no query needs are not made.
    sizes = wanted.agg(F.collect_set("size")).scalar()
    pieces = index.withColumn("size", F.explode(sizes)).where(F.col("size") <= F.length("token"))
    found = pieces.withColumn("piece", piece(F.col("size"))).join(wanted, ["size", "piece"])
    found = found.where(F.col("whole") | F.startswith("token", F.col("_token")))
    met = found.select("query_id", "word", "n_words", "n_tokens", "text", (F.col("pos") - F.col("at")).alias("start"), "at").distinct()
    phrases = met.groupBy("query_id", "word", "n_words", "n_tokens", "text", "start").agg(F.count(F.lit(1)).alias("_n"))
    words = phrases.where(F.col("_n") == F.col("n_tokens")).select("query_id", "word", "n_words", "text").distinct()
    hits = words.groupBy("query_id", "n_words", "text").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == F.col("n_words"))
    return hits.select("text", F.col("query_id").alias("q"))


def match_words(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Distinct (query_id, text) where every word of the query begins a word of the text."""
    asked = queries.select("query_id", F.trim("q").alias("q"))
    return spread_join(word_pairs(index, queries), asked, ["q"]).select("query_id", "text")


def _hits(t: Tables, queries: DataFrame, names: DataFrame, pairs: DataFrame, text_column: Column, limit: int | None) -> DataFrame:
    """The places of matched names, with their position among a query's hits where there is a limit.

    ``pairs`` has (text, q). Hits are made distinct and ranked per query text;
    queries (query_id, q), one row per id, join at the end, after which nothing is shuffled.
    """
    found = names.withColumn("text", text_column).select(
        "text",
        "place_id",
        F.col("value").alias("matched_name"),
        F.col("language").alias("matched_language"),
        F.col("kind").alias("matched_kind"),
    )
    places = current_places(t).select(
        F.col("id").alias("place_id"), "canonical_name_kl", "feature_type", "municipality", "municipality_id"
    )
    hits = places.join(found.distinct().hint("merge"), "place_id").distinct().join(pairs.hint("merge"), "text").drop("text")
    if limit is not None:
        exact = F.lower("matched_name") == F.lower("q")
        ties = ["place_id", "matched_name", "matched_language", "matched_kind", "municipality", "feature_type"]
        order = [F.when(exact, 0).otherwise(1), "canonical_name_kl", *ties]
        ranked = hits.withColumn("position", F.row_number().over(Window.partitionBy("q").orderBy(*order)))
        hits = ranked.where(F.col("position") <= limit)
    return spread_join(hits, queries.select("query_id", "q"), ["q"]).drop("q")


def _of_language(names: DataFrame, language: str | None) -> DataFrame:
    return names if language is None else names.where(F.col("language") == language)


def prefix_search_many(t: Tables, queries: DataFrame, language: str | None = None, limit: int | None = None) -> DataFrame:
    """Hits of every query (query_id, q): current names and ids with a word that begins with each of its words.

    The first ``limit`` hits have a ``position``: equal names first, then by
    canonical name, place and name. Blank queries have no hits.
    """
    names = _of_language(searchable_names(t), language)
    pairs = word_pairs(token_index(names.select(F.col("value").alias("text"))), queries)
    return _hits(t, queries.withColumn("q", F.trim("q")), names, pairs, F.col("value"), limit)


def substring_search_many(t: Tables, queries: DataFrame, language: str | None = None, limit: int | None = None) -> DataFrame:
    """Hits of every query (query_id, q): current names that contain it; case is ignored."""
    names = _of_language(current(t["place_names"]), language)
    lowered = queries.select("query_id", F.lower(F.trim("q")).alias("q"))
    pairs = substring_pairs(names.select(F.lower("value").alias("text")), lowered)
    return _hits(t, lowered, names, pairs, F.lower("value"), limit)


def search_many(t: Tables, queries: DataFrame, language: str | None = None, limit: int | None = None) -> DataFrame:
    """Prefix search for every query, and substring search for those it finds nothing for."""
    by_words = prefix_search_many(t, queries, language, limit)
    rest = queries.join(by_words.select("query_id").distinct(), "query_id", "left_anti")
    return by_words.unionByName(substring_search_many(t, rest, language, limit))


def unaccent_search_many(places: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id and the place's columns): names or municipality contain the query, accents and case ignored."""
    hay = F.concat_ws(
        " ", "official_name", *[F.coalesce(c, F.lit("")) for c in ("danish_name", "old_official_name", "municipality_name")]
    )
    folded = places.withColumn("_text", text.bare(hay))
    asked = queries.select("query_id", text.bare(F.trim("q")).alias("q"))
    pairs = substring_pairs(folded.select(F.col("_text").alias("text")), asked).select(F.col("text").alias("_text"), F.col("q").alias("_q"))
    hits = folded.join(pairs.hint("merge"), "_text").drop("_text")
    return spread_join(hits, asked.withColumnRenamed("q", "_q"), ["_q"]).drop("_q")
