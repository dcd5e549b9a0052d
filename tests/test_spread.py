"""Results far larger than both sides: equal to a plain join, dealt evenly, and not shuffled."""

from __future__ import annotations

from pyspark.sql import functions as F

from accessgraph.operators import token_index
from accessgraph.operators.spread import spread_join
from frames import name, place, tables


def shuffled_rows(df):
    """Rows that the exchanges of a finished plan moved, at most by one exchange."""
    nodes, most = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName().endswith("QueryStage"):
            node = node.plan()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        if node.nodeName() == "Exchange":
            most = max(most, node.metrics().apply("shuffleRecordsWritten").value())
        nodes.extend(node.children().apply(i) for i in range(node.children().size()))
    return most


def test_one_key_goes_to_many_tasks(spark):
    many, few = spark.range(3000).selectExpr("id", "id % 2 k"), spark.range(40).selectExpr("id other", "id % 2 k")
    joined = spread_join(many, few, ["k"])
    assert joined.select("id", "other", "k").exceptAll(many.join(few, "k").select("id", "other", "k")).isEmpty()
    sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(s["count"] for s in sizes) < 3000 * 40 / 2 / 3


def test_hits_of_many_equal_queries_are_not_shuffled(spark):
    t = tables(spark, places=[place(i) for i in range(200)], place_names=[name(i, "Nuuk Bay") for i in range(200)])
    queries = spark.range(300).selectExpr("id query_id", "' nuuk ' q")
    for search in (token_index.prefix_search_many, token_index.substring_search_many):
        hits = search(t, queries)
        assert len(hits.collect()) == 200 * 300 and shuffled_rows(hits) <= 300 * 64
    first = token_index.prefix_search_many(t, queries, limit=2)
    assert {(r.place_id, r.position) for r in first.collect()} == {("plc_0", 1), ("plc_1", 2)} and first.count() == 600
    land = spark.range(200).selectExpr("id record_id", "'Nuuk' official_name", "'' danish_name", "'' old_official_name", "'' municipality_name")
    found = token_index.unaccent_search_many(land, queries)
    assert len(found.collect()) == 200 * 300 and shuffled_rows(found) <= 300 * 64
