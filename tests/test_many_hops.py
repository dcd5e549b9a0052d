"""Hops from many sources: pairs are never shuffled, and rounds drop what they shuffled."""

from __future__ import annotations

from pyspark.sql import functions as F

from accessgraph.operators import network
from accessgraph.session import TIDY_KEY, written
from frames import connection, place, service, tables
from test_spread import shuffled_rows


def star(spark, n):
    """Every place is linked with place 0, both ways."""
    return tables(
        spark,
        places=[place(i) for i in range(n)],
        connections=[connection(i, 0, i, "bidirectional") for i in range(1, n)],
        connection_services=[service(i, i) for i in range(1, n)],
    )


def test_pairs_are_not_shuffled(spark):
    n = 700
    t = star(spark, n)
    sources = t["places"].select(F.col("id").alias("place_id"))
    found = network.hops_from_many(t, sources, "2020-07-15")
    rows = {(r.source, r.place_id): r.hops for r in found.collect()}
    hops = lambda a, b: 0 if a == b else 1 if 0 in (a, b) else 2
    assert rows == {(f"plc_{a}", f"plc_{b}"): hops(a, b) for a in range(n) for b in range(n)}
    assert shuffled_rows(found) < n * 10


def test_a_tidy_write_keeps_rows_and_settings(spark):
    before = spark.conf.get(TIDY_KEY, "false")
    rows = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), tidy=True)
    assert rows.agg(F.sum("count")).first()[0] == 1000
    assert spark.conf.get(TIDY_KEY, "false") == before
