from collections import ChainMap
from datetime import date, timedelta

from frames import connection, name, place, service, tables
from pyspark.sql import functions as F

from accessgraph.operators import denorm, network, temporal


def hub(spark):
    return tables(
        spark,
        places=[place(i) for i in range(4)] + [place(9, "retired", retired_at="2001-01-01")],
        place_names=[name(i, f"Name {i}") for i in range(4)],
        connections=[connection(1, 0, 1), connection(2, 0, 2), connection(3, 2, 3, "one_way", "sea")],
        connection_services=[
            service("a", 1, valid_from="2020-05-01"),
            service("b", 2),
            service("c", 2, kind="seasonal", months=[6, 7, 8]),
            service("d", 3, kind="seasonal", months=[7]),
        ],
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_edge_kept_without_services_before_start(spark):
    got = denorm.place_connections(hub(spark), "plc_0", "2020-04-15")
    found = rows(got.withColumn("s", F.coalesce("service.id", F.lit("-"))), "connection_id", "role", "peer_place_id", "s")
    assert found == [("con_1", "origin", "plc_1", "-"), ("con_2", "origin", "plc_2", "svc_b")]


def test_two_services_of_one_connection_are_kept(spark):
    got = denorm.denorm_reachability(hub(spark)).where("id = 'con_2'").first()
    assert got["service_count"] == 2
    services = denorm.connection_services(hub(spark)).where("connection_id = 'con_2'").select("service.id")
    assert rows(services, "id") == [("svc_b",), ("svc_c",)]
    assert str(got["updated_at"]) == "2001-02-01"


def test_path_over_hub_and_transfer_limit(spark):
    t = hub(spark)
    got = network.hop_path(t, "plc_1", "plc_2", "2020-07-15").first()
    assert (got["reachable"], got["hops"], got["path"], got["connections"]) == (
        True, 2, ["plc_1", "plc_0", "plc_2"], ["con_1", "con_2"],
    )
    blocked = network.hop_path(t, "plc_1", "plc_2", "2020-07-15", max_transfers=0).first()
    assert not blocked["reachable"] and blocked["hops"] is None and blocked["path"] == []


def test_direction_and_same_place(spark):
    t = hub(spark)
    assert not network.hop_path(t, "plc_3", "plc_0", "2020-07-15").first()["reachable"]
    same = network.hop_path(t, "plc_3", "plc_3", "2020-07-15").first()
    assert same["hops"] == 0 and same["path"] == ["plc_3"] and same["connections"] == []


def test_isolation_follows_the_rule(spark):
    t = hub(spark)
    january = rows(network.isolation(t, "2020-01-15").where("connected"), "place_id")
    assert january == [("plc_0",), ("plc_2",)]
    # The build rule has no season test, so the summer-only edge counts.
    built = rows(network.isolation(t, "2020-01-15", rule="build").where("connected"), "place_id")
    assert built == [("plc_0",), ("plc_2",), ("plc_3",)]


def test_single_dependency_and_seasonal_loss(spark):
    t = hub(spark)
    single = rows(network.single_dependency(t, "2020-07-15"), "place_id", "kind", "value")
    assert ("plc_1", "connection", "con_1") in single
    assert not [r for r in single if r[0] == "plc_0" and r[1] == "connection"]
    assert not [r for r in single if r[0] == "plc_2" and r[1] == "mode"]
    loss = network.seasonal_loss(t, 2020).collect()
    by_place = {r["place_id"]: r["isolated_months"] for r in loss}
    assert by_place == {"plc_3": [1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12], "plc_1": [1, 2, 3, 4]}


def test_parallel_edges_take_the_smallest_connection(spark):
    t = tables(
        spark,
        places=[place(i) for i in range(4)],
        connections=[connection(9, 0, 1), connection(1, 0, 2), connection(5, 1, 3), connection(7, 2, 3), connection(4, 2, 3)],
        connection_services=[service(i, i) for i in (9, 1, 5, 7, 4)],
    )
    assert network.hop_path(t, "plc_0", "plc_3", "2020-01-01").first()["connections"] == ["con_1", "con_4"]


def test_homonyms_and_closed_names(spark):
    t = tables(
        spark,
        places=[place(1), place(2), place(3)],
        place_names=[name(1, "Nuuk"), name(2, "Nuuk"), name(3, "A/b ~*"), name(1, "Godthåb", "exonym", "da"),
                     name(1, "Old", "historical", valid_to="1990-01-01")],
    )
    got = {r["id"]: r for r in denorm.denorm_places(t).collect()}
    assert [got[f"plc_{i}"]["slug"] for i in (1, 2, 3)] == ["nuuk", "nuuk-2", "a-b-~%2A"]
    assert [tuple(r) for r in denorm.place_alternates(t).select("place_id", "value").collect()] == [("plc_1", "Godthåb")]
    assert got["plc_1"]["danish_name"] == "Godthåb" and got["plc_2"]["danish_name"] == ""
    assert got["plc_1"]["coordinates"] is None


def test_edge_filters(spark):
    edges = denorm.edges_with_services(hub(spark), "2020-04-15")
    assert temporal.filter_edges(edges, modes=["HELICOPTER"]).count() == 2
    assert temporal.filter_edges(edges, operator="AIR").count() == 1
    assert temporal.filter_edges(edges, capabilities=["freight"]).count() == 0


def test_access_change(spark):
    t = hub(spark)
    after = ChainMap({"connections": t["connections"].where("id <> 'con_2'")}, t)
    got = rows(network.access_change(t, after, "2020-02-15"), "place_id", "change")
    assert got == [("plc_0", "lost"), ("plc_2", "lost")]


def test_crowded_keys_keep_their_key_level_fields(spark):
    """Thousands of services and names of one key: latest date, first service and first Danish name count all of them."""
    many = [service(f"{i:05d}", 1) | {"observed_at": date(2000, 1, 1) + timedelta(days=(i * 7919) % 5000)} for i in range(3000)]
    t = tables(
        spark,
        places=[place(1), place(2)],
        connections=[connection(1, 1, 2)],
        connection_services=many,
        place_names=[name(1, "Nuuk"), name(2, "Sisimiut")] + [name(1, f"N{i:04d}", "exonym", "da") for i in range(2000)],
    )
    record = denorm.denorm_reachability(t).first()
    assert (record["service_count"], record["updated_at"]) == (3000, max(s["observed_at"] for s in many))
    assert denorm.connection_services(t).count() == 3000
    assert denorm.place_alternates(t).count() == 2000
    danish = {n["id"]: n["value"] for n in t["place_names"].where("language = 'da'").collect()}
    assert denorm.denorm_places(t).where("id = 'plc_1'").first()["danish_name"] == danish[min(danish)]


def test_hops_from_many_equals_breadth_first_search(spark, monkeypatch):
    import random

    monkeypatch.setattr(network, "LAYERS", 2)
    rng = random.Random(6)
    n = 150
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(120)]
    kinds = [rng.choice(["bidirectional", "one_way"]) for _ in pairs]
    t = tables(
        spark,
        places=[place(i) for i in range(n)],
        connections=[connection(i, a, b, d) for i, ((a, b), d) in enumerate(zip(pairs, kinds, strict=True))],
        connection_services=[service(i, i) for i in range(len(pairs))],
    )
    around = {}
    for (a, b), d in zip(pairs, kinds, strict=True):
        around.setdefault(a, set()).add(b)
        if d == "bidirectional":
            around.setdefault(b, set()).add(a)
    want = set()
    for start in range(0, 140):
        hops, frontier = {start: 0}, [start]
        while frontier:
            frontier = [y for x in frontier for y in around.get(x, ()) if y not in hops and not hops.update({y: hops[x] + 1})]
        want |= {(f"plc_{start}", f"plc_{p}", h) for p, h in hops.items()}
    sources = spark.createDataFrame([(f"plc_{i}",) for i in range(140)] * 2, "place_id string")
    got = network.hops_from_many(t, sources, "2020-07-15").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    near = network.hops_from_many(t, sources, "2020-07-15", max_hops=2).collect()
    assert {tuple(r) for r in near} == {w for w in want if w[2] <= 2}
    assert network.hops_from_many(t, sources.limit(0), "2020-07-15").count() == 0
