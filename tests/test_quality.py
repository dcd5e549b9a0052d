import pytest
from frames import connection, name, place, service, tables

from accessgraph.operators import quality

U = "{}_00000000-0000-4000-8000-{:012d}"


def uid(prefix, n):
    return U.format(prefix, n)


def good(spark, **change):
    rows = {
        "sources": [{"id": "src_a", "title": "A", "verification_status": "verified", "url": "u", "retrieved_at": "2000-01-01", "licence": "open"}],
        "places": [{**place(1), "id": uid("plc", i)} for i in (1, 2)],
        "place_classifications": [
            {"id": uid("cls", i), "place_id": uid("plc", i), "feature_type": "town", "observed_at": "2000-01-01"} for i in (1, 2)
        ],
        "place_names": [{**name(1, "Same"), "id": uid("nam", i), "place_id": uid("plc", i)} for i in (1, 2)]
        + [{**name(1, "Old", "historical", valid_to="1990-01-01"), "id": uid("nam", 9), "place_id": uid("plc", 1)}],
        "connections": [
            {**connection(1, 1, 2), "id": uid("con", 1), "origin_place_id": uid("plc", 1), "destination_place_id": uid("plc", 2)}
        ],
        "connection_services": [{**service(1, 1), "id": uid("svc", 1), "connection_id": uid("con", 1)}],
    }
    rows.update({k: v(rows[k]) if callable(v) else v for k, v in change.items()})
    return tables(spark, **rows)


def edit(**more):
    return lambda rows: [{**rows[0], **more}, *rows[1:]]


OTHER = {"id": uid("con", 2), "mode": "helicopter", "direction": "bidirectional", "created_at": "2000-01-01",
         "origin_place_id": uid("plc", 2), "destination_place_id": uid("plc", 1)}


def shape(table):
    return lambda t: quality.schema_violations(table, t[table])


# (change, rule function, expected rules)
CASES = [
    ({"place_names": edit(place_id=uid("plc", 77))}, quality.foreign_keys, ["foreign_key"]),
    ({"place_names": edit(source_refs=[{"source_id": "src_z", "record_id": None}])}, quality.unknown_sources, ["unknown_source"]),
    ({"place_names": edit(valid_from="2001-01-02", valid_to="2001-01-01")}, quality.validity_order, ["validity_order"]),
    ({"place_names": edit(valid_to="2001-01-01")}, quality.one_official_name, ["one_official_name"]),
    ({"place_names": lambda r: [*r, {**r[0], "id": uid("nam", 5)}]}, quality.one_official_name, ["one_official_name"]),
    ({"place_classifications": edit(valid_to="2001-01-01")}, quality.one_classification, ["one_classification"]),
    ({"connections": edit(destination_place_id=uid("plc", 1))}, quality.self_connections, ["self_connection"]),
    ({"connections": lambda r: [*r, OTHER]}, quality.duplicate_edges, ["duplicate_edge"]),
    ({"connections": lambda r: [*r, {**OTHER, "direction": "one_way"}]}, quality.duplicate_edges, []),
    ({"connections": edit(retired_at="2000-01-01")}, quality.retired_services, ["retired_connection"]),
    ({"places": edit(status="retired")}, quality.place_row_rules, ["lifecycle"]),
    ({"places": edit(status="retired", retired_at="2001-01-01")}, quality.retired_assertions, ["retired_place"] * 2),
    ({"places": lambda r: [*r, r[0]]}, quality.duplicate_ids, ["duplicate_id"]),
    ({"connection_services": edit(seasonality={"kind": "year_round", "months": [1]})}, quality.seasonality, ["seasonality"]),
    ({"connection_services": edit(seasonality={"kind": "seasonal", "months": []})}, quality.seasonality, ["seasonality"]),
    ({"connection_services": edit(seasonality={"kind": "seasonal", "months": [13, 13]})}, shape("connection_services"), ["range", "unique_items"]),
    ({"places": edit(id="plc_x")}, shape("places"), ["pattern"]),
    ({"connections": edit(mode="balloon")}, shape("connections"), ["enum"]),
    ({"connections": edit(mode=None)}, shape("connections"), ["required"]),
    ({"place_names": edit(source_refs=[])}, shape("place_names"), ["min_items"]),
    ({"sources": edit(url=None)}, quality.source_row_rules, ["verified_source_url"]),
]


def test_good_tables_pass_with_homonyms_and_closed_history(spark):
    assert quality.violations(good(spark), publish=True).collect() == []


@pytest.mark.parametrize("n", range(len(CASES)))
def test_rule(spark, n):
    change, rule, wanted = CASES[n]
    assert sorted(r["rule"] for r in rule(good(spark, **change)).collect()) == wanted


# Two broken or closed references of every kind at once, one of them in a closed row.
BROKEN = {
    "sources": lambda r: [*r, {**r[0], "id": "src_p", "verification_status": "pending"}],
    "places": lambda r: [*r, {**r[0], "id": uid("plc", 3), "status": "retired", "retired_at": "2001-01-01"}, {**r[0], "id": uid("plc", 3)}],
    "place_names": lambda r: [
        *r,
        {**r[0], "id": uid("nam", 20), "place_id": uid("plc", 3), "source_refs": [{"source_id": "src_p"}, {"source_id": "src_z"}, {"source_id": None}]},
        {**r[0], "id": uid("nam", 21), "place_id": uid("plc", 3), "valid_to": "2001-01-01", "source_refs": [{"source_id": "src_p"}]},
        {**r[0], "id": uid("nam", 22), "place_id": "", "source_refs": None},
        {**r[0], "id": uid("nam", 23), "place_id": None, "source_refs": []},
    ],
    "place_classifications": edit(place_id=uid("plc", 88)),
    "administrative_memberships": [
        {"id": uid("mem", 1), "place_id": uid("plc", 3), "administrative_area_id": uid("adm", 9), "observed_at": "2000-01-01"}
    ],
    "connections": lambda r: [{**r[0], "retired_at": "2000-01-01", "source_refs": [{"source_id": "src_p"}]}],
    "connection_services": lambda r: [*r, {**r[0], "id": uid("svc", 2), "connection_id": uid("con", 5)}],
    "external_identifiers": [
        {"id": uid("xid", n), "entity_type": kind, "entity_id": key, "namespace": "n", "value": str(n)}
        for n, (kind, key) in enumerate(
            [("place", uid("plc", 1)), ("place", uid("con", 1)), ("connection", uid("con", 1)), ("area", "x"), ("boat", "y"), (None, "z"), ("area", None)]
        )
    ],
}


@pytest.mark.parametrize("publish", [False, True])
def test_references_in_one_join_equal_the_single_rules(spark, publish):
    t = good(spark, **BROKEN)
    single = [quality.foreign_keys, quality.polymorphic_keys, quality.unknown_sources, quality.retired_assertions, quality.retired_services]
    single += [quality.pending_references] if publish else []
    wanted = sorted(tuple(r) for rule in single for r in rule(t).collect())
    assert {rule for _, rule, _, _ in wanted} >= {"foreign_key", "polymorphic_key", "unknown_source", "retired_place", "retired_connection"}
    assert sorted(tuple(r) for r in quality.reference_violations(t, publish).collect()) == wanted


def test_publish_gate(spark):
    t = good(spark, sources=edit(verification_status="pending"))
    found = quality.source_row_rules(t).unionByName(quality.pending_references(t))
    assert {r["rule"] for r in found.select("rule").collect()} == {"pending_source", "pending_reference"}
    state = quality.publish_state(quality.publication_blockers(found, t["sources"])).first()
    assert not state["publish_ready"] and not state["clean"]
    bare = good(spark, sources=edit(licence=None))
    state = quality.publish_state(quality.publication_blockers(quality.source_row_rules(bare), bare["sources"])).first()
    assert state["publish_ready"] and not state["clean"] and state["findings"] == 1


def test_raw_lines(spark):
    lines = spark.createDataFrame(
        [('{"id":"a","status":"active","created_at":"2026-02-31"}',), ('{"id":"b","extra":1}',), ('{"id": 5}',), ("{oops",), (" ",)],
        "value string",
    )
    got = sorted((r["rule"], r["key"]) for r in quality.raw_violations("places", lines).collect())
    assert got == [("date", "a"), ("json", "{oops"), ("type", "5"), ("unknown_field", "b")]
