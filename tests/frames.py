"""Small canonical tables for tests."""

from __future__ import annotations

from datetime import date

from accessgraph.schemas import TABLES

REF = [{"source_id": "src_a", "record_id": "r"}]


def day(text):
    return None if text is None else date.fromisoformat(text)


def tables(spark, **rows):
    made = {}
    for name, schema in TABLES.items():
        filled = []
        for row in rows.get(name, []):
            full = {f.name: None for f in schema.fields}
            if "source_refs" in full:
                full["source_refs"] = REF
            full.update(row)
            for key, value in full.items():
                if isinstance(value, str) and len(value) == 10 and value[4] == "-" and value[7] == "-":
                    full[key] = day(value)
            filled.append(full)
        made[name] = spark.createDataFrame(filled, schema)
    return made


def place(i, status="active", **more):
    return {"id": f"plc_{i}", "status": status, "created_at": "2000-01-01", **more}


def name(i, value, kind="official", language="kl", **more):
    return {"id": f"nam_{i}_{kind}_{language}_{value}", "place_id": f"plc_{i}", "value": value, "kind": kind,
            "language": language, "observed_at": "2001-01-01", **more}


def connection(i, a, b, direction="bidirectional", mode="helicopter", **more):
    return {"id": f"con_{i}", "origin_place_id": f"plc_{a}", "destination_place_id": f"plc_{b}", "direction": direction,
            "mode": mode, "created_at": "2000-01-01", **more}


def service(i, c, kind="year_round", months=(), capabilities=("passenger",), **more):
    return {"id": f"svc_{i}", "connection_id": f"con_{c}", "operator": "air", "capabilities": list(capabilities),
            "seasonality": {"kind": kind, "months": list(months)}, "frequency_band": "daily", "frequency_basis": "typical",
            "status": "active", "observed_at": "2001-02-01", **more}
