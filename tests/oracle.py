"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from accessgraph.plans.views import BASE  # noqa: E402


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value + 0.0, 9)
    if value is None or isinstance(value, (int, str, bool)):
        return value
    return str(value)


def exact(value):
    return repr(value + 0.0) if isinstance(value, float) else repr(value)


def frame_rows(columns, rows, form=plain):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(form(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda t: tuple(("" if v is None else str(v)) for v in t))


def connect(sf: str):
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf):
    started = time.time()
    got = fn(spark, sf)
    rows = got.collect()
    spent = time.time() - started
    rows = [tuple(r) for r in rows]
    cols, left = frame_rows(got.columns, rows)
    if sql is None:
        return None, f"{len(left)} rows, no SQL", spent
    cur = con.execute(sql)
    names, wanted = [d[0] for d in cur.description], cur.fetchall()
    want_cols, right = frame_rows(names, wanted)
    if cols != want_cols:
        return False, f"columns {cols} != {want_cols}", spent
    if len(left) != len(right):
        return False, f"rows {len(left)} != {len(right)}; first spark-only {sorted(set(left) - set(right), key=str)[:2]} sql-only {sorted(set(right) - set(left), key=str)[:2]}", spent
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(left)} rows differ, e.g. {bad[0]}", spent
    same = frame_rows(got.columns, rows, exact)[1] == frame_rows(names, wanted, exact)[1]
    return True, f"{len(left)} rows" + ("" if same else ", equal after rounding only"), spent


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from accessgraph.session import build_session

    sf = f"/root/testdata/{sys.argv[1]}"
    only = sys.argv[2:]
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf), entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            ok, note, spent = compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as error:  # noqa: BLE001
            ok, note, spent = False, f"{type(error).__name__}: {str(error)[:600]}", 0.0
        if ok is False:
            failed.append(name)
        print(f"{'ok  ' if ok else ('--  ' if ok is None else 'FAIL')} {name} {spent:.1f}s {note}", flush=True)
    print("failed:", failed)
