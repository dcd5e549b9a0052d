"""Domain tables derived from the given parquet tables.

Each flat view is one SQL text that Spark and DuckDB both accept, so a check
can run the same definition on either side. The nested columns of the real
records are added on the Spark side by :func:`domain_tables`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessgraph.schemas import TABLES

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _key(prefix: str, column: str) -> str:
    return f"'{prefix}_' || lpad(CAST({column} AS STRING), 10, '0')"


VIEWS: dict[str, str] = {
    "v_places": f"""
        SELECT {_key('plc', 'c_custkey')} AS id, c_custkey AS k, n.n_nationkey AS nk, n.n_regionkey AS rk,
               CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'retired' WHEN 'MACHINERY' THEN 'historical' ELSE 'active' END AS status,
               DATE '1994-01-01' + CAST(c_custkey % 365 AS INT) AS created_at,
               CASE WHEN (c_mktsegment = 'HOUSEHOLD' AND c_custkey % 50 <> 0) OR c_custkey % 211 = 7
                    THEN DATE '1999-01-01' + CAST(c_custkey % 100 AS INT) END AS retired_at,
               {_key('src', 'n.n_nationkey')} AS source_id, {_key('rec', 'c_custkey')} AS record_id,
               p.p_name AS p_name, p.p_type AS p_type, p.p_size AS p_size, c_name, c_acctbal
        FROM customer c
        JOIN nation n ON n.n_nationkey = c.c_nationkey
        JOIN part p ON p.p_partkey = c.c_custkey""",
    "v_sources": f"""
        SELECT {_key('src', 'n_nationkey')} AS id, n_name AS title,
               CASE WHEN n_nationkey % 10 <> 3 THEN 'https://example.org/' || n_name END AS url,
               CASE WHEN n_nationkey % 10 <> 4 THEN DATE '2001-01-01' + n_nationkey END AS retrieved_at,
               CASE WHEN n_nationkey % 6 <> 5 THEN 'open' END AS licence,
               CASE WHEN n_nationkey % 8 = 7 THEN 'pending' ELSE 'verified' END AS verification_status
        FROM nation""",
    "v_place_classifications": f"""
        SELECT {_key('cls', 'k')} AS id, id AS place_id,
               CASE k % 3 WHEN 0 THEN 'town' WHEN 1 THEN 'settlement' ELSE 'station' END AS feature_type,
               CASE WHEN k % 4 = 0 THEN DATE '1995-06-01' END AS valid_from,
               CASE WHEN k % 11 = 0 THEN DATE '1999-06-01' WHEN k % 97 = 1 THEN DATE '1994-06-01' END AS valid_to,
               source_id, record_id, DATE '2000-01-01' + CAST(k % 300 AS INT) AS observed_at
        FROM v_places
        UNION ALL
        SELECT {_key('cls', 'k + 500000000')} AS id, id AS place_id, 'heliport' AS feature_type,
               DATE '1999-06-02' AS valid_from, CAST(NULL AS DATE) AS valid_to,
               source_id, record_id, DATE '2000-02-01' + CAST(k % 300 AS INT) AS observed_at
        FROM v_places WHERE k % 13 = 0""",
    "v_place_names": f"""
        SELECT {_key('nam', 'k')} AS id, id AS place_id, p_name || ' ' || CAST(k % 40 AS STRING) AS value,
               'kl' AS language, 'official' AS kind, CAST(NULL AS DATE) AS valid_from,
               CASE WHEN k % 17 = 0 THEN DATE '2000-12-31' END AS valid_to,
               source_id, record_id, DATE '2000-03-01' + CAST(k % 200 AS INT) AS observed_at
        FROM v_places
        UNION ALL
        SELECT {_key('nam', 'k + 300000000')} AS id, id AS place_id, c_name AS value, 'da' AS language,
               'exonym' AS kind, DATE '1996-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_to,
               source_id, record_id, DATE '2000-04-01' + CAST(k % 200 AS INT) AS observed_at
        FROM v_places WHERE k % 2 = 0
        UNION ALL
        SELECT {_key('nam', 'k + 600000000')} AS id, id AS place_id, lower(p_type) || ' ' || p_name AS value,
               'kl' AS language, 'historical' AS kind, DATE '1990-01-01' AS valid_from,
               CASE WHEN k % 10 = 0 THEN DATE '1985-01-01' WHEN k % 15 <> 0 THEN DATE '1999-12-31' END AS valid_to,
               source_id, 'old_' || record_id AS record_id, DATE '1999-04-01' AS observed_at
        FROM v_places WHERE k % 5 = 0
        UNION ALL
        SELECT {_key('nam', 'k + 900000000')} AS id, id AS place_id, p_name || ' twin' AS value, 'kl' AS language,
               'official' AS kind, CAST(NULL AS DATE) AS valid_from, CAST(NULL AS DATE) AS valid_to,
               source_id, record_id, DATE '2000-05-01' AS observed_at
        FROM v_places WHERE k % 101 = 3""",
    "v_place_geometries": f"""
        SELECT {_key('geo', 'k')} AS id, id AS place_id,
               -74.0 + CAST((k * 37) % 6000 AS DOUBLE) / 100.0 AS lon,
               59.0 + CAST((k * 53) % 2400 AS DOUBLE) / 100.0 AS lat,
               CAST(NULL AS DATE) AS valid_from,
               CASE WHEN k % 29 = 0 THEN DATE '2000-06-01' END AS valid_to,
               source_id, record_id, DATE '2000-01-15' + CAST(k % 100 AS INT) AS observed_at
        FROM v_places WHERE k % 19 <> 0""",
    "v_administrative_areas": f"""
        SELECT {_key('adm', 'n_nationkey')} AS id, n_name AS name, 'municipality' AS level,
               {_key('src', 'n_nationkey')} AS source_id
        FROM nation
        UNION ALL
        SELECT {_key('adm', 'r_regionkey + 900')} AS id, r_name AS name, 'region' AS level,
               {_key('src', 'r_regionkey')} AS source_id
        FROM region""",
    "v_administrative_memberships": f"""
        SELECT {_key('mem', 'k')} AS id, id AS place_id, {_key('adm', 'nk')} AS administrative_area_id,
               CAST(NULL AS DATE) AS valid_from,
               CASE WHEN k % 23 = 0 THEN DATE '1998-01-01' END AS valid_to,
               source_id, record_id, DATE '2000-07-01' AS observed_at
        FROM v_places
        UNION ALL
        SELECT {_key('mem', 'k + 500000000')} AS id, id AS place_id, {_key('adm', 'rk + 900')} AS administrative_area_id,
               DATE '1997-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_to,
               source_id, record_id, DATE '2000-08-01' AS observed_at
        FROM v_places WHERE k % 3 = 0
        UNION ALL
        SELECT {_key('mem', 'k + 700000000')} AS id, id AS place_id, {_key('adm', 'nk + 5000')} AS administrative_area_id,
               CAST(NULL AS DATE) AS valid_from, DATE '1997-01-01' AS valid_to,
               source_id, record_id, DATE '1996-08-01' AS observed_at
        FROM v_places WHERE k % 331 = 5""",
    "v_external_identifiers": f"""
        SELECT {_key('xid', 's_suppkey')} AS id,
               CASE s_suppkey % 10 WHEN 8 THEN 'area' WHEN 9 THEN 'connection' ELSE 'place' END AS entity_type,
               CASE s_suppkey % 10 WHEN 8 THEN {_key('adm', 's_nationkey')} WHEN 9 THEN {_key('con', 's_suppkey')}
                    ELSE {_key('plc', '(s_suppkey * 7) % (SELECT count(*) + 3 FROM customer)')} END AS entity_id,
               'ns_' || CAST(s_nationkey % 3 AS STRING) AS namespace,
               'X' || CAST(s_suppkey - s_suppkey % 4 + s_suppkey % 3 AS STRING) AS value,
               CAST(NULL AS DATE) AS valid_from,
               CASE WHEN s_suppkey % 9 = 0 THEN DATE '2000-09-01' END AS valid_to,
               {_key('src', 's_nationkey')} AS source_id, {_key('rec', 's_suppkey')} AS record_id
        FROM supplier""",
    "v_connections": f"""
        SELECT {_key('con', 'o_orderkey')} AS id, {_key('plc', 'o_custkey')} AS origin_place_id,
               {_key('plc', '(o_orderkey * 31) % (SELECT count(*) FROM customer)')} AS destination_place_id,
               CASE o_orderstatus WHEN 'P' THEN 'bidirectional' ELSE 'one_way' END AS direction,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'air' WHEN '2' THEN 'helicopter' WHEN '3' THEN 'sea'
                    WHEN '4' THEN 'local_boat' ELSE 'road' END AS mode,
               CAST(o_orderdate AS DATE) AS created_at,
               CASE WHEN o_orderkey % 12 = 5 THEN CAST(o_orderdate AS DATE) + 700 END AS retired_at
        FROM orders""",
    "v_connection_services": f"""
        SELECT {_key('svc', 'l_orderkey')} || '_' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey AS STRING) AS id,
               {_key('con', 'l_orderkey')} AS connection_id,
               CASE WHEN l_partkey % 7 <> 0 THEN 'OP' || CAST(l_suppkey AS STRING) END AS operator,
               CASE l_returnflag WHEN 'A' THEN 'passenger' WHEN 'N' THEN 'freight' ELSE 'emergency' END AS cap1,
               CASE WHEN l_quantity > 40 THEN 'passenger' END AS cap2,
               CASE WHEN l_linenumber % 2 = 1 THEN 'seasonal' WHEN l_partkey % 11 = 0 THEN CAST(NULL AS STRING)
                    WHEN l_partkey % 5 = 0 THEN 'irregular' ELSE 'year_round' END AS season_kind,
               CASE WHEN l_linenumber % 2 = 1 AND l_partkey % 31 <> 0 THEN l_linenumber
                    WHEN l_linenumber = 2 AND l_partkey % 37 = 0 THEN 2 END AS month_from,
               CASE WHEN l_linenumber % 2 = 1 AND l_partkey % 31 <> 0 THEN l_linenumber + 3
                    WHEN l_linenumber = 2 AND l_partkey % 37 = 0 THEN 3 END AS month_to,
               CASE WHEN l_partkey % 9 = 0 THEN CAST(NULL AS STRING) WHEN l_quantity > 25 THEN 'daily' ELSE 'weekly' END AS frequency_band,
               CASE WHEN l_partkey % 13 = 0 THEN 'suspended' ELSE 'active' END AS status,
               CAST(l_shipdate AS DATE) AS valid_from,
               CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) + (CASE WHEN l_partkey % 41 = 0 THEN -10 ELSE 365 END) END AS valid_to,
               {_key('src', 'l_suppkey % 26')} AS source_id, {_key('rec', 'l_partkey')} AS record_id,
               CAST(l_shipdate AS DATE) + 5 AS observed_at
        FROM lineitem""",
    "v_register": """
        SELECT p_partkey AS record_id, '{' || CASE WHEN p_partkey % 2 = 0 THEN 'ab' ELSE 'AB' END || CAST(p_partkey AS STRING) || '}' AS gid,
               CASE WHEN p_partkey % 40 = 3 THEN '  ' ELSE ' ' || p_name || ' ' || CAST(p_partkey % 25 AS STRING) END AS official_raw,
               CASE WHEN p_partkey % 3 = 0 THEN p_name || 'en' WHEN p_partkey % 3 = 1 THEN ' ' END AS danish_raw,
               CASE WHEN p_partkey % 4 = 0 THEN lower(p_type) || ' ' || p_name END AS old_raw,
               CASE WHEN p_partkey % 10 < 2 THEN 21 + 2 * (p_partkey % 2) WHEN p_partkey % 10 = 2 THEN 143
                    WHEN p_partkey % 10 = 3 THEN 181 + p_partkey % 3 ELSE p_size * 4 - 3 END AS type_code,
               CASE WHEN p_partkey % 12 = 0 THEN NULL WHEN p_partkey % 12 = 1 THEN 961 WHEN p_partkey % 12 = 2 THEN 999
                    ELSE 955 + p_partkey % 6 END AS municipality_code,
               CASE WHEN p_partkey % 60 = 9 THEN NULL ELSE -74.0 + CAST((p_partkey * 37) % 6000 AS DOUBLE) / 100.0 END AS lon,
               59.0 + CAST((p_partkey * 53) % 2400 AS DOUBLE) / 100.0 AS lat
        FROM part""",
    "v_features": """
        SELECT record_id, replace(replace(trim(gid), '{', ''), '}', '') AS global_id, trim(official_raw) AS official_name,
               nullif(trim(danish_raw), '') AS danish_name, nullif(trim(old_raw), '') AS old_official_name,
               CAST(type_code AS INT) AS type_code, CAST(municipality_code AS INT) AS municipality_code,
               lon AS longitude, lat AS latitude
        FROM v_register WHERE trim(official_raw) <> '' AND lon IS NOT NULL""",
    "v_name_queries": """
        SELECT s_suppkey AS query_id, CASE s_suppkey % 5 WHEN 0 THEN ' ' || upper(p_name) || ' 3' WHEN 1 THEN substr(p_name, 1, 5)
               WHEN 2 THEN substr(p_name, 4, 6) WHEN 3 THEN replace(p_name, 'e', '') || ' 1' ELSE p_name || 'en' END AS q
        FROM supplier JOIN part ON p_partkey = s_suppkey * 3""",
    "v_points": """
        SELECT 'trip_' || CAST(user_id AS STRING) AS trip_id,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS sequence,
               60.0 + CAST((event_id * 7919) % 100000 AS DOUBLE) / 10000.0 AS latitude,
               -55.0 + CAST((event_id * 104729) % 100000 AS DOUBLE) / 10000.0 AS longitude,
               CASE WHEN event_id % 23 = 0 THEN NULL ELSE value END AS accuracy,
               ts AS recorded_at, event_type, event_id, user_id
        FROM events""",
    "v_land": """
        SELECT s_suppkey AS polygon_id, -74.0 + CAST((s_suppkey * 137) % 5900 AS DOUBLE) / 100.0 AS w,
               59.0 + CAST((s_suppkey * 71) % 2350 AS DOUBLE) / 100.0 AS s
        FROM supplier""",
    "v_land_edges": """
        SELECT polygon_id, 0 AS ring, w + 1.2 AS x1, s AS y1, w AS x2, s + 0.1 AS y2 FROM v_land
        UNION ALL SELECT polygon_id, 0, w + 1.1, s + 0.8, w + 1.2, s FROM v_land
        UNION ALL SELECT polygon_id, 0, w + 0.2, s + 0.9, w + 1.1, s + 0.8 FROM v_land
        UNION ALL SELECT polygon_id, 0, w, s + 0.1, w + 0.2, s + 0.9 FROM v_land
        UNION ALL SELECT polygon_id, 1, w + 0.7, s + 0.24, w + 0.4, s + 0.3 FROM v_land
        UNION ALL SELECT polygon_id, 1, w + 0.8, s + 0.6, w + 0.7, s + 0.24 FROM v_land
        UNION ALL SELECT polygon_id, 1, w + 0.4, s + 0.3, w + 0.8, s + 0.6 FROM v_land""",
}


def _needs(sql: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]


def view_closure(names: list[str]) -> list[str]:
    """The views and all they build on, in definition order."""
    wanted: set[str] = set()
    stack = list(names)
    while stack:
        name = stack.pop()
        if name not in wanted:
            wanted.add(name)
            stack.extend(_needs(VIEWS[name]))
    return [name for name in VIEWS if name in wanted]


def with_views(body: str) -> str:
    """``body`` preceded by the definitions of the views it reads."""
    names = view_closure(_needs(body))
    if not names:
        return body
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in names)
    head = body.lstrip()
    if head.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{head[len('WITH RECURSIVE'):]}"
    if head.upper().startswith("WITH"):
        return f"WITH {ctes},\n{head[4:]}"
    return f"WITH {ctes}\n{head}"


_OPENED: dict[tuple[str, str, str], DataFrame] = {}


def base(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once per application."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _OPENED:
        _OPENED[key] = spark.read.parquet(f"{sf}/{name}.parquet")
    return _OPENED[key]


# Tables that grow and that a view joins; a few columns of a compressed file look small to Catalyst, and it would broadcast them.
MERGED = {("v_places", "part"), ("v_name_queries", "part")}


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One flat view as a DataFrame over the parquet files of ``sf``."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _OPENED:
        inputs = {table: base(spark, sf, table) for table in BASE if re.search(rf"\b{table}\b", VIEWS[name])}
        inputs = {table: df.hint("merge") if (name, table) in MERGED else df for table, df in inputs.items()}
        inputs.update({other: view(spark, sf, other) for other in _needs(VIEWS[name])})
        sql = VIEWS[name]
        for table in inputs:
            # A table name inside quotes is an ordinary value.
            sql = re.sub(rf"('[^']*')|\b{table}\b", lambda m, t=table: m[1] or "{" + t + "}", sql)
        sql = sql.replace("'{'", "'{{'").replace("'}'", "'}}'")
        _OPENED[key] = spark.sql(sql, **inputs)
    return _OPENED[key]


def _refs(df: DataFrame) -> DataFrame:
    if "record_id" not in df.columns:
        df = df.withColumn("record_id", F.lit(None).cast("string"))
    return df.withColumn("source_refs", F.array(F.struct("source_id", "record_id")))


def _shape(df: DataFrame, table: str) -> DataFrame:
    """Bring a view to the columns and types of its table."""
    schema = TABLES[table]
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def _record(spark: SparkSession, sf: str, name: str) -> DataFrame:
    flat = view(spark, sf, f"v_{name}")
    if "source_id" in flat.columns:
        flat = _refs(flat)
    if name == "place_geometries":
        flat = flat.withColumn(
            "geometry", F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
        )
    if name == "connection_services":
        months = F.when(
            F.col("month_from").isNotNull(), F.sequence(F.col("month_from"), F.col("month_to"))
        ).otherwise(F.array().cast("array<int>"))
        flat = (
            flat.withColumn("capabilities", F.array_compact(F.array("cap1", "cap2")))
            .withColumn("seasonality", F.struct(F.col("season_kind").alias("kind"), months.alias("months")))
            .withColumn("frequency_basis", F.lit("typical"))
        )
    return _shape(flat, name)


class DomainTables(Mapping):
    """The ten canonical tables, each opened on first use."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self._spark, self._sf, self._open = spark, sf, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            if name not in TABLES:
                raise KeyError(name)
            self._open[name] = _record(self._spark, self._sf, name)
        return self._open[name]

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


def domain_tables(spark: SparkSession, sf: str) -> DomainTables:
    return DomainTables(spark, sf)
