"""Test tables and the geographic views derived from their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.plans.workspace import Workspace
from geoloom.session import isolated_session

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession, sf_dir: str, result_cap: int | None = None) -> Workspace:
    """A workspace with names of its own over the test tables."""
    ws = Workspace(isolated_session(spark), result_cap)
    for name in TABLES:
        ws.add_relation(name, lambda name=name: table(ws.spark, sf_dir, name))
    return ws


def _spread(key: str, factor: int, size: int, start: float):
    return ((F.col(key) * factor) % size).cast("double") / F.lit(100.0) + F.lit(start)


def geo_customer(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("country"),
        F.col("c_mktsegment").alias("brand"), F.col("c_acctbal").alias("confidence"),
        _spread("c_custkey", 7919, 17001, -85.0).alias("latitude"),
        _spread("c_custkey", 10473, 36000, -180.0).alias("longitude"),
    )


def geo_supplier(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("place_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("country"),
        F.col("s_acctbal").alias("confidence"), _spread("s_suppkey", 7919, 17001, -85.0).alias("latitude"),
        _spread("s_suppkey", 10473, 36000, -180.0).alias("longitude"),
    )


def geo_event(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("track_id"), F.col("event_type").alias("kind"),
        F.col("ts").alias("observed_at"), "value", _spread("event_id", 7919, 4001, 15.0).alias("latitude"),
        _spread("event_id", 10473, 7000, -80.0).alias("longitude"),
    )


# An L shape, so bounding boxes and convex hulls give wrong answers.
L_EDGES = [(0, 0, 30, 0), (30, 0, 30, 10), (30, 10, 10, 10), (10, 10, 10, 25), (10, 25, 0, 25), (0, 25, 0, 0)]


def _nation_origin():
    x = (F.col("n_nationkey") % 5) * 72 - 180
    y = F.floor(F.col("n_nationkey") / 5).cast("int") * 34 - 85
    return x, y


def geo_nation_edge(spark, sf_dir) -> DataFrame:
    """Six directed edges per nation."""
    x, y = _nation_origin()
    shape = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e)])
                      for k, e in enumerate(L_EDGES)])
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", x.alias("x0"), y.alias("y0"), F.explode(shape).alias("e")
    ).select(
        F.col("n_nationkey").alias("polygon_id"), "e.k", (F.col("e.x1") + F.col("x0")).cast("double").alias("x1"),
        (F.col("e.y1") + F.col("y0")).cast("double").alias("y1"),
        (F.col("e.x2") + F.col("x0")).cast("double").alias("x2"),
        (F.col("e.y2") + F.col("y0")).cast("double").alias("y2"),
    )


def geo_nation(spark, sf_dir) -> DataFrame:
    """The same polygons as GeoJSON text."""
    x, y = _nation_origin()
    ring = [(e[0], e[1]) for e in L_EDGES] + [(0, 0)]
    parts = []
    for i, (dx, dy) in enumerate(ring):
        parts += [F.lit("],[" if i else '{"type":"Polygon","coordinates":[[['), (x + dx).cast("string"), F.lit(","),
                  (y + dy).cast("string")]
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("country_id"), F.col("n_name").alias("name"),
        F.concat(*parts, F.lit("]]]}")).alias("geometry_geojson"),
    )


# The same views as SQL, for the comparison engine.
GEO_CUSTOMER = """geo_customer AS (
  SELECT c_custkey AS id, c_name AS name, c_nationkey AS country, c_mktsegment AS brand, c_acctbal AS confidence,
    CAST((c_custkey * 7919) % 17001 AS DOUBLE) / 1e2 - 8.5e1 AS latitude,
    CAST((c_custkey * 10473) % 36000 AS DOUBLE) / 1e2 - 1.8e2 AS longitude
  FROM customer)"""
GEO_SUPPLIER = """geo_supplier AS (
  SELECT s_suppkey AS place_id, s_name AS name, s_nationkey AS country, s_acctbal AS confidence,
    CAST((s_suppkey * 7919) % 17001 AS DOUBLE) / 1e2 - 8.5e1 AS latitude,
    CAST((s_suppkey * 10473) % 36000 AS DOUBLE) / 1e2 - 1.8e2 AS longitude
  FROM supplier)"""
GEO_EVENT = """geo_event AS (
  SELECT event_id AS id, user_id AS track_id, event_type AS kind, ts AS observed_at, value,
    CAST((event_id * 7919) % 4001 AS DOUBLE) / 1e2 + 1.5e1 AS latitude,
    CAST((event_id * 10473) % 7000 AS DOUBLE) / 1e2 - 8e1 AS longitude
  FROM events)"""
GEO_NATION_EDGE = """geo_nation_edge AS (
  SELECT n_nationkey AS polygon_id, k,
    CAST(x1 + (n_nationkey % 5) * 72 - 180 AS DOUBLE) AS x1,
    CAST(y1 + CAST(floor(n_nationkey / 5e0) AS INT) * 34 - 85 AS DOUBLE) AS y1,
    CAST(x2 + (n_nationkey % 5) * 72 - 180 AS DOUBLE) AS x2,
    CAST(y2 + CAST(floor(n_nationkey / 5e0) AS INT) * 34 - 85 AS DOUBLE) AS y2
  FROM nation CROSS JOIN (VALUES (0, 0, 0, 30, 0), (1, 30, 0, 30, 10), (2, 30, 10, 10, 10),
    (3, 10, 10, 10, 25), (4, 10, 25, 0, 25), (5, 0, 25, 0, 0)) AS v(k, x1, y1, x2, y2))"""
GEO_NATION = """geo_nation AS (
  SELECT n_nationkey AS country_id, n_name AS name, concat('{"type":"Polygon","coordinates":[[[',
    CAST(x AS VARCHAR), ',', CAST(y AS VARCHAR), '],[', CAST(x + 30 AS VARCHAR), ',', CAST(y AS VARCHAR), '],[',
    CAST(x + 30 AS VARCHAR), ',', CAST(y + 10 AS VARCHAR), '],[', CAST(x + 10 AS VARCHAR), ',',
    CAST(y + 10 AS VARCHAR), '],[', CAST(x + 10 AS VARCHAR), ',', CAST(y + 25 AS VARCHAR), '],[',
    CAST(x AS VARCHAR), ',', CAST(y + 25 AS VARCHAR), '],[', CAST(x AS VARCHAR), ',', CAST(y AS VARCHAR),
    ']]]}') AS geometry_geojson
  FROM (SELECT n_nationkey, n_name, (n_nationkey % 5) * 72 - 180 AS x,
    CAST(floor(n_nationkey / 5e0) AS INT) * 34 - 85 AS y FROM nation) AS g)"""
