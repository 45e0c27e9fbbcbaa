"""Joins and what plain SQL reaches through the guard (J, X)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from geoloom.functions.geojson import explode_edges
from geoloom.operators.asof import asof_join
from geoloom.operators.closure import chain_depths
from geoloom.operators.near import near_join
from geoloom.operators.region import assign_region
from geoloom.operators.skew import lookup_join
from workload.base import (
    GEO_CUSTOMER, GEO_EVENT, GEO_NATION_EDGE, geo_customer, geo_event, geo_nation, geo_nation_edge, table, workspace,
)


def near_pairs(spark, sf_dir):
    # Pairs are within calendar days and show no time, so rows move with their day alone.
    ev = geo_event(spark, sf_dir).withColumn("observed_on", F.to_date("observed_at"))
    left = ev.where(F.col("kind") == "error").select("id", "observed_on", "latitude", "longitude")
    right = ev.where(F.col("kind") == "purchase").select(
        F.col("id").alias("other_id"), F.col("observed_on").alias("other_day"),
        F.col("latitude").alias("other_latitude"), F.col("longitude").alias("other_longitude"))
    pairs = near_join(left, right, ("latitude", "longitude", "observed_on"),
                      ("other_latitude", "other_longitude", "other_day"))
    return pairs.select("id", "other_id", "distance_km")


def regions(spark, sf_dir):
    placed = assign_region(geo_customer(spark, sf_dir), geo_nation_edge(spark, sf_dir), "polygon_id")
    return placed.select("id", "latitude", "longitude", "region_id")


def regions_of_text(spark, sf_dir):
    edges = explode_edges(geo_nation(spark, sf_dir), "geometry_geojson", ["country_id"])
    placed = assign_region(geo_event(spark, sf_dir), edges, "country_id", name="country_id")
    return placed.select("id", "country_id")


def event_observations(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderpriority")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return lookup_join(li, orders, "l_orderkey", "inner")


def latest_purchase(spark, sf_dir):
    ev = geo_event(spark, sf_dir)
    left = ev.where(F.col("kind") == "error").select("id", "track_id", "observed_at")
    right = ev.where(F.col("kind") == "purchase").select(
        "track_id", F.col("id").alias("purchase_id"), F.col("observed_at").alias("purchase_time"),
        F.col("value").alias("purchase_value"))
    return asof_join(left, right, "track_id", "observed_at", "purchase_time", "purchase_id")


def partial_sample(spark, sf_dir):
    """A tenth of the lines, by a seed: its size lies within five standard deviations, the same seed gives the same rows,
    and all are rows of the table."""
    ws = workspace(spark, sf_dir)
    text = "SELECT l_orderkey, l_linenumber FROM lineitem TABLESAMPLE (10 PERCENT) REPEATABLE (42)"
    ws.execute_sql(text)
    ws.execute_sql(text)
    return ws.query("""SELECT (SELECT count(*) FROM lineitem) AS population,
          abs((SELECT count(*) FROM _result_0001) - 0.1D * (SELECT count(*) FROM lineitem))
            <= 5 * sqrt(0.09D * (SELECT count(*) FROM lineitem)) AS of_size,
          (SELECT count(*) FROM (SELECT * FROM _result_0001 EXCEPT ALL SELECT * FROM _result_0002)) AS unrepeated,
          (SELECT count(*) FROM (SELECT * FROM _result_0001 EXCEPT ALL SELECT l_orderkey, l_linenumber FROM lineitem)) AS strangers""")


def order_chains(spark, sf_dir):
    """Every order's first order of its customer, and its number of orders since, by following one link at a time."""
    orders = table(spark, sf_dir, "orders")
    before = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    links = orders.select(F.col("o_orderkey").alias("node"), F.lag("o_orderkey").over(before).alias("parent"))
    return chain_depths(links).select(F.col("node").alias("o_orderkey"), F.col("root").alias("first_order"), "depth")


# Texts that both engines read alike.
SHARED = {
    "X1_outer_joins": """SELECT c.c_custkey, count(o.o_orderkey) AS orders, sum(CASE WHEN c.c_custkey IS NULL THEN 1 ELSE 0 END)
          AS strays FROM customer AS c FULL JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000
        GROUP BY c.c_custkey""",
    "X1_semi_anti": """SELECT 'with' AS kind, count(*) AS customers FROM customer AS c SEMI JOIN orders AS o
          ON c.c_custkey = o.o_custkey
        UNION ALL SELECT 'without', count(*) FROM customer AS c ANTI JOIN orders AS o ON c.c_custkey = o.o_custkey""",
    "X1_cross": """SELECT r.r_name, n.n_name, s.suppliers, s.suppliers * 100 + r.r_regionkey AS code
        FROM region AS r CROSS JOIN nation AS n
        CROSS JOIN (SELECT count(*) AS suppliers, max(s_acctbal) AS largest FROM supplier) AS s""",
    "X1_lateral": """SELECT c.c_custkey, t.total FROM customer AS c,
        LATERAL (SELECT round(sum(o.o_totalprice), 2) AS total FROM orders AS o WHERE o.o_custkey = c.c_custkey) AS t""",
    "X2_rollup": """SELECT l_returnflag, l_linestatus, count(*) AS lines, grouping(l_linestatus) AS level FROM lineitem
        GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "X2_grouping_sets": """SELECT l_returnflag, l_linestatus, l_linenumber, count(*) FILTER (WHERE l_quantity > 25) AS big_lines
        FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())""",
    "X2_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS orders FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "X2_group_all": "SELECT l_returnflag, l_linenumber, max(l_quantity) AS largest FROM lineitem GROUP BY ALL",
    "X3_windows": """SELECT event_id, user_id, lag(value) OVER w AS previous, lead(value) OVER w AS following,
          rank() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST) AS place,
          max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS recent_max
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
    "X4_set_operations": """(SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier)
        UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)""",
    "X4_bag_operations": """SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier""",
    "X5_subqueries": """SELECT o_orderkey, o_totalprice FROM orders AS o
        WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders AS p WHERE p.o_custkey = o.o_custkey)
          AND EXISTS (SELECT 1 FROM lineitem AS l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)
          AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
    "X6_recursive": """WITH RECURSIVE walk(conv_id, turn, depth) AS (
          SELECT conv_id, turn, 1 FROM conversations WHERE turn = 0
          UNION ALL
          SELECT c.conv_id, c.turn, walk.depth + 1 FROM walk JOIN conversations AS c
            ON c.conv_id = walk.conv_id AND c.turn = walk.turn + 1)
        SELECT conv_id, max(depth) AS depth FROM walk GROUP BY conv_id""",
}
SPARK_ONLY = {
    "X7_pivot": """SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem)
        PIVOT (sum(l_quantity) FOR l_linestatus IN ('F' AS filled, 'O' AS open))""",
    "X7_whole_sample": "SELECT o_orderkey, o_custkey FROM orders TABLESAMPLE (100 PERCENT)",
    "X8_functions": """SELECT event_id, upper(event_type) AS kind, date_format(ts, 'yyyy-MM') AS month,
          CAST(get_json_object(props, '$.k') AS INT) AS k, CAST(size(split(props, ':')) AS BIGINT) AS parts,
          element_at(map('view', 'seen', 'click', 'used'), event_type) AS word FROM events""",
}


def _guarded(text):
    return lambda spark, sf_dir: workspace(spark, sf_dir).query(text)


# X4 starts with a bracket, which the guard does not take; the text is wrapped for it.
_WRAPPED = {"X4_set_operations": f"SELECT * FROM ({SHARED['X4_set_operations']}) AS t"}

QUERIES = {
    "J1_near_pairs": near_pairs, "J2_regions": regions, "J2_regions_of_text": regions_of_text,
    "J3_event_observations": event_observations, "X9_asof": latest_purchase,
    "X6_chain_depths": order_chains, "X7_partial_sample": partial_sample,
    **{name: _guarded(_WRAPPED.get(name, text)) for name, text in {**SHARED, **SPARK_ONLY}.items()},
}

_INSIDE = """SELECT p.id, min(k) AS region FROM (
          SELECT c.id, e.polygon_id AS k FROM {points} AS c JOIN geo_nation_edge AS e
            ON (e.y1 > c.latitude) <> (e.y2 > c.latitude)
            AND c.longitude < (e.x2 - e.x1) * (c.latitude - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1
          GROUP BY c.id, e.polygon_id HAVING count(*) % 2 = 1) AS p GROUP BY p.id"""

SQL = {
    "J1_near_pairs": f"""WITH {GEO_EVENT}, pairs AS (
          SELECT l.id, s.id AS other_id, round(111.2e0 * sqrt(pow(l.latitude - s.latitude, 2)
            + pow((l.longitude - s.longitude) * cos(radians(l.latitude)), 2)), 1) AS distance_km
          FROM geo_event AS l JOIN geo_event AS s ON l.kind = 'error' AND s.kind = 'purchase'
            AND abs(date_diff('day', l.observed_at, s.observed_at)) <= 1
            AND abs(l.latitude - s.latitude) < 5 AND abs(l.longitude - s.longitude) < 7)
        SELECT * FROM pairs WHERE distance_km <= 500""",
    "J2_regions": f"""WITH {GEO_CUSTOMER}, {GEO_NATION_EDGE}, inside AS ({_INSIDE.format(points="geo_customer")})
        SELECT c.id, c.latitude, c.longitude, i.region AS region_id
        FROM geo_customer AS c LEFT JOIN inside AS i ON c.id = i.id""",
    "J2_regions_of_text": f"""WITH {GEO_EVENT}, {GEO_NATION_EDGE}, inside AS ({_INSIDE.format(points="geo_event")})
        SELECT c.id, i.region AS country_id FROM geo_event AS c LEFT JOIN inside AS i ON c.id = i.id""",
    "J3_event_observations": """SELECT l_orderkey, l_linenumber, l_quantity, o_orderdate, o_orderpriority
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "X9_asof": """SELECT l.event_id AS id, l.user_id AS track_id, l.ts AS observed_at, r.event_id AS purchase_id,
          r.ts AS purchase_time, r.value AS purchase_value
        FROM (SELECT * FROM events WHERE event_type = 'error') AS l
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') AS r
          ON l.user_id = r.user_id AND l.ts >= r.ts""",
    **SHARED,
    "X7_pivot": """SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS filled,
        sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS open FROM lineitem GROUP BY l_returnflag""",
    "X6_chain_depths": """SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_order, row_number() OVER w - 1 AS depth FROM orders
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) QUALIFY depth > 0""",
    "X7_partial_sample": "SELECT count(*) AS population, true AS of_size, 0 AS unrepeated, 0 AS strangers FROM lineitem",
    "X7_whole_sample": "SELECT o_orderkey, o_custkey FROM orders",
    "X8_functions": """SELECT event_id, upper(event_type) AS kind, strftime(ts, '%Y-%m') AS month,
        CAST(json_extract_string(props, '$.k') AS INT) AS k, len(string_split(props, ':')) AS parts,
        CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'used' END AS word FROM events""",
}
