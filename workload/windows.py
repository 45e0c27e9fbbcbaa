"""Windows, order, limits and duplicates (W, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators.ordering import SortKey, add_group_size, add_positions, decimate_path, deduplicate, top_per_group
from workload.base import GEO_CUSTOMER, GEO_EVENT, geo_customer, geo_event, table


def top_customers(spark, sf_dir):
    order = [F.col("confidence").desc_nulls_last(), F.col("id").asc_nulls_last()]
    return top_per_group(geo_customer(spark, sf_dir), ["country"], order, 5)


def group_sizes(spark, sf_dir):
    return add_group_size(geo_event(spark, sf_dir).select("id", "track_id"), "track_id", "path_points")


def decimated(spark, sf_dir):
    return decimate_path(geo_event(spark, sf_dir), "track_id", "observed_at", 5, ["id"])


def first_rows(spark, sf_dir):
    order = [F.col("observed_at").asc_nulls_last(), F.col("id").asc_nulls_last()]
    return top_per_group(geo_event(spark, sf_dir), ["track_id"], order, 48)


def positions(spark, sf_dir):
    return add_positions(geo_event(spark, sf_dir), "track_id", "observed_at", ["id"], first=["kind"])


def sorted_table(spark, sf_dir):
    """Place of every order in one sort over the whole table."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return add_positions(orders, None, "o_orderdate", ["o_orderkey"]).drop("group_rows")


def mixed_sorted(spark, sf_dir):
    """Place of every line in one sort with directions and null places of its own for every column."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_shipdate")).alias("shipped"), "l_partkey", "l_suppkey", "l_extendedprice")
    order = [SortKey("quantity", descending=True, nulls_first=True), SortKey("shipped"), SortKey("l_extendedprice", descending=True),
             SortKey("l_orderkey", descending=True), "l_linenumber", "l_partkey", "l_suppkey"]
    return add_positions(lines, None, order).drop("group_rows", "l_partkey", "l_suppkey")


def natural_sorted(spark, sf_dir):
    """Place of every part when its name and key are sorted with digit runs as numbers."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("a"), "p_partkey", F.lit("b"), "p_size").alias("code"))
    return add_positions(parts, None, "code", ["p_partkey"]).drop("group_rows")


def top_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").orderBy(
        F.col("p_retailprice").desc_nulls_last(), "p_partkey").limit(260)


def deduplicated(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_orderkey", "l_linenumber", "l_shipdate")
    return deduplicate(li, ["l_partkey", "l_quantity"], ["l_orderkey", "l_linenumber"])


QUERIES = {
    "W1_top_per_group": top_customers, "W2_group_size": group_sizes, "W3_decimate_path": decimated,
    "W4_first_rows": first_rows, "W3_positions": positions, "L1_sorted_table": sorted_table,
    "L1_mixed_directions": mixed_sorted, "L4_natural_sorted": natural_sorted, "L2_top_parts": top_parts, "L6_deduplicate": deduplicated,
}

SQL = {
    "W1_top_per_group": f"""WITH {GEO_CUSTOMER}, ranked AS (SELECT *, row_number() OVER (
          PARTITION BY country ORDER BY confidence DESC NULLS LAST, id) AS rk FROM geo_customer)
        SELECT * EXCLUDE (rk) FROM ranked WHERE rk <= 5""",
    "W2_group_size": "SELECT event_id AS id, user_id AS track_id, count(*) OVER (PARTITION BY user_id) AS path_points FROM events",
    "W3_decimate_path": f"""WITH {GEO_EVENT}, ranked AS (SELECT *,
          row_number() OVER (PARTITION BY track_id ORDER BY observed_at, id) AS rk,
          count(*) OVER (PARTITION BY track_id) AS n FROM geo_event)
        SELECT * EXCLUDE (rk, n) FROM ranked WHERE rk = 1 OR rk = n OR rk % 5 = 0""",
    "W4_first_rows": f"""WITH {GEO_EVENT}, ranked AS (SELECT *,
          row_number() OVER (PARTITION BY track_id ORDER BY observed_at, id) AS rk FROM geo_event)
        SELECT * EXCLUDE (rk) FROM ranked WHERE rk <= 48""",
    "W3_positions": f"""WITH {GEO_EVENT} SELECT *,
          row_number() OVER (PARTITION BY track_id ORDER BY observed_at, id) AS position,
          count(*) OVER (PARTITION BY track_id) AS group_rows,
          first_value(kind) OVER (PARTITION BY track_id ORDER BY observed_at, id) AS first_kind FROM geo_event""",
    "L1_sorted_table": """SELECT o_orderkey, o_orderdate, o_totalprice,
        row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM orders""",
    "L1_mixed_directions": """WITH lines AS (SELECT l_orderkey, l_linenumber,
          CASE WHEN l_linenumber <> 3 THEN l_quantity END AS quantity, CASE WHEN l_orderkey % 5 <> 0 THEN l_shipdate END AS shipped,
          l_extendedprice, l_partkey, l_suppkey FROM lineitem)
        SELECT l_orderkey, l_linenumber, quantity, shipped, l_extendedprice, row_number() OVER (ORDER BY quantity DESC NULLS FIRST,
          shipped NULLS LAST, l_extendedprice DESC NULLS LAST, l_orderkey DESC, l_linenumber, l_partkey, l_suppkey) AS position FROM lines""",
    "L4_natural_sorted": """SELECT p_partkey, 'a' || p_partkey || 'b' || p_size AS code,
        row_number() OVER (ORDER BY p_partkey, p_size) AS position FROM part""",
    "L2_top_parts": """SELECT p_partkey, p_name, p_retailprice FROM part
        ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 260""",
    "L6_deduplicate": """WITH ranked AS (SELECT l_partkey, l_quantity, l_orderkey, l_linenumber, l_shipdate,
          row_number() OVER (PARTITION BY l_partkey, l_quantity ORDER BY l_orderkey, l_linenumber) AS rk FROM lineitem)
        SELECT * EXCLUDE (rk) FROM ranked WHERE rk = 1""",
}
