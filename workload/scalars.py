"""Projections, filters, expressions, text and time functions (R, Q9, G7, G8, L4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions.color import palette_color, text_hash
from geoloom.functions.geo import angular_degrees, approx_km, relative_altitude, ring_radius, rounded
from geoloom.functions.text import natural_key, row_label
from geoloom.functions.times import day_difference, epoch_timestamp, iso_text
from workload.base import GEO_CUSTOMER, GEO_EVENT, GEO_NATION, geo_customer, geo_event, geo_nation, table


def projection(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        F.col("l_shipdate").alias("shipped"),
    )


def comparisons(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kept = ((F.col("l_quantity") >= 30) & (F.col("l_discount") <= 0.05) & (F.col("l_returnflag") != "N")) | (
        (F.col("l_quantity") < 2) & (F.col("l_linestatus") == "O"))
    return li.where(kept).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


def in_list(spark, sf_dir):
    return geo_nation(spark, sf_dir).where(
        F.col("name").isin("NATION_2", "NATION_3", "NATION_6", "NATION_7", "NATION_18", "NATION_23"))


def not_null(spark, sf_dir):
    emptied = F.when(F.col("value") > 100, F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", emptied.alias("value")).where(F.col("value").isNotNull())


def quoted_text(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.concat("c_mktsegment", F.lit("'s")) == "BUILDING's").select(
        "c_custkey", F.concat("c_name", F.lit("'s")).alias("owner"))


def exclusion(spark, sf_dir):
    return table(spark, sf_dir, "orders").drop("o_orderstatus", "o_orderpriority")


def arithmetic(spark, sf_dir):
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", rounded(value, 1).alias("r1"), rounded(value / 7 - 20, 3).alias("r3"),
        rounded(F.abs(value - 200), 6).alias("distance"), rounded(F.sqrt("value"), 6).alias("root"),
        rounded(F.pow(value, F.lit(2)), 3).alias("square"), rounded(F.cos(F.radians("value")), 6).alias("cosine"),
        (F.col("event_id") % 5).alias("rest"),
    )


def day_differences(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", day_difference(F.col("o_orderdate"), F.col("l_shipdate")).alias("days"))


def time_arithmetic(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", (F.col("ts") + F.expr("INTERVAL '36' HOUR")).alias("later"),
        F.col("ts").cast("date").cast("string").alias("day"), F.col("value").cast("bigint").alias("whole"),
    )


def with_query(spark, sf_dir):
    recent = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 100000)
    by_customer = recent.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    return by_customer.where(F.col("orders") >= 2)


def near_km(spark, sf_dir):
    ev = geo_event(spark, sf_dir)
    return ev.select("id", rounded(approx_km(F.col("latitude"), F.col("longitude"), F.lit(38.5), F.lit(-28.25)), 3).alias("km"))


def angles(spark, sf_dir):
    cu = geo_customer(spark, sf_dir)
    angle = angular_degrees(F.lit(12.5), F.lit(170.0), F.col("latitude"), F.col("longitude"))
    return cu.select("id", rounded(angle, 6).alias("degrees"))


def epoch_times(spark, sf_dir):
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    millis = F.floor(micros / 1000).cast("bigint")
    return table(spark, sf_dir, "events").select(
        "event_id", epoch_timestamp(millis).alias("from_guess"), epoch_timestamp(micros, "us").alias("from_us"),
        epoch_timestamp(micros * 1000, "ns").alias("from_ns"), iso_text(F.col("ts")).alias("iso"),
    )


def colors(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text_hash(F.col("c_name")).alias("hash"), palette_color(F.col("c_name")).alias("color"))


def document_hashes(spark, sf_dir):
    """Hash of whole texts, all scripts."""
    return table(spark, sf_dir, "documents").select("doc_id", text_hash(F.col("text")).alias("hash"))


def natural_order(spark, sf_dir):
    text = F.concat("p_type", F.lit(" "), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", natural_key(text).alias("sort_key"))


def altitudes(spark, sf_dir):
    price = F.when(F.col("p_size") > 5, F.col("p_retailprice") * 100 - 95000)
    return table(spark, sf_dir, "part").select(
        "p_partkey", rounded(relative_altitude(price, 0.014), 9).alias("altitude"),
        rounded(ring_radius(price, 6.0), 9).alias("ring_radius"))


def labels(spark, sf_dir):
    name = F.when(F.col("p_size") > 10, F.col("p_name"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", row_label(name, None).alias("label"), row_label(None, F.col("p_size")).alias("group_label"))


QUERIES = {
    "R1_projection": projection, "R2_comparisons": comparisons, "R3_in_list": in_list, "R4_not_null": not_null,
    "R5_quoted_text": quoted_text, "R6_exclusion": exclusion, "R7_arithmetic": arithmetic,
    "R8_day_difference": day_differences, "R9_time_arithmetic": time_arithmetic, "R10_with_query": with_query,
    "R11_approx_km": near_km, "R12_angular_degrees": angles, "Q9_epoch_times": epoch_times, "G8_palette": colors,
    "G8_text_hash": document_hashes, "L4_natural_order": natural_order, "G7_altitude": altitudes, "G12_labels": labels,
}

_HASH = """list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, length({t}) + 1),
  lambda i: CAST(unicode(substr({t}, i, 1)) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296)"""
_TEXT_HASH = _HASH.format(t="text")
_SIGNED = "CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END"

SQL = {
    "R1_projection": """SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net,
        l_shipdate AS shipped FROM lineitem""",
    "R2_comparisons": """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
        WHERE (l_quantity >= 30 AND l_discount <= 0.05 AND l_returnflag <> 'N') OR (l_quantity < 2 AND l_linestatus = 'O')""",
    "R3_in_list": f"""WITH {GEO_NATION} SELECT * FROM geo_nation
        WHERE name IN ('NATION_2', 'NATION_3', 'NATION_6', 'NATION_7', 'NATION_18', 'NATION_23')""",
    "R4_not_null": """SELECT * FROM (SELECT event_id, CASE WHEN value > 100 THEN value END AS value FROM events) AS e
        WHERE value IS NOT NULL""",
    "R5_quoted_text": """SELECT c_custkey, c_name || '''s' AS owner FROM customer
        WHERE c_mktsegment || '''s' = 'BUILDING''s'""",
    "R6_exclusion": "SELECT * EXCLUDE (o_orderstatus, o_orderpriority) FROM orders",
    "R7_arithmetic": """SELECT event_id, round(value, 1) AS r1, round(value / 7 - 20, 3) AS r3,
        round(abs(value - 200), 6) AS distance, round(sqrt(value), 6) AS root, round(pow(value, 2), 3) AS square,
        round(cos(radians(value)), 6) AS cosine, event_id % 5 AS rest FROM events""",
    "R8_day_difference": """SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS days
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "R9_time_arithmetic": """SELECT event_id, ts + INTERVAL 36 HOUR AS later, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
        CAST(trunc(value) AS BIGINT) AS whole FROM events""",
    "R10_with_query": """WITH recent AS (SELECT * FROM orders WHERE o_totalprice > 100000),
        by_customer AS (SELECT o_custkey, count(*) AS orders FROM recent GROUP BY o_custkey)
        SELECT * FROM by_customer WHERE orders >= 2""",
    "R11_approx_km": f"""WITH {GEO_EVENT} SELECT id, round(111.2e0 * sqrt(pow(latitude - 38.5e0, 2) +
        pow((longitude + 28.25e0) * cos(radians(latitude)), 2)), 3) AS km FROM geo_event""",
    "R12_angular_degrees": f"""WITH {GEO_CUSTOMER} SELECT id, round(degrees(acos(greatest(-1e0, least(1e0,
        sin(radians(12.5e0)) * sin(radians(latitude)) + cos(radians(12.5e0)) * cos(radians(latitude))
        * cos(radians(longitude) - radians(170e0)))))), 6) AS degrees FROM geo_customer""",
    "Q9_epoch_times": """SELECT event_id, date_trunc('millisecond', ts) AS from_guess, ts AS from_us, ts AS from_ns,
        strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM events""",
    "G8_palette": f"""WITH hashed AS (SELECT c_custkey, {_HASH.format(t="c_name")} AS h FROM customer),
        signed AS (SELECT c_custkey, {_SIGNED} AS hash FROM hashed)
        SELECT c_custkey, hash, ['#62cce1', '#a9cc63', '#ee8869', '#b394e8', '#63d2aa', '#ee7287'][abs(hash) % 6 + 1] AS color
        FROM signed""",
    "G8_text_hash": f"""WITH hashed AS (SELECT doc_id, {_TEXT_HASH} AS h FROM documents)
        SELECT doc_id, {_SIGNED} AS hash FROM hashed""",
    "L4_natural_order": """SELECT p_partkey, lower(p_type) || ' ' || lpad(CAST(length(CAST(p_partkey AS VARCHAR)) AS VARCHAR), 4, '0')
        || CAST(p_partkey AS VARCHAR) AS sort_key FROM part""",
    "G7_altitude": """WITH priced AS (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_retailprice * 100 - 95000 END AS price
          FROM part)
        SELECT p_partkey,
          round(CASE WHEN price IS NULL THEN 0.014e0 ELSE greatest(0e0, least(20e0, price / 6371e0)) END, 9) AS altitude,
          round(CASE WHEN price IS NULL THEN 6e0 ELSE greatest(2.5e0, least(20e0, sqrt(abs(price)) * 0.7e0)) END, 9)
            AS ring_radius FROM priced""",
    "G12_labels": """SELECT p_partkey, coalesce(CASE WHEN p_size > 10 THEN p_name END, 'Result') AS label,
        CAST(p_size AS VARCHAR) AS group_label FROM part""",
}
