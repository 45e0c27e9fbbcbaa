"""Aggregations, extent and coverage (A, G11, V1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from geoloom.functions.geo import rounded
from geoloom.operators.extent import extent
from geoloom.operators.layers import coordinate_report
from geoloom.operators.ordering import exact_median
from geoloom.operators.quality import broken_layers, check_rules, list_differences, missing_metadata, table_metrics
from geoloom.operators.sketches import COUNT_ERROR, RANK_ERROR, merge_sketches, read_sketches, sketch
from geoloom.session import store
from geoloom.sources.manifest import latest_retrieval
from workload.base import GEO_CUSTOMER, GEO_EVENT, geo_customer, geo_event, table


def grouped(spark, sf_dir):
    ev = geo_event(spark, sf_dir)
    summary = ev.groupBy("track_id").agg(
        F.avg("value").alias("mean"), F.max("value").alias("largest"), F.count(F.lit(1)).alias("observations"))
    return summary.join(exact_median(ev, "track_id", "value", "middle"), "track_id").select(
        "track_id", rounded(F.col("mean"), 6).alias("mean"), "largest", rounded(F.col("middle"), 6).alias("middle"),
        "observations")


def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(
        F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderstatus").alias("statuses"))


def sketched(spark, sf_dir):
    """Medians and distinct orders per flag from sketches that are built per line number, stored and merged, against the
    exact ranks and counts."""
    lines = table(spark, sf_dir, "lineitem")
    fine = store(sketch(lines, ["l_returnflag", "l_linenumber"], "l_extendedprice", "l_orderkey"), "sketches")
    read = read_sketches(merge_sketches(fine, ["l_returnflag"]))
    # One row per flag.
    return lines.join(F.broadcast(read), "l_returnflag").groupBy("l_returnflag", "n").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("l_orderkey").alias("orders"),
        F.avg((F.col("l_extendedprice") <= F.col("estimate")).cast("double")).alias("rank"),
        F.max("distinct_estimate").alias("distinct")).select(
        "l_returnflag", "n", "lines", "orders", (F.abs(F.col("rank") - 0.5) <= 2 * RANK_ERROR).alias("median_within"),
        (F.abs(F.col("distinct") / F.col("orders") - 1) <= COUNT_ERROR).alias("distinct_within"))


def combined_row(spark, sf_dir):
    """One row from several tables by scalar subqueries."""
    orders = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("v"))
    first = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").alias("v"))
    customers = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("v"))
    one = table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("lines"))
    return one.select("lines", orders.scalar().alias("orders"), first.scalar().alias("first_order"),
                      customers.scalar().alias("customers"))


def circular_mean(spark, sf_dir):
    fit = extent(geo_customer(spark, sf_dir).withColumn("altitude", F.lit(0.0)))
    return fit.select(rounded(F.col("center_latitude"), 6).alias("center_latitude"),
                      rounded(F.col("center_longitude"), 4).alias("center_longitude"),
                      rounded(F.col("angular_spread"), 4).alias("angular_spread"))


def view_extent(spark, sf_dir):
    ev = geo_event(spark, sf_dir).withColumn("altitude", F.col("value") / 6371)
    fit = extent(ev)
    return fit.select(
        rounded(F.col("center_latitude"), 6).alias("center_latitude"),
        rounded(F.col("center_longitude"), 6).alias("center_longitude"), "locations",
        rounded(F.col("angular_spread"), 6).alias("angular_spread"),
        rounded(F.col("view_altitude"), 6).alias("view_altitude"))


def latest_date(spark, sf_dir):
    """Orders as a catalog whose entries were retrieved on the order's date."""
    manifest = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("retrieved"))
    return latest_retrieval(manifest).withColumnRenamed("snapshot_date", "latest")


RULES = [("customers", ">=", 100), ("nations", "=", 25), ("order_statuses", "=", 3), ("first_order_year", "=", 1995),
         ("brands", ">=", 10), ("tracks", ">=", 1000000), ("lines", ">=", 1000)]


def coverage(spark, sf_dir):
    rows = F.count(F.lit(1))
    parts = [
        table_metrics(table(spark, sf_dir, "customer"), {"customers": rows}),
        table_metrics(table(spark, sf_dir, "nation"), {"nations": F.count_distinct("n_name")}),
        table_metrics(table(spark, sf_dir, "orders"), {
            "order_statuses": F.count_distinct("o_orderstatus"), "first_order_year": F.min(F.year("o_orderdate"))}),
        table_metrics(table(spark, sf_dir, "part"), {"brands": F.count_distinct("p_brand")}),
        table_metrics(table(spark, sf_dir, "events"), {"tracks": F.count_distinct("user_id")}),
        table_metrics(table(spark, sf_dir, "lineitem"), {"lines": rows}),
    ]
    return check_rules(reduce(DataFrame.unionByName, parts), RULES)


def valid_coordinates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("latitude"),
        F.when(F.col("l_returnflag") == "A", F.lit("")).when(F.col("l_returnflag") == "N", F.lit(" 12.5 "))
        .otherwise(F.lit("n/a")).alias("longitude"))
    return coordinate_report(li, "latitude", "longitude")


def broken_layers_of_parts(spark, sf_dir):
    """Lines as layer mappings to the columns of parts that exist or do not."""
    layers = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("l"), "l_orderkey").alias("layer_id"), F.concat(F.lit("r"), "l_partkey").alias("result_id"),
        F.col("l_returnflag").alias("role"), F.col("l_linenumber").cast("string").alias("column_name"))
    columns = table(spark, sf_dir, "part").where("p_size > 10").select(
        F.concat(F.lit("r"), "p_partkey").alias("result_id"), F.explode(F.array(*[F.lit(str(i)) for i in range(1, 5)])).alias("column_name"))
    return broken_layers(layers, columns)


def blank_metadata(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("relation"), F.when(F.col("n_chars") > 500, F.col("text")).alias("description"),
        F.when(F.col("lang") != "en", F.col("lang")).otherwise("").alias("license"), F.col("source").alias("sourceUrl"))
    return missing_metadata(documents, ["description", "license", "sourceUrl"]).select(
        "relation", F.array_join("missing", ",").alias("missing"))


def ordered_lists(spark, sf_dir):
    actual = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("position"), F.col("o_orderstatus").alias("name"))
    expected = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("position")).agg(F.max("l_linestatus").alias("name"))
    return list_differences(actual, expected, "name")


QUERIES = {
    "J4_broken_layers": broken_layers_of_parts, "V3_missing_metadata": blank_metadata, "V3_list_differences": ordered_lists,
    "A1_grouped": grouped, "A1_sketches": sketched, "A2_distinct_counts": distinct_counts, "A3_combined_row": combined_row,
    "A5_circular_mean": circular_mean, "A6_latest_date": latest_date, "G11_extent": view_extent,
    "V1_coverage": coverage, "G1_coordinate_report": valid_coordinates,
}


def _extent_sql(view: str, name: str, altitude: str) -> str:
    return f"""WITH {view}, centre AS (
          SELECT avg(latitude) AS lat, degrees(atan2(sum(sin(radians(longitude))), sum(cos(radians(longitude))))) AS lon
          FROM {name}),
        spread AS (SELECT lat, lon, count(*) AS n, max({altitude}) AS alt, max(degrees(acos(greatest(-1e0, least(1e0,
          sin(radians(lat)) * sin(radians(latitude)) + cos(radians(lat)) * cos(radians(latitude))
          * cos(radians(longitude) - radians(lon))))))) AS deg FROM {name}, centre GROUP BY lat, lon)"""


SQL = {
    "J4_broken_layers": """WITH layers AS (SELECT 'l' || l_orderkey AS layer_id, 'r' || l_partkey AS result_id, l_returnflag AS role,
          CAST(l_linenumber AS VARCHAR) AS column_name, p_partkey, coalesce(p_size > 10, false) AS known
          FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
        SELECT DISTINCT layer_id, result_id, CAST(NULL AS VARCHAR) AS role, CAST(NULL AS VARCHAR) AS column_name,
          'missing result' AS problem FROM layers WHERE NOT known
        UNION ALL SELECT layer_id, result_id, role, column_name, 'missing column' FROM layers
          WHERE known AND column_name NOT IN ('1', '2', '3', '4')""",
    "V3_missing_metadata": """WITH blanks AS (SELECT doc_id AS relation, concat_ws(',',
          CASE WHEN n_chars > 500 AND text <> '' THEN NULL ELSE 'description' END,
          CASE WHEN lang <> 'en' AND lang <> '' THEN NULL ELSE 'license' END,
          CASE WHEN coalesce(source, '') = '' THEN 'sourceUrl' END) AS missing FROM documents)
        SELECT * FROM blanks WHERE missing <> ''""",
    "V3_list_differences": """WITH expected AS (SELECT l_orderkey AS position, max(l_linestatus) AS expected FROM lineitem GROUP BY 1)
        SELECT coalesce(o.o_orderkey, e.position) AS position, o.o_orderstatus AS actual, e.expected
        FROM orders AS o FULL JOIN expected AS e ON o.o_orderkey = e.position
        WHERE o.o_orderstatus IS DISTINCT FROM e.expected""",
    "A1_grouped": f"""WITH {GEO_EVENT} SELECT track_id, round(avg(value), 6) AS mean, max(value) AS largest,
        round(median(value), 6) AS middle, count(*) AS observations FROM geo_event GROUP BY track_id""",
    "A1_sketches": """SELECT l_returnflag, count(*) AS n, count(*) AS lines, count(DISTINCT l_orderkey) AS orders,
        true AS median_within, true AS distinct_within FROM lineitem GROUP BY l_returnflag""",
    "A2_distinct_counts": """SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS statuses
        FROM orders""",
    "A3_combined_row": """SELECT (SELECT count(*) FROM lineitem) AS lines, (SELECT count(*) FROM orders) AS orders,
        (SELECT min(o_orderdate) FROM orders) AS first_order, (SELECT count(*) FROM customer) AS customers""",
    "A5_circular_mean": _extent_sql(GEO_CUSTOMER, "geo_customer", "0e0") + """
        SELECT round(lat, 6) AS center_latitude, round(lon, 4) AS center_longitude, round(deg, 4) AS angular_spread
        FROM spread""",
    "A6_latest_date": "SELECT strftime(max(o_orderdate), '%Y-%m-%d') AS latest FROM orders",
    "G11_extent": _extent_sql(GEO_EVENT, "geo_event", "value / 6371e0") + """
        SELECT round(lat, 6) AS center_latitude, round(lon, 6) AS center_longitude, n AS locations,
          round(deg, 6) AS angular_spread, round(least(22e0, greatest(CASE WHEN n = 1 THEN 0.8e0 ELSE
            greatest(1.6e0, least(3e0, 0.72e0 + deg / 65e0)) END, alt + 1.25e0)), 6) AS view_altitude FROM spread""",
    "V1_coverage": "WITH metrics AS (" + """
          SELECT 'customers' AS metric, count(*) AS value FROM customer
          UNION ALL SELECT 'nations', count(DISTINCT n_name) FROM nation
          UNION ALL SELECT 'order_statuses', count(DISTINCT o_orderstatus) FROM orders
          UNION ALL SELECT 'first_order_year', min(year(o_orderdate)) FROM orders
          UNION ALL SELECT 'brands', count(DISTINCT p_brand) FROM part
          UNION ALL SELECT 'tracks', count(DISTINCT user_id) FROM events
          UNION ALL SELECT 'lines', count(*) FROM lineitem), rules AS (SELECT * FROM (VALUES """
    + ", ".join(f"('{m}', '{op}', CAST({v} AS BIGINT))" for m, op, v in RULES) + """) AS r(metric, op, expected))
        SELECT metric, op, expected, value, CASE op WHEN '=' THEN value = expected ELSE value >= expected END AS passed
        FROM rules LEFT JOIN metrics USING (metric)""",
    "G1_coordinate_report": """SELECT count(*) FILTER (WHERE l_linenumber <> 3 AND l_returnflag = 'N') AS valid_rows,
        count(*) FILTER (WHERE NOT (l_linenumber <> 3 AND l_returnflag = 'N')) AS dropped_rows FROM lineitem""",
}
