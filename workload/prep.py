"""Preparation jobs (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions.geo import rounded
from geoloom.functions.geojson import explode_edges, polygon_measures
from geoloom.operators import prep
from workload.base import GEO_CUSTOMER, GEO_EVENT, GEO_NATION_EDGE, geo_customer, geo_event, geo_nation, geo_nation_edge, table


def box(spark, sf_dir):
    return prep.box_subset(geo_event(spark, sf_dir), 15.0, 50.0, -80.0, -20.0, above={"value": 100.0})


def units_row(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    text = events.select(*[F.col(c).cast("string").alias(c) for c in events.columns])
    units = events.agg(*[F.concat(F.lit("unit of "), F.lit(c), F.lit(" "), F.count(F.lit(1))).alias(c) for c in events.columns])
    return prep.drop_units_row(units.unionByName(text), "event_id", events.schema)


def seasons(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("season", F.year("o_orderdate"))
    return prep.main_tracks(orders, 1996, 1998, ["o_orderkey", "season", "o_totalprice"], "o_orderstatus", "F")


def measures(spark, sf_dir):
    edges = explode_edges(geo_nation(spark, sf_dir), "geometry_geojson", ["country_id"])
    found = polygon_measures(edges, "country_id")
    return found.select(
        "country_id", "min_longitude", "max_longitude", "min_latitude", "max_latitude",
        rounded(F.col("center_longitude"), 6).alias("center_longitude"),
        rounded(F.col("center_latitude"), 6).alias("center_latitude"), rounded(F.col("area_km2"), 2).alias("area_km2"))


def strong(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return prep.strong_events(orders, 300000.0, "1996-01-01", "1998-01-01", "o_totalprice", "o_orderdate", "o_orderkey")


def codes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", prep.decode(F.col("p_size") - 2, prep.VALIDITY_WORDS).alias("validity"),
                       prep.decode(F.col("p_size") - 1, prep.CAUSE_WORDS).alias("cause"))


def dated(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_retailprice") - 1500).alias("year"),
        prep.decode(F.col("p_size") - 2, prep.VALIDITY_WORDS).alias("validity"))
    return prep.dated_events(part.withColumn("year", F.floor("year")), accepted=("definite", "probable"))


def segments(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("start_lat"), (-F.col("l_quantity")).alias("start_lon"),
        (F.col("l_discount") * 100).alias("end_lat"), (F.col("l_discount") * 200).alias("end_lon"))
    return prep.segment_points(li, ("start_lat", "start_lon"), ("end_lat", "end_lon"), ["l_orderkey", "l_linenumber"])


def lines(spark, sf_dir):
    """One line per customer, two for those with a negative balance."""
    x, y = F.col("c_custkey") % 180, F.col("c_nationkey")
    one = F.concat(F.lit("[["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("],["), (x + 1).cast("string"),
                   F.lit(","), (y + 2).cast("string"), F.lit("]]"))
    text = F.when(F.col("c_acctbal") < 0, F.concat(
        F.lit('{"type":"MultiLineString","coordinates":['), one, F.lit(","), one, F.lit("]}"))).otherwise(
        F.concat(F.lit('{"type":"LineString","coordinates":'), one, F.lit("}")))
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", text.alias("geometry"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("name"),
        (F.floor("c_acctbal") / 1000).cast("int").alias("scalerank"))
    return prep.river_points(customers, "geometry", "c_custkey")


def notable(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("place_id"), F.col("l_discount").alias("latitude"), F.col("l_tax").alias("longitude"),
        F.col("l_quantity").alias("sitelinks"), F.col("l_returnflag").alias("category"), "l_orderkey", "l_linenumber")
    return prep.notable_places(li, order=("category", "l_orderkey", "l_linenumber"))


BRANDS = ["BUILDING", "MACHINERY"]


def branded(spark, sf_dir):
    placed = prep.branded_places(
        geo_customer(spark, sf_dir), geo_nation_edge(spark, sf_dir), "polygon_id", BRANDS, 1000.0)
    return placed.select("id", "brand", "confidence", "region_id")


QUERIES = {
    "P1_box_subset": box, "P2_units_row": units_row, "P3_main_tracks": seasons, "P4_polygon_measures": measures,
    "P5_strong_events": strong, "P6_codes": codes, "P7_signed_years": dated, "P8_segment_points": segments,
    "P9_line_points": lines, "P10_notable_places": notable, "P11_branded_places": branded,
}


def _words(column: str, words: dict) -> str:
    pairs = " ".join(f"WHEN {k} THEN '{v}'" for k, v in words.items())
    return f"CASE {column} {pairs} END"


SQL = {
    "P1_box_subset": f"""WITH {GEO_EVENT} SELECT * FROM geo_event WHERE latitude >= 15 AND latitude <= 50
        AND longitude >= -80 AND longitude <= -20 AND value > 100""",
    "P2_units_row": "SELECT * FROM events",
    "P3_main_tracks": """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS season, o_totalprice FROM orders
        WHERE o_orderstatus = 'F' AND year(o_orderdate) BETWEEN 1996 AND 1998""",
    "P4_polygon_measures": f"""WITH {GEO_NATION_EDGE}, rad AS (SELECT *, radians(x1) AS a, radians(y1) AS b,
          radians(x2) AS c, radians(y2) AS d FROM geo_nation_edge),
        normal AS (SELECT *, cos(b) * sin(a) * sin(d) - sin(b) * cos(d) * sin(c) AS nx,
          sin(b) * cos(d) * cos(c) - cos(b) * cos(a) * sin(d) AS ny,
          cos(b) * cos(a) * cos(d) * sin(c) - cos(b) * sin(a) * cos(d) * cos(c) AS nz FROM rad),
        weighted AS (SELECT *, CASE WHEN sqrt(nx * nx + ny * ny + nz * nz) > 0
          THEN asin(least(1e0, sqrt(nx * nx + ny * ny + nz * nz))) / sqrt(nx * nx + ny * ny + nz * nz) ELSE 0e0 END AS w
          FROM normal),
        total AS (SELECT polygon_id, min(least(x1, x2)) AS min_longitude, max(greatest(x1, x2)) AS max_longitude,
          min(least(y1, y2)) AS min_latitude, max(greatest(y1, y2)) AS max_latitude, sum(nx * w) AS vx, sum(ny * w) AS vy,
          sum(nz * w) AS vz, sum((c - a) * (2e0 + sin(b) + sin(d))) AS turn FROM weighted GROUP BY polygon_id)
        SELECT polygon_id AS country_id, min_longitude, max_longitude, min_latitude, max_latitude,
          round(degrees(atan2(vy, vx)), 6) AS center_longitude,
          round(degrees(atan2(vz, sqrt(vx * vx + vy * vy))), 6) AS center_latitude,
          round(abs(turn) * (6371e0 * 6371e0 / 2e0), 2) AS area_km2 FROM total""",
    "P5_strong_events": """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_totalprice >= 300000
        AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'""",
    "P6_codes": f"""SELECT p_partkey, {_words("p_size - 2", prep.VALIDITY_WORDS)} AS validity,
        {_words("p_size - 1", prep.CAUSE_WORDS)} AS cause FROM part""",
    "P7_signed_years": f"""WITH coded AS (SELECT p_partkey, CAST(floor(p_retailprice - 1500) AS INT) AS year,
          {_words("p_size - 2", prep.VALIDITY_WORDS)} AS validity FROM part)
        SELECT * FROM coded WHERE validity IN ('definite', 'probable')""",
    "P8_segment_points": """SELECT l_orderkey, l_linenumber, 0 AS point_order, l_quantity AS latitude, -l_quantity AS longitude
          FROM lineitem
        UNION ALL SELECT l_orderkey, l_linenumber, 1, l_discount * 100, l_discount * 200 FROM lineitem
          WHERE NOT (l_discount * 100 = 0 AND l_discount * 200 = 0)""",
    "P9_line_points": """WITH kept AS (SELECT c_custkey, c_name AS name, CAST(trunc(floor(c_acctbal) / 1000) AS INT) AS scalerank,
          CAST(c_custkey % 180 AS DOUBLE) AS x, CAST(c_nationkey AS DOUBLE) AS y, c_acctbal FROM customer
          WHERE c_mktsegment <> 'BUILDING')
        SELECT c_custkey || '_' || line AS segment_id, CAST(point_order AS INT) AS point_order, name, scalerank,
          y + 2 * point_order AS latitude, x + point_order AS longitude
        FROM kept CROSS JOIN (VALUES (0), (1)) AS p(point_order) CROSS JOIN (VALUES (0), (1)) AS l(line)
        WHERE scalerank BETWEEN 0 AND 5 AND (line = 0 OR c_acctbal < 0)""",
    "P10_notable_places": """WITH ranked AS (SELECT l_partkey AS place_id, l_discount AS latitude, l_tax AS longitude,
          l_quantity AS sitelinks, l_returnflag AS category, l_orderkey, l_linenumber, row_number() OVER (
            PARTITION BY l_partkey, l_discount, l_tax ORDER BY l_returnflag, l_orderkey, l_linenumber) AS rk
          FROM lineitem WHERE l_quantity >= 10)
        SELECT * EXCLUDE (rk) FROM ranked WHERE rk = 1""",
    "P11_branded_places": f"""WITH {GEO_CUSTOMER}, {GEO_NATION_EDGE}, kept AS (SELECT * FROM geo_customer
          WHERE confidence >= 1000 AND brand IN ('BUILDING', 'MACHINERY')),
        inside AS (SELECT c.id, e.polygon_id FROM kept AS c JOIN geo_nation_edge AS e
          ON (e.y1 > c.latitude) <> (e.y2 > c.latitude)
          AND c.longitude < (e.x2 - e.x1) * (c.latitude - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1
          GROUP BY c.id, e.polygon_id HAVING count(*) % 2 = 1)
        SELECT k.id, k.brand, k.confidence, min(i.polygon_id) AS region_id
        FROM kept AS k LEFT JOIN inside AS i ON k.id = i.id GROUP BY k.id, k.brand, k.confidence""",
}
