"""The named reports over relations derived from the test tables (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions.geo import rounded
from geoloom.functions.geojson import explode_edges, polygon_measures
from geoloom.functions.roles import infer_roles
from geoloom.operators.layers import Layer, points_layer
from geoloom.plans import reports
from workload.base import (
    GEO_CUSTOMER, GEO_EVENT, GEO_NATION, GEO_SUPPLIER, geo_customer, geo_event, geo_nation, geo_supplier, table,
)

NATIONS = ["NATION_2", "NATION_3", "NATION_6", "NATION_7", "NATION_18", "NATION_23"]
KINDS = ["click", "purchase", "view"]


def drifters(spark, sf_dir):
    return geo_event(spark, sf_dir).select(
        F.col("track_id").cast("string").alias("id"), "latitude", "longitude", F.col("value").alias("persist"),
        (F.col("value") * 37 + 5).alias("radius"), F.when(F.col("kind") == "click", 1).otherwise(0).alias("drogue"))


def storms(spark, sf_dir):
    return geo_event(spark, sf_dir).select(
        F.col("track_id").alias("sid"), F.year("observed_at").alias("season"),
        F.when(F.col("kind") == "view", "UNNAMED").otherwise(F.col("kind")).alias("name"),
        F.col("observed_at").alias("iso_time"), "latitude", "longitude", F.col("value").alias("wind_kts"),
        (F.col("value") + 900).alias("pressure_mb"))


def earthquakes(spark, sf_dir):
    spread = ((F.col("o_orderkey") * 7919) % 17001).cast("double") / 100.0
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("observed_at"),
        F.col("o_orderpriority").alias("place"), (spread - 85.0).alias("latitude"), spread.alias("longitude"),
        F.col("o_totalprice").alias("magnitude"), (F.col("o_totalprice") / 10000).alias("depth_km"),
        (F.col("o_orderstatus") == "F").alias("tsunami_flag"))


def rivers(spark, sf_dir):
    return geo_event(spark, sf_dir).select(
        F.col("track_id").alias("segment_id"), F.col("observed_at").alias("point_order"), F.col("kind").alias("name"),
        "latitude", "longitude", F.floor(F.col("value") / 50).cast("int").alias("scalerank"))


def landmarks(spark, sf_dir):
    """Customers of one segment as parks, parts as heritage places."""
    parks = geo_customer(spark, sf_dir).select(
        F.col("id").alias("place_id"), "name", F.col("country").cast("string").alias("country"),
        F.when(F.col("brand") == "BUILDING", "theme park").otherwise("other").alias("category"), "latitude", "longitude",
        F.floor(F.col("confidence")).cast("bigint").alias("sitelinks"))
    spread = ((F.col("p_partkey") * 7919) % 17001).cast("double") / 100.0
    heritage = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("place_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("country"),
        F.lit("UNESCO heritage landmark").alias("category"), (spread - 85.0).alias("latitude"), spread.alias("longitude"),
        F.floor(F.col("p_retailprice") * 100).cast("bigint").alias("sitelinks"))
    return parks.unionByName(heritage)


def chains(spark, sf_dir):
    customers = geo_customer(spark, sf_dir).select(
        F.col("id").alias("place_id"), "brand", "country", "confidence", "latitude", "longitude")
    suppliers = geo_supplier(spark, sf_dir).select(
        "place_id", F.lit("IKEA").alias("brand"), "country", "confidence", "latitude", "longitude")
    return customers.unionByName(suppliers)


def tsunamis(spark, sf_dir):
    spread = ((F.col("l_orderkey") * 7919) % 17001).cast("double") / 100.0
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tsunami_id"), F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"), F.dayofmonth("l_shipdate").alias("day"),
        F.col("l_linestatus").alias("location_name"), F.col("l_returnflag").alias("country"),
        (spread - 85.0).alias("latitude"), spread.alias("longitude"), F.col("l_quantity").alias("maximum_water_height_m"),
        F.when(F.col("l_returnflag") == "R", "definite").otherwise("probable").alias("validity"),
        F.lit("earthquake").alias("cause"))


def boundaries(spark, sf_dir):
    nations = geo_nation(spark, sf_dir)
    measured = polygon_measures(explode_edges(nations, "geometry_geojson", ["country_id"]), "country_id")
    return nations.join(measured, "country_id")


def countries(spark, sf_dir):
    found = reports.countries({"country_boundaries": boundaries(spark, sf_dir)}, NATIONS)
    return found.select("country_id", "name", rounded(F.col("area_km2"), 2).alias("area_km2"), "geometry_geojson")


def loops_near_storms(spark, sf_dir):
    ev = geo_event(spark, sf_dir)
    loops = ev.where(F.col("kind") == "error").select("id", "observed_at", "latitude", "longitude")
    tracks = ev.where(F.col("kind") == "purchase").select(
        F.col("id").alias("sid"), F.col("track_id").alias("name"), F.col("observed_at").alias("iso_time"), "latitude",
        "longitude")
    return reports.loops_near_storms({"drifter_loopers": loops, "atlantic_storms": tracks})


def flagship(spark, sf_dir):
    """The most confident customers of a brand in each nation, as point marks."""
    sample = reports.brand_sample({"global_chains": chains(spark, sf_dir)}, "BUILDING")
    marks = points_layer(sample, Layer("customers", "points", infer_roles(sample.columns)))
    return marks.select("label", "latitude", "longitude", "altitude", "color", "point_radius", "opacity")


QUERIES = {
    "E1_persistent_loops": lambda s, d: reports.persistent_loops({"drifter_loopers": drifters(s, d)}),
    "E2_recent_storms": lambda s, d: reports.recent_storms({"atlantic_storms": storms(s, d)}, 2023),
    "E3_loops_near_storms": loops_near_storms,
    "E4_countries": countries,
    "E5_strong_earthquakes": lambda s, d: reports.strong_earthquakes({"earthquakes": earthquakes(s, d)}, 400000.0),
    "E6_ranked_rivers": lambda s, d: reports.ranked_rivers({"major_rivers": rivers(s, d)}),
    "E7_theme_parks": lambda s, d: reports.theme_parks({"theme_parks_landmarks": landmarks(s, d)}),
    "E8_heritage_landmarks": lambda s, d: reports.heritage_landmarks({"theme_parks_landmarks": landmarks(s, d)}),
    "E9_brand_sample": lambda s, d: reports.brand_sample({"global_chains": chains(s, d)}, "BUILDING"),
    "E9_second_brand_sample": lambda s, d: reports.brand_sample({"global_chains": chains(s, d)}, "MACHINERY"),
    "E9_brand_marks": flagship,
    "E10_brand_places": lambda s, d: reports.brand_places({"global_chains": chains(s, d)}),
    "E11_largest_earthquakes": lambda s, d: reports.strong_earthquakes({"earthquakes": earthquakes(s, d)}, 450000.0),
    "E12_named_rivers": lambda s, d: reports.named_rivers({"major_rivers": rivers(s, d)}, KINDS),
    "E13_large_tsunamis": lambda s, d: reports.large_tsunamis({"tsunami_events": tsunamis(s, d)}),
    "E14_season_storms": lambda s, d: reports.season_storms({"atlantic_storms": storms(s, d)}, 2024),
}

_STORMS = """storms AS (SELECT track_id AS sid, CAST(year(observed_at) AS INT) AS season,
    CASE WHEN kind = 'view' THEN 'UNNAMED' ELSE kind END AS name, observed_at AS iso_time, latitude, longitude,
    value AS wind_kts, value + 900 AS pressure_mb FROM geo_event)"""
_QUAKES = """SELECT o_orderkey AS event_id, o_orderdate AS observed_at, o_orderpriority AS name,
    CAST((o_orderkey * 7919) % 17001 AS DOUBLE) / 1e2 - 8.5e1 AS latitude,
    CAST((o_orderkey * 7919) % 17001 AS DOUBLE) / 1e2 AS longitude, o_totalprice AS magnitude,
    o_totalprice / 10000 AS depth_km, o_orderstatus = 'F' AS tsunami_flag FROM orders WHERE o_totalprice >= {}"""
_SAMPLE = """WITH {geo}, ranked AS (SELECT id AS place_id, brand, country, confidence, latitude, longitude,
    row_number() OVER (PARTITION BY country ORDER BY confidence DESC NULLS LAST, id) AS rk FROM geo_customer
    WHERE brand = '{brand}' AND country IS NOT NULL)
  SELECT * EXCLUDE (rk) FROM ranked WHERE rk <= 5"""
_HASH = """list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, length({t}) + 1),
  lambda i: CAST(unicode(substr({t}, i, 1)) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296)"""

SQL = {
    "E1_persistent_loops": f"""WITH {GEO_EVENT} SELECT CAST(track_id AS VARCHAR) AS id, round(avg(latitude), 3) AS latitude,
        round(avg(longitude), 3) AS longitude, round(max(value), 1) AS persistence_days,
        round(median(value * 37 + 5) / 1000, 1) AS radius_km, count(*) AS observations
        FROM geo_event WHERE kind = 'click' GROUP BY track_id ORDER BY persistence_days DESC NULLS LAST, id LIMIT 24""",
    "E2_recent_storms": f"""WITH {GEO_EVENT}, {_STORMS} SELECT * EXCLUDE (season) FROM storms
        WHERE season >= 2023 AND name <> 'UNNAMED'""",
    "E3_loops_near_storms": f"""WITH {GEO_EVENT}, pairs AS (
          SELECT l.id, s.track_id AS storm, l.observed_at, l.latitude, l.longitude, round(111.2e0 * sqrt(
            pow(l.latitude - s.latitude, 2) + pow((l.longitude - s.longitude) * cos(radians(l.latitude)), 2)), 1)
            AS distance_km, s.id AS sid, s.observed_at AS met
          FROM geo_event AS l JOIN geo_event AS s ON l.kind = 'error' AND s.kind = 'purchase'
            AND abs(date_diff('day', l.observed_at, s.observed_at)) <= 1
            AND abs(l.latitude - s.latitude) < 5 AND abs(l.longitude - s.longitude) < 7)
        SELECT id, storm, observed_at, latitude, longitude, distance_km FROM pairs WHERE distance_km <= 500
        ORDER BY distance_km, id, observed_at, sid, met LIMIT 200""",
    "E4_countries": f"""WITH {GEO_NATION} SELECT country_id, name,
        round(6371e0 * 6371e0 / 2e0 * abs(
          radians(30e0) * (2e0 + 2e0 * sin(radians(y))) + radians(-20e0) * (2e0 + 2e0 * sin(radians(y + 10)))
          + radians(-10e0) * (2e0 + 2e0 * sin(radians(y + 25)))), 2) AS area_km2, geometry_geojson
        FROM (SELECT *, CAST(floor(country_id / 5e0) AS INT) * 34 - 85 AS y FROM geo_nation) AS n
        WHERE name IN ({", ".join(f"'{n}'" for n in NATIONS)})""",
    "E5_strong_earthquakes": _QUAKES.format(400000),
    "E6_ranked_rivers": f"""WITH {GEO_EVENT} SELECT track_id AS segment_id, observed_at AS point_order, kind AS name,
        latitude, longitude, CAST(floor(value / 50) AS INT) AS scalerank FROM geo_event WHERE floor(value / 50) <= 2""",
    "E7_theme_parks": f"""WITH {GEO_CUSTOMER} SELECT id AS place_id, name, CAST(country AS VARCHAR) AS country, latitude,
        longitude, CAST(floor(confidence) AS BIGINT) AS sitelinks FROM geo_customer WHERE brand = 'BUILDING'""",
    "E8_heritage_landmarks": """SELECT p_partkey AS place_id, p_name AS name, p_brand AS country,
        CAST((p_partkey * 7919) % 17001 AS DOUBLE) / 1e2 - 8.5e1 AS latitude,
        CAST((p_partkey * 7919) % 17001 AS DOUBLE) / 1e2 AS longitude,
        CAST(floor(p_retailprice * 100) AS BIGINT) AS sitelinks FROM part
        ORDER BY sitelinks DESC NULLS LAST, name, place_id LIMIT 260""",
    "E9_brand_sample": _SAMPLE.format(geo=GEO_CUSTOMER, brand="BUILDING"),
    "E9_second_brand_sample": _SAMPLE.format(geo=GEO_CUSTOMER, brand="MACHINERY"),
    "E9_brand_marks": f"""WITH sample AS ({_SAMPLE.format(geo=GEO_CUSTOMER, brand="BUILDING")}),
        hashed AS (SELECT *, {_HASH.format(t="CAST(place_id AS VARCHAR)")} AS h FROM sample)
        SELECT brand AS label, latitude, longitude, 0.014e0 AS altitude,
          ['#62cce1', '#a9cc63', '#ee8869', '#b394e8', '#63d2aa', '#ee7287'][abs(CASE WHEN h >= 2147483648
            THEN h - 4294967296 ELSE h END) % 6 + 1] AS color, 0.28e0 AS point_radius, 0.92e0 AS opacity FROM hashed""",
    "E10_brand_places": f"""WITH {GEO_SUPPLIER} SELECT place_id, 'IKEA' AS brand, country, confidence, latitude, longitude
        FROM geo_supplier""",
    "E11_largest_earthquakes": _QUAKES.format(450000),
    "E12_named_rivers": f"""WITH {GEO_EVENT}, ranked AS (SELECT track_id AS segment_id, observed_at AS point_order,
          kind AS name, latitude, longitude, CAST(floor(value / 50) AS INT) AS scalerank,
          row_number() OVER (PARTITION BY track_id ORDER BY observed_at) AS rk, count(*) OVER (PARTITION BY track_id) AS n
          FROM geo_event WHERE kind IN ('click', 'purchase', 'view'))
        SELECT * EXCLUDE (rk, n) FROM ranked WHERE rk = 1 OR rk = n OR rk % 5 = 0""",
    "E13_large_tsunamis": """SELECT l_orderkey * 10 + l_linenumber AS tsunami_id, CAST(year(l_shipdate) AS INT) AS year,
        CAST(month(l_shipdate) AS INT) AS month, CAST(day(l_shipdate) AS INT) AS day, l_linestatus AS name,
        l_returnflag AS country, CAST((l_orderkey * 7919) % 17001 AS DOUBLE) / 1e2 - 8.5e1 AS latitude,
        CAST((l_orderkey * 7919) % 17001 AS DOUBLE) / 1e2 AS longitude, l_quantity AS maximum_water_height_m,
        'earthquake' AS cause FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 5""",
    "E14_season_storms": f"""WITH {GEO_EVENT}, {_STORMS} SELECT * EXCLUDE (season) FROM storms
        WHERE season = 2024 AND name <> 'UNNAMED'""",
}
