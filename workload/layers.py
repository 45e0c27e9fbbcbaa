"""Geographic layers (G, L5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions.geo import rounded
from geoloom.functions.geojson import explode_vertices
from geoloom.functions.roles import infer_roles
from geoloom.operators.layers import (
    Layer, Style, path_chunks, paths_layer, points_layer, polygons_layer, rings_layer, union_layers, valid_points,
)
from workload.base import (
    GEO_CUSTOMER, GEO_EVENT, GEO_NATION, GEO_NATION_EDGE, geo_customer, geo_event, geo_nation, table,
)


def _layer(df, kind, layer_id="layer", style=Style(), **roles):
    return Layer(layer_id, kind, {**infer_roles(df.columns), **roles}, style)


def valid_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("latitude"),
        F.when(F.col("l_returnflag") == "A", F.lit("NaN")).when(F.col("l_returnflag") == "N", F.lit(" 12.5 "))
        .otherwise(F.lit("Infinity")).alias("longitude"))
    return valid_points(li, "latitude", "longitude")


def points(spark, sf_dir):
    df = geo_customer(spark, sf_dir).withColumn("altitude_km", F.col("confidence"))
    marks = points_layer(df, _layer(df, "points", "customers"))
    return marks.select("latitude", "longitude", rounded(F.col("altitude"), 9).alias("altitude"), "label", "color",
                        "point_radius", "opacity")


def rings(spark, sf_dir):
    df = geo_event(spark, sf_dir)
    marks = rings_layer(df, _layer(df, "rings", "events", Style(color="#ee7287", radius=3.5), group=None, label="id"))
    return marks.select("label", "latitude", "longitude", "altitude", "color", "point_radius",
                        rounded(F.col("ring_radius"), 9).alias("ring_radius"))


def paths(spark, sf_dir):
    df = geo_event(spark, sf_dir)
    marks = paths_layer(df, _layer(df, "paths", "tracks", group="track_id", label="kind"))
    return marks.select("path_key", "path_position", "latitude", "longitude", "altitude", "label", "width",
                        "animate")


def chunked_paths(spark, sf_dir):
    df = geo_event(spark, sf_dir)
    chunks = path_chunks(paths_layer(df, _layer(df, "paths", "tracks", group="track_id")), 32)
    return chunks.select(
        "path_key", "chunk", F.size("points").cast("bigint").alias("points"),
        F.element_at("points", 1)["lat"].alias("first_latitude"),
        F.element_at("points", -1)["lon"].alias("last_longitude"))


def polygons(spark, sf_dir):
    """Plain, wrapped, other and broken geometry text."""
    text = F.col("geometry_geojson")
    df = geo_nation(spark, sf_dir).withColumn("geometry_geojson", F.when(
        F.col("country_id") < 8, text).when(F.col("country_id") < 16, F.concat(
            F.lit('{"type":"Feature","properties":{},"geometry":'), text, F.lit("}"))).when(
        F.col("country_id") < 20, F.lit('{"type":"Point","coordinates":[1,2]}')).otherwise(F.substring(text, 1, 30)))
    marks = polygons_layer(df, _layer(df, "polygons", "nations"))
    return marks.select("label", "geometry")


def vertices(spark, sf_dir):
    return explode_vertices(geo_nation(spark, sf_dir), "geometry_geojson", ["country_id"]).select(
        "country_id", "vertex_index", "longitude", "latitude")


def scene_union(spark, sf_dir):
    ev, cu = geo_event(spark, sf_dir), geo_customer(spark, sf_dir)
    marks = union_layers([
        points_layer(cu, Layer("customers", "points", infer_roles(cu.columns), pos=0)),
        rings_layer(ev, Layer("events", "rings", infer_roles(ev.columns), pos=1)),
    ])
    return marks.groupBy("layer_pos", "layer_id", "color").agg(
        F.count(F.lit(1)).alias("marks"), F.max("latitude").alias("north"))


QUERIES = {
    "G1_valid_points": valid_rows, "G2_points_layer": points, "G3_rings_layer": rings, "G4_paths_layer": paths,
    "G4_path_chunks": chunked_paths, "G5_polygons_layer": polygons, "G6_vertices": vertices, "L5_scene_union": scene_union,
}

_COLOR = """['#62cce1', '#a9cc63', '#ee8869', '#b394e8', '#63d2aa', '#ee7287'][abs(CASE WHEN h >= 2147483648
  THEN h - 4294967296 ELSE h END) % 6 + 1]"""
_HASH = """list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, length({t}) + 1),
  lambda i: CAST(unicode(substr({t}, i, 1)) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296)"""
_ID_HASH = _HASH.format(t="CAST(id AS VARCHAR)")

SQL = {
    "G1_valid_points": """SELECT l_orderkey, l_linenumber, l_quantity AS latitude, ' 12.5 ' AS longitude FROM lineitem
        WHERE l_linenumber <> 3 AND l_returnflag = 'N'""",
    "G2_points_layer": f"""WITH {GEO_CUSTOMER}, hashed AS (SELECT *, {_ID_HASH} AS h FROM geo_customer)
        SELECT latitude, longitude, round(greatest(0e0, least(20e0, confidence / 6371e0)), 9) AS altitude, name AS label,
          {_COLOR} AS color, 0.1e0 AS point_radius, 0.92e0 AS opacity FROM hashed""",
    "G3_rings_layer": f"""WITH {GEO_EVENT} SELECT CAST(id AS VARCHAR) AS label, latitude, longitude, 0.018e0 AS altitude,
        '#ee7287' AS color, 0.22e0 AS point_radius,
        round(greatest(2.5e0, least(20e0, sqrt(abs(value)) * 0.7e0)), 9) AS ring_radius FROM geo_event""",
    "G4_paths_layer": f"""WITH {GEO_EVENT} SELECT CAST(track_id AS VARCHAR) AS path_key,
        row_number() OVER (PARTITION BY track_id ORDER BY observed_at) AS path_position,
        latitude, longitude, 0.018e0 AS altitude,
        first_value(kind) OVER (PARTITION BY track_id ORDER BY observed_at) AS label, 0.7e0 AS width, true AS animate
        FROM geo_event""",
    "G4_path_chunks": f"""WITH {GEO_EVENT}, placed AS (SELECT *,
          row_number() OVER (PARTITION BY track_id ORDER BY observed_at) - 1 AS i FROM geo_event)
        SELECT CAST(track_id AS VARCHAR) AS path_key, CAST(floor(i / 32) AS BIGINT) AS chunk, count(*) AS points,
          arg_min(latitude, i) AS first_latitude, arg_max(longitude, i) AS last_longitude
        FROM placed GROUP BY 1, 2""",
    "G5_polygons_layer": f"""WITH {GEO_NATION} SELECT name AS label, CASE WHEN country_id < 8 THEN geometry_geojson
        ELSE '{{"type":"Feature","properties":{{}},"geometry":' || geometry_geojson || '}}' END AS geometry
        FROM geo_nation WHERE country_id < 16""",
    "G6_vertices": f"""WITH {GEO_NATION_EDGE} SELECT polygon_id AS country_id, k AS vertex_index, x1 AS longitude,
        y1 AS latitude FROM geo_nation_edge
        UNION ALL SELECT polygon_id, 6, x1, y1 FROM geo_nation_edge WHERE k = 0""",
    "L5_scene_union": f"""WITH {GEO_CUSTOMER}, {GEO_EVENT}, marks AS (
          SELECT 0 AS layer_pos, 'customers' AS layer_id, {_ID_HASH} AS h, latitude FROM geo_customer
          UNION ALL SELECT 1, 'events', {_ID_HASH}, latitude FROM geo_event)
        SELECT layer_pos, layer_id, {_COLOR} AS color, count(*) AS marks, max(latitude) AS north FROM marks GROUP BY 1, 2, 3""",
}
