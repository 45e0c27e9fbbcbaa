import json
import math

import pytest
from pyspark.sql import functions as F

from geoloom.functions.color import PALETTE
from geoloom.functions.geojson import explode_edges, explode_lines, explode_vertices, parse_polygons, polygon_measures
from geoloom.functions.roles import infer_roles
from geoloom.operators.extent import extent
from geoloom.operators.layers import (
    MARK_TYPES, Layer, Style, coordinate_report, layer_locations, layer_marks, path_chunks, paths_layer, points_layer,
    polygons_layer, rings_layer, union_layers, valid_points,
)
from tests.conftest import values

SQUARE = {"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]]}
SHAPES = [
    json.dumps(SQUARE),
    json.dumps({"type": "MultiPolygon", "coordinates": [SQUARE["coordinates"], [[[20, 1], [21, 1], [21, 2], [20, 1]]]]}),
    json.dumps({"type": "Feature", "properties": {"a": 1}, "geometry": SQUARE}),
    json.dumps({"type": "Point", "coordinates": [1, 2]}), "not json", None, '{"type":"Polygon"}', "{}",
]


def layer(df, kind, style=Style(), **roles):
    return Layer("demo", kind, {**infer_roles(df.columns), **roles}, style)


def test_valid_points_are_counted(spark):
    rows = [("1.5", "2"), (None, "2"), ("", "2"), ("abc", "2"), ("NaN", "2"), (" 12 ", "3")]
    df = spark.createDataFrame(rows, "latitude string, longitude string")
    assert values(valid_points(df, "latitude", "longitude")) == [rows[0], rows[5]]
    assert values(coordinate_report(df, "latitude", "longitude")) == [(2, 4)]


def test_points_and_rings(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0, 637.1, 100.0), ("b", None, 2.0, 1.0, 1.0), ("c", 3.0, 4.0, None, None)],
        "id string, latitude double, longitude double, altitude_km double, magnitude double")
    points = points_layer(df, layer(df, "points"))
    assert points.columns == list(MARK_TYPES)
    assert values(points, "label", "altitude", "point_radius") == [
        ("a", pytest.approx(0.1), 0.1), ("c", 0.014, 0.1)]
    rings = rings_layer(df, layer(df, "rings", Style(color="#fff", radius=3.5)))
    assert values(rings, "label", "altitude", "point_radius", "ring_radius", "color") == [
        ("a", pytest.approx(0.1), 0.22, 7.0, "#fff"), ("c", 0.018, 0.22, 3.5, "#fff")]
    plain = df.drop("altitude_km", "id")
    marks = points_layer(plain, layer(plain, "points"))
    assert values(marks, "label", "point_radius")[0] == ("Result", 0.28)
    assert marks.select("color").distinct().count() == 1 and values(marks, "color")[0][0] in PALETTE


def path_table(spark):
    rows = [("a", 10, 1.0, 0), ("a", 9, 2.0, 1), ("a", 2, 3.0, 2), (None, 1, 4.0, 3), (None, 0, 5.0, 4), ("b", 1, 6.0, 5),
            ("c", 7, 7.0, 6), ("c", 7, 8.0, 7), ("c", None, 9.0, 8), ("a", 3, math.nan, 9)]
    df = spark.createDataFrame(rows, "track_id string, t int, latitude double, _row_index int")
    return df.withColumn("longitude", F.lit(0.0)).withColumn("name", F.concat(F.lit("row"), "_row_index"))


def test_paths(spark, tiny):
    df = path_table(spark)
    for policy in ({}, {"policy": tiny}):
        marks = paths_layer(df, layer(df, "paths"), **policy)
        got = {}
        for key, pos, lat, label in values(marks.orderBy("path_position"), "path_key", "path_position", "latitude", "label"):
            got.setdefault(key, (label, []))[1].append(lat)
        assert got == {"a": ("row2", [3.0, 2.0, 1.0]), None: ("row4", [5.0, 4.0]), "b": ("row5", [6.0]),
                       "c": ("row6", [7.0, 8.0, 9.0])}
    assert values(marks.select("width", "animate", "altitude").distinct()) == [(0.7, True, 0.018)]


def test_text_order_of_paths_is_natural(spark):
    df = spark.createDataFrame([("g", "s10", 1.0), ("g", "s9", 2.0)], "track_id string, t string, latitude double")
    df = df.withColumn("longitude", F.lit(1.0))
    assert [r[0] for r in values(paths_layer(df, layer(df, "paths")).orderBy("path_position"), "latitude")] == [2.0, 1.0]


def test_path_chunks(spark):
    df = spark.range(25).select(
        F.lit("g").alias("id"), F.col("id").alias("t"), F.col("id").cast("double").alias("latitude"),
        F.lit(0.0).alias("longitude"))
    chunks = path_chunks(paths_layer(df, layer(df, "paths")), 10).orderBy("chunk").collect()
    assert [len(c["points"]) for c in chunks] == [10, 10, 5]
    assert [p["lat"] for c in chunks for p in c["points"]] == [float(i) for i in range(25)]


def test_polygons(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SHAPES)], "id int, geometry string")
    assert sorted(values(polygons_layer(df, layer(df, "polygons")), "label")) == [("0",), ("1",), ("2",)]
    nested = df.select(parse_polygons(F.col("geometry")).alias("p")).where("id = 1").first()["p"]
    assert len(nested) == 2 and nested[1][0][0] == [20.0, 1.0]
    vertices = explode_vertices(df, "geometry", ["id"])
    assert {r[0]: r[1] for r in vertices.groupBy("id").count().collect()} == {0: 5, 1: 9, 2: 5}


def test_measures_of_a_box_and_a_hole(spark):
    hole = {"type": "Polygon", "coordinates": [SQUARE["coordinates"][0], [[2, 2], [2, 4], [4, 4], [4, 2], [2, 2]]]}
    small = {"type": "Polygon", "coordinates": [[[2, 2], [4, 2], [4, 4], [2, 4], [2, 2]]]}
    reversed_box = {"type": "Polygon", "coordinates": [SQUARE["coordinates"][0][::-1]]}
    df = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate([SQUARE, hole, small, reversed_box])], "id int, g string")
    found = {r["id"]: r for r in polygon_measures(explode_edges(df, "g", ["id"]), "id").collect()}
    assert found[0]["area_km2"] == pytest.approx(1_230_163.417, abs=0.01)
    assert found[1]["area_km2"] == pytest.approx(found[0]["area_km2"] - found[2]["area_km2"])
    assert found[3]["area_km2"] == pytest.approx(found[0]["area_km2"])
    for i in (0, 3):
        assert found[i]["center_longitude"] == pytest.approx(5.0) and found[i]["center_latitude"] == pytest.approx(5.0, abs=0.05)
    assert tuple(found[2][1:5]) == (2.0, 4.0, 2.0, 4.0)


def test_lines(spark):
    rows = [("r", '{"type":"LineString","coordinates":[[1,2],[3,4]]}'), ("m", '{"type":"MultiLineString","coordinates":[[[0,0],[1,1]],[[5,6],[7,8]]]}'),
            ("p", '{"type":"Point","coordinates":[1,2]}')]
    df = spark.createDataFrame(rows, "id string, g string")
    got = sorted(values(explode_lines(df, "g", "id", [])))
    assert got == [("m_0", 0, 0.0, 0.0), ("m_0", 1, 1.0, 1.0), ("m_1", 0, 6.0, 5.0), ("m_1", 1, 8.0, 7.0),
                   ("r_0", 0, 2.0, 1.0), ("r_0", 1, 4.0, 3.0)]


def locations(spark, rows):
    return spark.createDataFrame(rows, "latitude double, longitude double, altitude double")


def test_extent(spark):
    single = extent(locations(spark, [(10.0, 20.0, 0.0)])).first()
    assert single["view_altitude"] == pytest.approx(1.25) and single["angular_spread"] == pytest.approx(0, abs=1e-5)
    wrapped = extent(locations(spark, [(0.0, 170.0, 0.0), (0.0, -170.0, 0.0)])).first()
    assert abs(wrapped["center_longitude"]) == pytest.approx(180) and wrapped["angular_spread"] == pytest.approx(10)
    assert wrapped["view_altitude"] == 1.6
    assert extent(locations(spark, [(0.0, 0.0, 15.0), (1.0, 1.0, None)])).first()["view_altitude"] == 16.25
    assert extent(locations(spark, [])).count() == 0
    plan = extent(locations(spark, [(0.0, 0.0, 15.0)]))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_extent_of_longitudes_that_cancel_out(spark):
    """Evenly around the globe there is no mean direction; rounding of the sums is not taken for one, in any order."""
    around = [(0.0, i / 100 - 180, 0.0) for i in range(36_000)]
    for rows in (around, around[::-1], around[1::2] + around[::2]):
        found = extent(locations(spark, rows)).first()
        assert (found["center_longitude"], found["angular_spread"]) == (0.0, 180.0)
    leaning = extent(locations(spark, around + [(0.0, 12.5, 0.0)])).first()
    assert leaning["center_longitude"] == pytest.approx(12.5, abs=1e-6)


def test_union_and_locations(spark):
    df = path_table(spark)
    shapes = spark.createDataFrame([(i, s) for i, s in enumerate(SHAPES)], "id int, geometry string")
    layers = [(shapes, Layer("p", "polygons", infer_roles(shapes.columns), pos=0)),
              (df, Layer("l", "paths", infer_roles(df.columns), pos=1)), (df, Layer("q", "points", infer_roles(df.columns), pos=2))]
    marks = union_layers([layer_marks(d, x) for d, x in layers])
    assert values(marks.groupBy("layer_pos", "mark_type").count().orderBy("layer_pos")) == [
        (0, "polygons", 3), (1, "paths", 9), (2, "points", 9)]
    found = union_layers([layer_locations(d, x) for d, x in layers])
    assert found.count() == 19 + 9 + 9 and found.where("altitude <> 0").count() == 0
