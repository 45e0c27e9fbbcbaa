"""GeoJSON text to nested doubles, vertices, edges and polygon measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geoloom.functions.geo import EARTH_RADIUS_KM, quoted

HEAD = "type string, coordinates string, geometry struct<type: string, coordinates: string>"
LINE = "array<array<double>>"
POLYGON = "array<array<array<double>>>"
MULTI = "array<array<array<array<double>>>>"


def _geometry(text: Column) -> Column:
    """struct(type, coordinates text) of a geometry or of the geometry inside a Feature."""
    head = F.from_json(text, HEAD)
    feature = head["type"] == "Feature"
    return F.struct(
        F.when(feature, head["geometry"]["type"]).otherwise(head["type"]).alias("type"),
        F.when(feature, head["geometry"]["coordinates"]).otherwise(head["coordinates"]).alias("coordinates"),
    )


def parse_polygons(text: Column) -> Column:
    """Polygon and MultiPolygon text as polygon -> ring -> vertex -> (lon, lat); null for anything else."""
    geometry = _geometry(text)
    kind, body = geometry["type"], geometry["coordinates"]
    single = F.from_json(body, POLYGON)
    return F.when(
        (kind == "Polygon") & single.isNotNull(), F.array(single)
    ).when(kind == "MultiPolygon", F.from_json(body, MULTI))


def parse_lines(text: Column) -> Column:
    """LineString and MultiLineString text as line -> vertex -> (lon, lat); null for anything else."""
    geometry = _geometry(text)
    kind, body = geometry["type"], geometry["coordinates"]
    single = F.from_json(body, LINE)
    return F.when(
        (kind == "LineString") & single.isNotNull(), F.array(single)
    ).when(kind == "MultiLineString", F.from_json(body, POLYGON))


def explode_vertices(df: DataFrame, geometry: str, keep: list[str]) -> DataFrame:
    """One row per vertex of every ring, in order, the closing vertex included.

    Adds polygon_index, ring_index, vertex_index (from 0), longitude and latitude.
    """
    kept = [quoted(c) for c in keep]
    return (
        df.select(*kept, F.posexplode(parse_polygons(quoted(geometry))).alias("polygon_index", "rings"))
        .select(*kept, "polygon_index", F.posexplode("rings").alias("ring_index", "ring"))
        .select(*kept, "polygon_index", "ring_index", F.posexplode("ring").alias("vertex_index", "vertex"))
        .select(
            *kept, "polygon_index", "ring_index", "vertex_index",
            F.get("vertex", 0).alias("longitude"), F.get("vertex", 1).alias("latitude"),
        )
        .where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
    )


def explode_edges(df: DataFrame, geometry: str, keep: list[str]) -> DataFrame:
    """One row per directed ring edge: x1, y1 to x2, y2. Rings are closed in their own text."""
    kept = [quoted(c) for c in keep]
    pairs = F.zip_with(
        F.slice("ring", F.lit(1), F.size("ring") - 1),
        F.slice("ring", F.lit(2), F.size("ring") - 1),
        lambda a, b: F.struct(
            F.get(a, F.lit(0)).alias("x1"), F.get(a, F.lit(1)).alias("y1"),
            F.get(b, F.lit(0)).alias("x2"), F.get(b, F.lit(1)).alias("y2"),
        ),
    )
    return (
        df.select(*kept, F.posexplode(parse_polygons(quoted(geometry))).alias("polygon_index", "rings"))
        .select(*kept, "polygon_index", F.posexplode("rings").alias("ring_index", "ring"))
        .where(F.size("ring") > 1)
        .select(*kept, "polygon_index", "ring_index", F.posexplode(pairs).alias("k", "edge"))
        .select(*kept, "polygon_index", "ring_index", "k", "edge.x1", "edge.y1", "edge.x2", "edge.y2")
    )


def polygon_measures(edges: DataFrame, key: str) -> DataFrame:
    """Bounds, spherical centre and area in km2 per polygon key.

    ``edges`` has key, polygon_index, ring_index, x1, y1, x2, y2 in degrees. Ring 0 of a polygon adds,
    its further rings are holes and subtract. The centre is the direction of the summed edge normals,
    each weighted with the edge's angle. Both steps are partial aggregates over single edges.
    """
    lon1, lat1, lon2, lat2 = (F.radians(c) for c in ("x1", "y1", "x2", "y2"))
    ax, ay, az = F.cos(lat1) * F.cos(lon1), F.cos(lat1) * F.sin(lon1), F.sin(lat1)
    bx, by, bz = F.cos(lat2) * F.cos(lon2), F.cos(lat2) * F.sin(lon2), F.sin(lat2)
    nx, ny, nz = ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx
    length = F.sqrt(nx * nx + ny * ny + nz * nz)
    weight = F.when(length > 0, F.asin(F.least(F.lit(1.0), length)) / length).otherwise(F.lit(0.0))
    rings = edges.groupBy(key, "polygon_index", "ring_index").agg(
        F.sum((lon2 - lon1) * (F.lit(2.0) + F.sin(lat1) + F.sin(lat2))).alias("turn"),
        F.sum(nx * weight).alias("vx"), F.sum(ny * weight).alias("vy"), F.sum(nz * weight).alias("vz"),
        F.min(F.least("x1", "x2")).alias("min_longitude"), F.max(F.greatest("x1", "x2")).alias("max_longitude"),
        F.min(F.least("y1", "y2")).alias("min_latitude"), F.max(F.greatest("y1", "y2")).alias("max_latitude"),
    )
    # A ring drawn counter-clockwise has a negative turn and normals pointing outwards.
    part = F.when(F.col("ring_index") == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    outward = F.when(F.col("turn") > 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * part
    total = rings.groupBy(key).agg(
        F.sum(part * F.abs("turn")).alias("area"),
        *[F.sum(outward * F.col(c)).alias(c) for c in ("vx", "vy", "vz")],
        F.min("min_longitude").alias("min_longitude"), F.max("max_longitude").alias("max_longitude"),
        F.min("min_latitude").alias("min_latitude"), F.max("max_latitude").alias("max_latitude"),
    )
    flat = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    return total.select(
        key, "min_longitude", "max_longitude", "min_latitude", "max_latitude",
        F.degrees(F.atan2("vy", "vx")).alias("center_longitude"),
        F.degrees(F.atan2(F.col("vz"), flat)).alias("center_latitude"),
        (F.col("area") * F.lit(EARTH_RADIUS_KM * EARTH_RADIUS_KM / 2.0)).alias("area_km2"),
    )


def explode_lines(df: DataFrame, geometry: str, segment: str, keep: list[str]) -> DataFrame:
    """Line text to ordered points: segment_id is ``<segment>_<line>``, point_order counts from 0."""
    kept = [quoted(c) for c in keep]
    return (
        df.select(quoted(segment).alias("_segment"), *kept,
                  F.posexplode(parse_lines(quoted(geometry))).alias("_line", "_points"))
        .select(F.concat_ws("_", "_segment", "_line").alias("segment_id"), *kept,
                F.posexplode("_points").alias("point_order", "_vertex"))
        .select("segment_id", "point_order", *kept,
                F.get("_vertex", 1).alias("latitude"), F.get("_vertex", 0).alias("longitude"))
        .where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
    )
