"""Rows to geographic marks: points, rings, paths and polygons."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from geoloom.functions.color import palette_color
from geoloom.functions.geo import (
    POINT_ALTITUDE, RING_POINT_RADIUS, SURFACE_ALTITUDE, as_number, is_finite, quoted, relative_altitude,
    ring_radius,
)
from geoloom.functions.geojson import explode_vertices, parse_polygons
from geoloom.functions.text import row_label
from geoloom.operators.ordering import add_positions
from geoloom.operators.skew import DEFAULT_POLICY, HotPolicy

ROW_INDEX = "_row_index"

MARK_TYPES = {
    "layer_pos": "int", "layer_id": "string", "result_id": "string", "mark_type": "string",
    "row_index": "bigint", "latitude": "double", "longitude": "double", "altitude": "double",
    "label": "string", "color": "string", "opacity": "double", "point_radius": "double",
    "ring_radius": "double", "path_key": "string", "path_position": "bigint",
    "width": "double", "animate": "boolean", "geometry": "string",
}


@dataclass(frozen=True)
class Style:
    """Fixed look of a layer; ``radius`` None means the default of the mark type."""

    color: str | None = None
    opacity: float = 0.92
    width: float = 0.7
    radius: float | None = None
    animate: bool | None = None


@dataclass(frozen=True)
class Layer:
    """A result shown as marks; ``encoding`` maps roles to columns."""

    id: str
    type: str
    encoding: dict
    style: Style = Style()
    result_id: str | None = None
    title: str | None = None
    pos: int = 0


def valid_points(df: DataFrame, latitude: str, longitude: str) -> DataFrame:
    """Rows whose coordinates are both finite numbers; null and blank are not."""
    return df.where(is_finite(as_number(df, latitude)) & is_finite(as_number(df, longitude)))


def coordinate_report(df: DataFrame, latitude: str, longitude: str) -> DataFrame:
    """How many rows :func:`valid_points` keeps and drops."""
    valid = is_finite(as_number(df, latitude)) & is_finite(as_number(df, longitude))
    return df.agg(
        F.count_if(F.coalesce(valid, F.lit(False))).alias("valid_rows"),
        F.count_if(~F.coalesce(valid, F.lit(False))).alias("dropped_rows"),
    )


def _role(layer: Layer, role: str) -> Column | None:
    name = layer.encoding.get(role)
    return quoted(name) if name else None


def _altitude(df: DataFrame, layer: Layer, fallback: float) -> Column:
    name = layer.encoding.get("altitude")
    return relative_altitude(as_number(df, name) if name else None, fallback)


def _color(layer: Layer) -> Column:
    if layer.style.color:
        return F.lit(layer.style.color)
    group = _role(layer, "group")
    return palette_color(group if group is not None else F.lit(layer.id))


def _marks(df: DataFrame, layer: Layer, **values: Column) -> DataFrame:
    row_index = F.col(ROW_INDEX) if ROW_INDEX in df.columns else F.lit(None)
    known = {
        "layer_pos": F.lit(layer.pos), "layer_id": F.lit(layer.id), "result_id": F.lit(layer.result_id),
        "mark_type": F.lit(layer.type), "row_index": row_index, "opacity": F.lit(layer.style.opacity),
        "color": _color(layer), "label": row_label(_role(layer, "label"), _role(layer, "group")), **values,
    }
    return df.select(*[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in MARK_TYPES.items()])


def _located(df: DataFrame, layer: Layer) -> tuple[DataFrame, dict[str, Column]]:
    latitude, longitude = layer.encoding["latitude"], layer.encoding["longitude"]
    kept = valid_points(df, latitude, longitude)
    return kept, {"latitude": as_number(df, latitude), "longitude": as_number(df, longitude)}


def points_layer(df: DataFrame, layer: Layer) -> DataFrame:
    """One point per valid row."""
    kept, at = _located(df, layer)
    radius = layer.style.radius
    if radius is None:
        radius = 0.1 if layer.encoding.get("altitude") else 0.28
    return _marks(kept, layer, **at, altitude=_altitude(df, layer, POINT_ALTITUDE), point_radius=F.lit(radius))


def rings_layer(df: DataFrame, layer: Layer) -> DataFrame:
    """One point and ring per valid row; the ring grows with the size role."""
    kept, at = _located(df, layer)
    size = layer.encoding.get("size")
    default = 6.0 if layer.style.radius is None else layer.style.radius
    return _marks(
        kept, layer, **at, altitude=_altitude(df, layer, SURFACE_ALTITUDE), point_radius=F.lit(RING_POINT_RADIUS),
        ring_radius=ring_radius(as_number(df, size) if size else None, default),
    )


def paths_layer(df: DataFrame, layer: Layer, policy: HotPolicy = DEFAULT_POLICY) -> DataFrame:
    """Path points in long form: one row per point with its position in its path.

    All rows without a group form one path, and a single point is a path too. A path has the label of its
    first point. A path may hold any number of points; :func:`path_chunks` gives arrays.
    """
    group, order = layer.encoding["group"], layer.encoding["order"]
    label = layer.encoding.get("label") or group
    kept, at = _located(df, layer)
    ties = [ROW_INDEX] if ROW_INDEX in df.columns else []
    placed = add_positions(kept, group, order, ties, first=[label], size=False, policy=policy)
    animate = True if layer.style.animate is None else layer.style.animate
    return _marks(
        placed, layer, **at, altitude=_altitude(df, layer, SURFACE_ALTITUDE), path_key=quoted(group),
        path_position=F.col("position"), label=quoted(f"first_{label}"),
        width=F.lit(layer.style.width), animate=F.lit(animate),
    )


def path_chunks(marks: DataFrame, size: int = 10_000) -> DataFrame:
    """Paths as arrays of at most ``size`` points: one row per path and chunk, chunks counted from 0."""
    point = F.struct(
        F.col("path_position").alias("position"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
        F.col("altitude").alias("alt"),
    )
    chunk = F.floor((F.col("path_position") - 1) / F.lit(size)).cast("bigint")
    return marks.groupBy("layer_pos", "layer_id", "path_key", chunk.alias("chunk")).agg(
        F.first("label").alias("label"), F.first("color").alias("color"), F.first("width").alias("width"),
        F.first("animate").alias("animate"),
        F.array_sort(F.collect_list(point)).alias("points"),
    )


def polygons_layer(df: DataFrame, layer: Layer) -> DataFrame:
    """One polygon per row with Polygon or MultiPolygon text, plain or inside a Feature; others are dropped."""
    geometry = quoted(layer.encoding["geometry"])
    return _marks(df.where(parse_polygons(geometry).isNotNull()), layer, geometry=geometry)


BUILDERS = {
    "points": points_layer, "rings": rings_layer, "paths": paths_layer, "polygons": polygons_layer,
}


def layer_marks(df: DataFrame, layer: Layer) -> DataFrame:
    """Marks of one layer by its type."""
    return BUILDERS[layer.type](df, layer)


def union_layers(layers: list[DataFrame]) -> DataFrame:
    """Bag union of the marks of several layers; ``layer_pos`` gives the order back to front."""
    return reduce(DataFrame.unionByName, layers)


def layer_locations(df: DataFrame, layer: Layer) -> DataFrame:
    """Latitude, longitude and altitude of everything a layer shows, as used for its extent."""
    if layer.type == "polygons":
        found = explode_vertices(df, layer.encoding["geometry"], [])
        return found.select("latitude", "longitude", F.lit(0.0).alias("altitude"))
    kept, at = _located(df, layer)
    return kept.select(
        at["latitude"].alias("latitude"), at["longitude"].alias("longitude"),
        _altitude(df, layer, 0.0).alias("altitude"),
    )
