"""Numbers, distances, altitudes and ring sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed values.
EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.2
POINT_ALTITUDE = 0.014
SURFACE_ALTITUDE = 0.018
MAX_ALTITUDE = 20.0
RING_SCALE = 0.7
RING_MIN = 2.5
RING_MAX = 20.0
RING_POINT_RADIUS = 0.22

NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def quoted(name: str) -> Column:
    """Column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_number(df: DataFrame, name: str) -> Column:
    """Double value of a column; null for blank or non-numeric text and for other types."""
    dtype = df.schema[name].dataType
    value = quoted(name)
    if isinstance(dtype, T.StringType):
        return F.when(value.rlike(NUMBER_TEXT), F.trim(value).try_cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    return F.lit(None).cast("double")


def is_finite(value: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def rounded(value: Column, digits: int = 0) -> Column:
    """Rounds half away from zero on the double itself: the scaled value is rounded, then scaled back.

    Spark's own ``round`` goes through the decimal text of a double and differs in ties.
    """
    scale = F.lit(10.0**digits)
    magnitude = F.floor(F.abs(value) * scale + F.lit(0.5)).cast("double") / scale
    return F.when(value < 0, -magnitude).otherwise(magnitude)


def approx_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar distance with the longitude shortened by the first point's latitude."""
    dlat = lat1 - lat2
    dlon = (lon1 - lon2) * F.cos(F.radians(lat1))
    return F.lit(KM_PER_DEGREE) * F.sqrt(dlat * dlat + dlon * dlon)


def angular_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle angle in degrees by the spherical law of cosines; null when a part is null."""
    a, b = F.radians(lat1), F.radians(lat2)
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon2) - F.radians(lon1))
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))
    return F.when(cosine.isNotNull(), F.degrees(F.acos(clamped)))


def relative_altitude(altitude_km: Column | None, fallback: float) -> Column:
    """Altitude in Earth radii within 0..20; the fallback where it is absent or not finite."""
    if altitude_km is None:
        return F.lit(float(fallback))
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(MAX_ALTITUDE), altitude_km / F.lit(EARTH_RADIUS_KM)))
    return F.when(is_finite(altitude_km), scaled).otherwise(F.lit(float(fallback)))


def ring_radius(size: Column | None, style_radius: float) -> Column:
    """Ring size from the square root of a value, or the style's own radius without one."""
    if size is None:
        return F.lit(float(style_radius))
    scaled = F.sqrt(F.abs(size)) * F.lit(RING_SCALE)
    clamped = F.greatest(F.lit(RING_MIN), F.least(F.lit(RING_MAX), scaled))
    return F.when(is_finite(size), clamped).otherwise(F.lit(float(style_radius)))


def focus_altitude(altitude: Column) -> Column:
    """Viewing height above a single row."""
    return F.least(F.lit(22.0), F.greatest(F.lit(0.72), altitude + F.lit(0.75)))
