"""Spatial extent of a set of locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geoloom.functions.geo import angular_degrees

# Fixed values.
SINGLE_ALTITUDE = 0.8
FIT_BASE = 0.72
FIT_DEGREES = 65.0
FIT_MIN = 1.6
FIT_MAX = 3.0
OBJECT_CLEARANCE = 1.25
VIEW_MAX = 22.0
#: Directions whose mean is shorter than this cancel out: sine and cosine of a double in degrees err by about 1e-15.
NO_DIRECTION = 1e-14
#: Bits of one part of an exact sum; parts of 2^33 rows fit a long.
PART_BITS = 30


def _exact_sums(name: str, value: Column) -> list[Column]:
    """Sums of the two parts of a value within -1..1, to 2^-60 a row; whole numbers add up alike in any order."""
    scaled = value * F.lit(float(1 << PART_BITS))
    high = F.floor(scaled)
    low = F.floor((scaled - high) * F.lit(float(1 << PART_BITS)))
    return [F.sum(high).alias(f"{name}_high"), F.sum(low).alias(f"{name}_low")]


def _exact_mean(name: str) -> Column:
    high, low = (F.col(f"{name}_{part}").cast("double") / F.col("n") for part in ("high", "low"))
    return (high + low / F.lit(float(1 << PART_BITS))) / F.lit(float(1 << PART_BITS))


def _mean_direction() -> Column:
    """Degrees of the mean of directions; 0, as of a mean of length 0, where they cancel out and only rounding is left."""
    sine, cosine = _exact_mean("sine"), _exact_mean("cosine")
    return F.when(F.col("unknown"), F.lit(float("nan"))).when(
        F.hypot(sine, cosine) > NO_DIRECTION, F.degrees(F.atan2(sine, cosine))).when(F.col("n") > 0, F.lit(0.0))


def extent(locations: DataFrame) -> DataFrame:
    """Centre, spread and view altitude of (latitude, longitude, altitude); no row without locations.

    Two global aggregates: the centre first, then the widest angle from it. The centre reaches the second
    pass as a scalar subquery, so no rows are joined or collected. The longitude's sums do not depend on the order of
    rows; where the longitudes cancel out (evenly around the globe, say), no direction is their mean and it is 0.
    """
    rows = locations.select("latitude", "longitude", F.coalesce("altitude", F.lit(0.0)).alias("altitude"))
    angle = F.radians("longitude")
    centre = rows.agg(
        F.avg("latitude").alias("lat"), F.count("longitude").alias("n"), F.max(F.isnan(F.sin(angle))).alias("unknown"),
        *_exact_sums("sine", F.sin(angle)), *_exact_sums("cosine", F.cos(angle)),
    ).select(F.struct("lat", _mean_direction().alias("lon")).alias("c"))
    c = centre.scalar()
    spread = angular_degrees(c["lat"], c["lon"], F.col("latitude"), F.col("longitude"))
    measured = rows.agg(
        F.count(F.lit(1)).alias("locations"), F.max(spread).alias("angular_spread"),
        F.max("altitude").alias("object_altitude"),
    ).where(F.col("locations") > 0)
    fitted = F.when(F.col("locations") == 1, F.lit(SINGLE_ALTITUDE)).otherwise(
        F.greatest(F.lit(FIT_MIN), F.least(F.lit(FIT_MAX), F.lit(FIT_BASE) + F.col("angular_spread") / FIT_DEGREES))
    )
    return measured.select(
        c["lat"].alias("center_latitude"), c["lon"].alias("center_longitude"), "locations", "angular_spread",
        F.least(F.lit(VIEW_MAX), F.greatest(fitted, F.col("object_altitude") + OBJECT_CLEARANCE)).alias("view_altitude"),
    )
