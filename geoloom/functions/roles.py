"""Which column plays which geographic role."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

# Candidate names per role, best first.
ROLE_CANDIDATES = {
    "latitude": ["latitude", "lat", "center_latitude", "y"],
    "longitude": ["longitude", "lon", "lng", "long", "center_longitude", "x"],
    "altitude": ["altitude_km", "altitude", "height_km"],
    "geometry": ["geometry_geojson", "geojson", "geometry", "geom"],
    "group": [
        "id", "sid", "satellite_id", "place_id", "track_id", "trajectory_id", "group_id",
        "segment_id", "tornado_id", "tsunami_id", "volcano_number",
    ],
    "order": ["point_order", "observed_at", "iso_time", "time", "timestamp", "t"],
    "label": [
        "name", "brand", "volcano_name", "location_name", "place", "title", "label", "id", "sid",
        "event_id",
    ],
    "size": [
        "radius_km", "radius", "magnitude", "vei", "water_height_m", "maximum_water_height_m",
        "wind_kts", "value",
    ],
}


def infer_roles(columns: Iterable[str]) -> dict[str, str | None]:
    """Role to column name, by the first candidate present whatever its case."""
    present = {name.lower(): name for name in columns}
    return {
        role: next((present[name] for name in names if name in present), None)
        for role, names in ROLE_CANDIDATES.items()
    }


def roles_of_tables(columns: DataFrame) -> DataFrame:
    """The same choice for many tables at once.

    ``columns`` has one row per (table_name, column_name); the result one per table and role found.
    """
    rows = [(role, name, i) for role, names in ROLE_CANDIDATES.items() for i, name in enumerate(names)]
    candidates = columns.sparkSession.createDataFrame(rows, "role string, candidate string, rank int")
    # The candidate table is the constant above (under 60 rows), so its size is known.
    found = columns.join(F.broadcast(candidates), F.lower("column_name") == F.col("candidate"))
    return found.groupBy("table_name", "role").agg(F.min_by("column_name", "rank").alias("column_name"))
