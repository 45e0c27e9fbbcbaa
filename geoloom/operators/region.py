"""Assignment of points to polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geoloom.functions.geo import quoted
from geoloom.operators.skew import DEFAULT_POLICY, HotPolicy, fits, grid_join, lookup_join
from geoloom.session import materialise

# Edges that one task may hold as a broadcast table: 32 bytes each, so some 16 MB.
BROADCAST_EDGES = 500_000
# Edges per row where a polygon is not broadcast.
CHUNK_EDGES = 1_000
CELL = ["_lat", "_lon"]


def _at(value: Column, cell: float) -> Column:
    return F.floor(value / F.lit(float(cell))).cast("bigint")


def region_edges(edges: DataFrame, polygon: str, cell: float = 5.0) -> DataFrame:
    """Edges by grid cell: (_lat, _lon, id, x1, y1, x2, y2).

    A cell gets the edges that a ray to the east from one of its points can cross: they overlap the cell's
    latitudes and do not end west of it. Level edges are never crossed and left out.
    """
    slanted = edges.select(quoted(polygon).alias("id"), "x1", "y1", "x2", "y2").where(F.col("y1") != F.col("y2"))
    banded = slanted.withColumn("_lat", F.explode(
        F.sequence(_at(F.least("y1", "y2"), cell), _at(F.greatest("y1", "y2"), cell))))
    bands = banded.groupBy("id", "_lat").agg(
        F.min(F.least("x1", "x2")).alias("_west"), F.max(F.greatest("x1", "x2")).alias("_east")
    ).select("id", "_lat", F.explode(
        F.sequence(_at(F.col("_west"), cell), _at(F.col("_east"), cell))).alias("_lon"))
    return banded.join(bands, ["id", "_lat"]).where(
        F.greatest("x1", "x2") >= F.col("_lon").cast("double") * F.lit(float(cell))
    )


def _crossings(edges: str | Column, lat: Column, lon: Column) -> Column:
    """How many edges a ray to the east crosses; half-open in latitude, so a vertex counts once."""

    def crosses(e: Column) -> Column:
        return ((e["y1"] > lat) != (e["y2"] > lat)) & (
            lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        )

    return F.size(F.filter(edges, crosses))


def assign_region(
    points: DataFrame, edges: DataFrame, polygon: str, latitude: str = "latitude", longitude: str = "longitude",
    name: str = "region_id", cell: float = 5.0, key: str | None = None, policy: HotPolicy = DEFAULT_POLICY,
    broadcast_edges: int = BROADCAST_EDGES,
) -> DataFrame:
    """Adds the id of the polygon that holds each point, or null.

    ``edges`` has the polygon key and x1, y1, x2, y2 of every ring, holes included: a point is inside when
    a ray to the east crosses an odd number of edges, so holes work and a shared border belongs to one
    side only. Of overlapping polygons the smallest id wins. Rings that cross the antimeridian must be
    split beforehand.

    Few edges (a count checks it) are broadcast by cell, and the points are not shuffled at all. More edges
    are joined with the points by cell, hot cells cut into grids; ``key`` then names a unique column of the
    points, without which they are numbered and stored first.
    """
    placed = region_edges(edges, polygon, cell)
    if fits(placed, broadcast_edges):
        return _assign_broadcast(points, placed, quoted(latitude), quoted(longitude), name, cell)
    return _assign_joined(points, placed, latitude, longitude, name, cell, key, policy)


def _assign_broadcast(points, placed, lat, lon, name, cell) -> DataFrame:
    regions = placed.groupBy(*CELL, "id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    table = regions.groupBy(F.struct(*CELL).alias("_cell")).agg(
        F.array_sort(F.collect_list(F.struct("id", "edges"))).alias("_regions")
    )
    located = points.withColumn("_cell", F.when(
        lat.isNotNull() & lon.isNotNull(), F.struct(_at(lat, cell).alias("_lat"), _at(lon, cell).alias("_lon")),
    ))
    holding = F.filter("_regions", lambda r: _crossings(r["edges"], lat, lon) % 2 == 1)
    # The caller has counted at most BROADCAST_EDGES edges.
    joined = located.join(F.broadcast(table), "_cell", "left")
    return joined.withColumn(name, F.get(holding, 0)["id"]).drop("_cell", "_regions")


def _assign_joined(points, placed, latitude, longitude, name, cell, key, policy) -> DataFrame:
    keyed = points
    if key is None:
        key = "_point"
        keyed = materialise(points.withColumn(key, F.monotonically_increasing_id()))
    part = F.pmod(F.xxhash64("x1", "y1", "x2", "y2"), F.greatest(F.lit(1), F.ceil(F.col("_n") / CHUNK_EDGES)))
    placed = placed.withColumn("_piece", F.struct(*CELL, "id"))
    sizes = placed.groupBy("_piece").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.least("y1", "y2")).alias("_south"),
        F.max(F.greatest("y1", "y2")).alias("_north"), F.max(F.greatest("x1", "x2")).alias("_east"),
    )
    sized = lookup_join(placed, sizes, "_piece", "inner", policy)
    chunks = sized.groupBy(*CELL, "id", "_south", "_north", "_east", part.alias("_chunk")).agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges")
    ).drop("_chunk")
    lat, lon = F.col("_y"), F.col("_x")
    located = keyed.where(quoted(latitude).isNotNull() & quoted(longitude).isNotNull()).select(
        quoted(key).alias("_key"), quoted(latitude).alias("_y"), quoted(longitude).alias("_x"),
        _at(quoted(latitude), cell).alias("_lat"), _at(quoted(longitude), cell).alias("_lon"),
    )
    reachable = (lat >= F.col("_south")) & (lat < F.col("_north")) & (lon < F.col("_east"))
    met = grid_join(located, chunks, CELL, reachable, policy)
    inside = met.groupBy("_key", "id").agg(F.sum(_crossings("_edges", lat, lon)).alias("_n")).where(F.col("_n") % 2 == 1)
    found = inside.groupBy("_key").agg(F.min("id").alias(name))
    joined = keyed.join(found, quoted(key) == F.col("_key"), "left").drop("_key")
    return joined.drop("_point")
