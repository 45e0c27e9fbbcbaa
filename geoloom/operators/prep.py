"""Preparation jobs that turn raw files into the typed relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from geoloom.functions.geo import quoted
from geoloom.functions.geojson import explode_lines
from geoloom.operators.ordering import deduplicate
from geoloom.operators.region import assign_region

# Code lists of the public tsunami event database.
VALIDITY_WORDS = {
    -1: "erroneous entry", 0: "seiche or inland disturbance", 1: "very doubtful", 2: "questionable",
    3: "probable", 4: "definite",
}
CAUSE_WORDS = {
    0: "unknown", 1: "earthquake", 2: "questionable earthquake", 3: "earthquake and landslide",
    4: "volcano and earthquake", 5: "volcano, earthquake and landslide", 6: "volcano",
    7: "volcano and landslide", 8: "landslide", 9: "meteorological", 10: "explosion", 11: "astronomical tide",
}


def box_subset(
    df: DataFrame, south: float, north: float, west: float, east: float, above: dict[str, float] | None = None,
    latitude: str = "latitude", longitude: str = "longitude",
) -> DataFrame:
    """Rows inside a closed box whose ``above`` columns are strictly greater than the given values."""
    inside = quoted(latitude).between(south, north) & quoted(longitude).between(west, east)
    for name, bound in (above or {}).items():
        inside = inside & (quoted(name) > bound)
    return df.where(inside)


def drop_units_row(df: DataFrame, key: str, schema: T.StructType) -> DataFrame:
    """Casts an all-text table to ``schema`` and drops rows whose key is no value of its type.

    Such rows are units printed below the header. Other cells that do not fit become null.
    """
    wanted = {f.name: f.dataType for f in schema.fields}
    kept = df.where(quoted(key).try_cast(wanted[key]).isNotNull())
    return kept.select(*[quoted(n).try_cast(t).alias(n) for n, t in wanted.items()])


def main_tracks(
    df: DataFrame, first_season: int, last_season: int, columns: Sequence[str],
    track_type: str = "track_type", main: str = "main", season: str = "season",
) -> DataFrame:
    """Main-track rows of a range of seasons, reduced to ``columns``."""
    kept = (quoted(track_type) == main) & quoted(season).between(first_season, last_season)
    return df.where(kept).select(*[quoted(c) for c in columns])


def strong_events(
    df: DataFrame, minimum: float, start: str, end: str, magnitude: str = "magnitude", time: str = "observed_at",
    tiebreak: str = "event_id",
) -> DataFrame:
    """Events of at least ``minimum`` from ``start`` up to before ``end``, in time order."""
    at = quoted(time)
    window = (at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz"))
    return df.where((quoted(magnitude) >= minimum) & window).orderBy(at.asc_nulls_last(), quoted(tiebreak))


def decode(code: Column, words: dict) -> Column:
    """Word of a code from a fixed list; null for an unknown code."""
    pairs = [F.lit(x) for pair in words.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), code)


def dated_events(
    df: DataFrame, validity: str = "validity", accepted: Sequence[str] = ("definite",), year: str = "year"
) -> DataFrame:
    """Events of accepted validity; the year stays a signed integer, negative before the common era."""
    return df.withColumn(year, quoted(year).cast("int")).where(quoted(validity).isin(*accepted))


def segment_points(df: DataFrame, start: tuple[str, str], end: tuple[str, str], keep: Sequence[str]) -> DataFrame:
    """One or two ordered points per segment record; an end at 0, 0 (or without a value) is left out."""

    def point(order: int, names: tuple[str, str]) -> Column:
        return F.struct(
            F.lit(order).alias("point_order"), quoted(names[0]).cast("double").alias("latitude"),
            quoted(names[1]).cast("double").alias("longitude"),
        )

    def usable(p: Column) -> Column:
        missing = (p["latitude"] == 0) & (p["longitude"] == 0)
        return (p["point_order"] == 0) | ~F.coalesce(missing, F.lit(True))

    points = F.filter(F.array(point(0, start), point(1, end)), usable)
    return df.select(*[quoted(c) for c in keep], F.explode(points).alias("_p")).select(
        *[quoted(c) for c in keep], "_p.point_order", "_p.latitude", "_p.longitude"
    )


def river_points(
    df: DataFrame, geometry: str, segment: str, name: str = "name", rank: str = "scalerank",
    lowest: int = 0, highest: int = 5,
) -> DataFrame:
    """Named line features of a range of ranks as ordered points."""
    kept = df.where(quoted(name).isNotNull() & (quoted(name) != "") & quoted(rank).between(lowest, highest))
    return explode_lines(kept, geometry, segment, [name, rank])


def notable_places(
    df: DataFrame, item: str = "place_id", latitude: str = "latitude", longitude: str = "longitude",
    links: str = "sitelinks", minimum: int = 10, order: Sequence[str] = ("category", "name"),
) -> DataFrame:
    """Places with enough links, one row per item and coordinate."""
    kept = df.where((quoted(links) >= minimum) & quoted(latitude).isNotNull() & quoted(longitude).isNotNull())
    return deduplicate(kept, [item, latitude, longitude], list(order))


def branded_places(
    df: DataFrame, edges: DataFrame, polygon: str, brands: Sequence[str], minimum: float = 0.7,
    brand: str = "brand", confidence: str = "confidence", name: str = "region_id", **options,
) -> DataFrame:
    """Confident places of given brands with the polygon that holds each."""
    kept = df.where((quoted(confidence) >= minimum) & quoted(brand).isin(*brands))
    return assign_region(kept, edges, polygon, name=name, **options)
