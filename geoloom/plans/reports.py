"""The named reports over the bundled relations, and the scenes that show them.

Each report takes relations by name and returns a DataFrame whose columns carry the roles of its layer.
Every order ends in a unique key, so limits and ties are repeatable.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from geoloom.functions.geo import rounded
from geoloom.operators.near import near_join
from geoloom.operators.ordering import decimate_path, exact_median, top_per_group
from geoloom.session import materialise

Relations = dict[str, DataFrame]


def persistent_loops(r: Relations, top: int = 24) -> DataFrame:
    """Drifters with a drogue: mean place, longest persistence, median radius, observations."""
    rows = r["drifter_loopers"].where(F.col("drogue") == 1)
    summary = rows.groupBy("id").agg(
        F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"), F.max("persist").alias("longest"),
        F.count(F.lit(1)).alias("observations"),
    )
    return (
        summary.join(exact_median(rows, "id", "radius", "middle"), "id", "left")
        .select(
            "id", rounded(F.col("lat"), 3).alias("latitude"), rounded(F.col("lon"), 3).alias("longitude"),
            rounded(F.col("longest"), 1).alias("persistence_days"),
            rounded(F.col("middle") / 1000, 1).alias("radius_km"), "observations",
        )
        .orderBy(F.col("persistence_days").desc_nulls_last(), "id")
        .limit(top)
    )


STORM_FIELDS = ["sid", "name", "iso_time", "latitude", "longitude", "wind_kts", "pressure_mb"]


def recent_storms(r: Relations, first_season: int = 2023) -> DataFrame:
    """Observations of named storms from a season on, along each track."""
    named = (F.col("season") >= first_season) & (F.col("name") != "UNNAMED")
    return r["atlantic_storms"].where(named).select(*STORM_FIELDS).orderBy("sid", F.col("iso_time").asc_nulls_last())


def season_storms(r: Relations, season: int = 2025) -> DataFrame:
    """Observations of the named storms of one season."""
    named = (F.col("season") == season) & (F.col("name") != "UNNAMED")
    return r["atlantic_storms"].where(named).select(*STORM_FIELDS).orderBy("sid", F.col("iso_time").asc_nulls_last())


def loops_near_storms(r: Relations, km: float = 500.0, top: int = 200) -> DataFrame:
    """Drifter observations closest to a storm observation of about the same day."""
    loops = r["drifter_loopers"].select("id", "observed_at", "latitude", "longitude")
    storms = r["atlantic_storms"].select(
        F.col("sid").alias("storm_id"), F.col("name").alias("storm"), F.col("iso_time").alias("storm_time"),
        F.col("latitude").alias("storm_latitude"), F.col("longitude").alias("storm_longitude"),
    )
    order = ["distance_km", "id", "observed_at", "storm_id", "storm_time"]
    # The closest pairs are usually far closer than the reach, so smaller ones are tried first: once enough pairs lie
    # within a radius, no pair beyond it belongs to the answer.
    for radius in (km / 16, km / 4):
        nearest = materialise(_loops_and_storms(loops, storms, radius).orderBy(*order).limit(top))
        if nearest.count() == top:
            break
    else:
        nearest = _loops_and_storms(loops, storms, km).orderBy(*order).limit(top)
    return nearest.select("id", "storm", "observed_at", "latitude", "longitude", "distance_km")


def _loops_and_storms(loops: DataFrame, storms: DataFrame, km: float) -> DataFrame:
    return near_join(
        loops, storms, ("latitude", "longitude", "observed_at"), ("storm_latitude", "storm_longitude", "storm_time"),
        days=1, dlat=5.0, dlon=7.0, km=km,
    )


# Fixed values.
COUNTRY_NAMES = ["Germany", "Austria", "France", "Italy", "Poland", "Switzerland"]
RIVER_NAMES = ["Congo", "Danube", "Ganges", "Mekong", "Mississippi", "Murray", "Nile", "Volga", "Yangtze"]


def countries(r: Relations, names: list[str] = COUNTRY_NAMES) -> DataFrame:
    """Boundaries of the named countries."""
    fields = ["country_id", "name", "center_latitude", "center_longitude", "area_km2", "geometry_geojson"]
    return r["country_boundaries"].where(F.col("name").isin(names)).select(*fields).orderBy("name")


def strong_earthquakes(r: Relations, minimum: float = 7.5) -> DataFrame:
    """Earthquakes from a magnitude on, strongest first."""
    return r["earthquakes"].where(F.col("magnitude") >= minimum).select(
        "event_id", "observed_at", F.col("place").alias("name"), "latitude", "longitude", "magnitude", "depth_km",
        "tsunami_flag",
    ).orderBy(F.col("magnitude").desc_nulls_last(), F.col("observed_at").asc_nulls_last(), "event_id")


RIVER_FIELDS = ["segment_id", "point_order", "name", "latitude", "longitude", "scalerank"]


def ranked_rivers(r: Relations, highest: int = 2) -> DataFrame:
    """Points of the rivers up to a display rank."""
    return r["major_rivers"].where(F.col("scalerank") <= highest).select(*RIVER_FIELDS).orderBy(
        "segment_id", "point_order"
    )


def named_rivers(r: Relations, names: list[str] = RIVER_NAMES, every: int = 5) -> DataFrame:
    """Thinned points of named rivers: first, last and every fifth of a segment."""
    rows = r["major_rivers"].where(F.col("name").isin(names)).select(*RIVER_FIELDS)
    return decimate_path(rows, "segment_id", "point_order", every).orderBy("segment_id", "point_order")


PLACE_FIELDS = ["place_id", "name", "country", "latitude", "longitude", "sitelinks"]


def theme_parks(r: Relations) -> DataFrame:
    """All theme parks by country and name."""
    return r["theme_parks_landmarks"].where(F.col("category") == "theme park").select(*PLACE_FIELDS).orderBy(
        F.col("country").asc_nulls_last(), "name", "place_id"
    )


def heritage_landmarks(r: Relations, top: int = 260) -> DataFrame:
    """Heritage places with the most links."""
    rows = r["theme_parks_landmarks"].where(F.col("category") == "UNESCO heritage landmark")
    return rows.select(*PLACE_FIELDS).orderBy(F.col("sitelinks").desc_nulls_last(), "name", "place_id").limit(top)


CHAIN_FIELDS = ["place_id", "brand", "country", "confidence", "latitude", "longitude"]


def brand_sample(r: Relations, brand: str, per_country: int = 5) -> DataFrame:
    """The most confident places of a brand in each country."""
    rows = r["global_chains"].where((F.col("brand") == brand) & F.col("country").isNotNull()).select(*CHAIN_FIELDS)
    order = [F.col("confidence").desc_nulls_last(), F.col("place_id").asc_nulls_last()]
    return top_per_group(rows, ["country"], order, per_country).orderBy("country", "place_id")


def brand_places(r: Relations, brand: str = "IKEA") -> DataFrame:
    """All places of a brand."""
    return r["global_chains"].where(F.col("brand") == brand).select(*CHAIN_FIELDS).orderBy(
        F.col("country").asc_nulls_last(), "place_id"
    )


def large_tsunamis(r: Relations, minimum: float = 5.0) -> DataFrame:
    """Definite tsunami sources with waves of at least ``minimum`` metres, highest first."""
    kept = (F.col("validity") == "definite") & (F.col("maximum_water_height_m") >= minimum)
    return r["tsunami_events"].where(kept).select(
        "tsunami_id", "year", "month", "day", F.col("location_name").alias("name"), "country", "latitude",
        "longitude", "maximum_water_height_m", "cause",
    ).orderBy(F.col("maximum_water_height_m").desc_nulls_last(), F.col("year").asc_nulls_last(), "tsunami_id")


@dataclass(frozen=True)
class Report:
    """A named report with the text and look of the scene that shows it."""

    id: str
    query_id: str
    title: str
    headline: str
    subheadline: str
    build: Callable[[Relations], DataFrame] = field(repr=False)
    relations: tuple[str, ...]
    layer_type: str
    style: dict = field(default_factory=dict)
    fit: str = "none"
    showcase: bool = True

    def scene(self, result_id: str) -> dict:
        layer = {"id": self.id, "resultId": result_id, "type": self.layer_type, "title": self.title,
                 "style": {**STYLES[self.layer_type], **self.style}}
        return {"headline": self.headline, "subheadline": self.subheadline, "layers": [layer],
                "camera": {"fit": self.fit}}


#: Looks of the reports, one for each type of mark; colours come from the palette.
STYLES = {"points": {"radius": 0.3, "opacity": 0.8}, "rings": {"radius": 5.0, "opacity": 0.75},
          "paths": {"width": 0.9, "opacity": 0.8}, "polygons": {"opacity": 0.6}}

# The ids of reports and of their queries, which are part of the ids of snapshots.
REPORTS = {
    report.id: report
    for report in [
        Report("theme_parks", "places", "Theme parks", "Theme parks of the world",
               "Every well documented theme park, by country.", theme_parks, ("theme_parks_landmarks",), "points"),
        Report("heritage_landmarks", "places", "Heritage landmarks", "The best known heritage places",
               "The 260 heritage places with the most links.", heritage_landmarks, ("theme_parks_landmarks",),
               "points"),
        Report("mcdonalds", "locations", "McDonald's", "McDonald's in every country",
               "The five most confident locations per country.", lambda r: brand_sample(r, "McDonald's"),
               ("global_chains",), "points"),
        Report("starbucks", "locations", "Starbucks", "Starbucks in every country",
               "The five most confident locations per country.", lambda r: brand_sample(r, "Starbucks"),
               ("global_chains",), "points"),
        Report("ikea", "locations", "IKEA", "All IKEA locations", "Every confident IKEA location by country.",
               brand_places, ("global_chains",), "points"),
        Report("earthquakes", "events", "Magnitude 8 and above", "The largest earthquakes",
               "Earthquakes of magnitude 8 and above since 1900.", lambda r: strong_earthquakes(r, 8.0),
               ("earthquakes",), "rings"),
        Report("major_rivers", "paths", "Major rivers", "Nine great rivers",
               "Thinned centrelines that keep both ends of every segment.", named_rivers, ("major_rivers",), "paths",
               style={"animate": False}),
        Report("tsunamis", "events", "Large tsunamis", "Sources of large tsunamis",
               "Definite sources with waves of five metres or more.", large_tsunamis, ("tsunami_events",), "rings"),
        Report("atlantic_storms", "tracks", "Atlantic storms", "Atlantic storms of 2025",
               "Tracks of the named storms of one season.", season_storms, ("atlantic_storms",), "paths", fit="all-layers"),
        Report("ocean_loops", "loops", "Ocean loops", "Drifters that keep looping",
               "The 24 most persistent loops of drifters with a drogue.", persistent_loops, ("drifter_loopers",),
               "rings", fit="all-layers"),
        Report("storms", "tracks", "Recent storms", "Storm tracks since 2023",
               "Wind and pressure along the tracks of named storms.", recent_storms, ("atlantic_storms",), "paths",
               fit="all-layers", showcase=False),
        Report("join", "pairs", "Loops near storms", "Where loops met storms",
               "The 200 closest meetings within a day and 500 km.", loops_near_storms,
               ("drifter_loopers", "atlantic_storms"), "points", fit="all-layers", showcase=False),
        Report("countries", "boundaries", "Countries", "Six neighbours", "Boundaries of six countries.", countries,
               ("country_boundaries",), "polygons", fit="all-layers", showcase=False),
        Report("strong_earthquakes", "events", "Magnitude 7.5 and above", "Strong earthquakes",
               "Earthquakes of magnitude 7.5 and above since 1900.", strong_earthquakes, ("earthquakes",), "rings",
               fit="all-layers", showcase=False),
        Report("rivers", "paths", "Rivers", "River systems", "Centrelines of the two highest display ranks.",
               ranked_rivers, ("major_rivers",), "paths", fit="all-layers", showcase=False),
    ]
}


def run_report(workspace, report_id: str):
    """Saves a report as a result and shows its scene."""
    report = REPORTS[report_id]
    frames = {name: workspace.catalog.frame(name) for name in report.relations}
    result = workspace.save_frame(report.build(frames), report.title, report.relations)
    return result, workspace.render_scene(report.scene(result.id))
