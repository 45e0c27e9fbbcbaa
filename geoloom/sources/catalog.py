"""Catalog of relations that are read on first use, and the typed relations of the bundled files."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.functions.text import float_key_text, relation_name
from geoloom.functions.times import days_after
from geoloom.sources.readers import read_csv, read_parquet

# File of each bundled relation.
RELATION_FILES = {
    "drifter_loopers": "drifter-loopers.csv",
    "atlantic_storms": "atlantic-storms.csv",
    "country_boundaries": "country-boundaries.csv",
    "earthquakes": "earthquakes.parquet",
    "tsunami_events": "tsunami-events.parquet",
    "tsunami_runups": "tsunami-runups.parquet",
    "us_tornado_tracks": "us-tornado-tracks.parquet",
    "major_rivers": "major-rivers.parquet",
    "global_chains": "global-chains.parquet",
    "theme_parks_landmarks": "theme-parks-landmarks.parquet",
}
DRIFTER_SCHEMA = (
    "id double, latitude double, longitude double, period double, persist double, radius double, "
    "drogue int, t double, u double, v double"
)
STORM_COLUMNS = [
    "sid", "season", "name", "iso_time", "nature", "latitude", "longitude", "wind_kts", "pressure_mb",
]


def typed_drifters(df: DataFrame) -> DataFrame:
    """Id as plain decimal text, and the observation time from its days since 1979."""
    return df.withColumn("id", float_key_text(F.col("id"))).withColumn(
        "observed_at", days_after("1979-01-01", F.col("t"))
    )


def typed_storms(df: DataFrame) -> DataFrame:
    """Nine columns with the time as a timestamp."""
    return typed_time(df, "iso_time").select(*STORM_COLUMNS)


def typed_time(df: DataFrame, name: str) -> DataFrame:
    """Replaces one column with its value as a timestamp and keeps the rest."""
    return df.withColumn(name, F.col(name).cast("timestamp_ntz"))


def bundled_loaders(spark: SparkSession, base: str) -> dict[str, Callable[[], DataFrame]]:
    """Loader per bundled relation over the files below ``base``."""

    def at(relation: str) -> str:
        return f"{base.rstrip('/')}/{RELATION_FILES[relation]}"

    def plain(relation: str) -> DataFrame:
        path = at(relation)
        return read_parquet(spark, path) if path.endswith(".parquet") else read_csv(spark, path)

    loaders = {name: (lambda name=name: plain(name)) for name in RELATION_FILES}
    loaders["drifter_loopers"] = lambda: typed_drifters(read_csv(spark, at("drifter_loopers"), DRIFTER_SCHEMA))
    loaders["atlantic_storms"] = lambda: typed_storms(plain("atlantic_storms"))
    loaders["earthquakes"] = lambda: typed_time(plain("earthquakes"), "observed_at")
    loaders["us_tornado_tracks"] = lambda: typed_time(plain("us_tornado_tracks"), "observed_at")
    return loaders


@dataclass(frozen=True)
class Dataset:
    """Catalog entry: how to read a relation, and where it comes from."""

    relation: str
    load: Callable[[], DataFrame] = field(repr=False)
    kind: str = "built-in"
    row_count: int | None = None
    title: str | None = None
    description: str | None = None
    organization: str | None = None
    source_url: str | None = None
    license: str | None = None
    retrieved: str | None = None
    notes: str | None = None
    download_url: str | None = None
    license_url: str | None = None
    methodology: str | None = None
    caveats: str | None = None
    snapshot_id: str | None = None
    sha256: str | None = None
    #: What the relation was made from: (id, title, url) each.
    sources: tuple[tuple[str, str, str], ...] = ()


class Catalog:
    """Names to relations. Each is read once, on first use, also when asked for concurrently."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._datasets: dict[str, Dataset] = {}
        self._frames: dict[str, DataFrame] = {}
        self._locks: dict[str, threading.Lock] = {}
        self._guard = threading.Lock()

    def add(self, dataset: Dataset) -> None:
        if relation_name(dataset.relation) != dataset.relation:
            raise ValueError(f"{dataset.relation!r} is not a normalised relation name.")
        with self._guard:
            if dataset.relation in self._datasets:
                raise ValueError(f"The name {dataset.relation} is taken by another dataset.")
            self._datasets[dataset.relation] = dataset
            self._locks[dataset.relation] = threading.Lock()

    def names(self) -> list[str]:
        return list(self._datasets)

    def entry(self, name: str) -> Dataset:
        return self._datasets[name.lower()]

    def __contains__(self, name: str) -> bool:
        return name.lower() in self._datasets

    def is_loaded(self, name: str) -> bool:
        return name.lower() in self._frames

    def frame(self, name: str) -> DataFrame:
        """The relation's DataFrame, registered as a view of its name on first use."""
        name = name.lower()
        with self._locks[name]:
            if name not in self._frames:
                df = self._datasets[name].load()
                df.createOrReplaceTempView(name)
                self._frames[name] = df
        return self._frames[name]

    def set_row_count(self, name: str, rows: int) -> None:
        self._datasets[name] = replace(self._datasets[name], row_count=rows)
