"""The workspace: datasets, guarded SQL, stored results with lineage, inspection and scenes."""

from __future__ import annotations

import os
import re
import time
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from functools import reduce
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from geoloom.functions.geo import as_number, focus_altitude, is_finite, quoted, relative_altitude
from geoloom.functions.roles import infer_roles
from geoloom.functions.text import SHORT_ITEMS, relation_name, row_label, short_text
from geoloom.functions.urls import clean_link_text
from geoloom.operators.closure import ancestors
from geoloom.operators.extent import extent
from geoloom.operators.layers import ROW_INDEX, Layer, layer_locations
from geoloom.operators.quality import count_mismatches
from geoloom.plans.guard import GuardedQuery, guard
from geoloom.plans.scenes import Scene, normalize_scene, scene_extent, scene_marks
from geoloom.plans.store import PLACE, StoredRows, store_rows
from geoloom.session import store
from geoloom.sources.catalog import Catalog, Dataset
from geoloom.sources.readers import file_bytes, format_of, from_records, read_csv, read_parquet

PAGE_SIZE = 10
PAGE_COLUMNS = 5
SAMPLE_ROWS = 5
SHORT_ROWS, SHORT_COLUMNS, SHORT_SCHEMA, SHORT_RESULTS = 2, 10, 12, 8
DETAIL_COLUMNS = 4
RESULT_FIELDS = ("id string, relation string, title string, sql string, row_count bigint, truncated boolean, "
                 "sources array<string>, actor string, created_at string")


@dataclass(frozen=True)
class Result:
    """A saved query result."""

    id: str
    relation: str
    title: str
    sql: str | None
    columns: tuple[str, ...]
    schema: tuple[tuple[str, str], ...]
    row_count: int
    truncated: bool
    sources: tuple[str, ...]
    created_at: str
    duration_ms: int
    actor: str


@dataclass(frozen=True)
class RelationInfo:
    """What :meth:`Workspace.inspect_relation` finds; ``sample`` is a DataFrame of 5 rows."""

    relation: str
    row_count: int
    schema: tuple[tuple[str, str, bool], ...]
    sample: DataFrame
    roles: dict
    provenance: Dataset | Result


class Workspace:
    """Names, results and the current scene of one session."""

    def __init__(self, spark: SparkSession, result_cap: int | None = None):
        """``result_cap`` bounds the rows of every result of this workspace; without it results are whole."""
        self.spark = spark
        self.catalog = Catalog(spark)
        self.result_cap = result_cap
        self.results: dict[str, Result] = {}
        self._frames: dict[str, DataFrame] = {}
        self._stored: dict[str, StoredRows] = {}
        self._sequence = 0
        self.scene: Scene | None = None
        self.active_result_id: str | None = None

    # Datasets

    def add_relation(self, name: str, load, **metadata) -> None:
        """Adds a relation that ``load()`` reads on first use."""
        self.catalog.add(Dataset(name, load, **metadata))

    def load_dataset(
        self, name: str, path: str | None = None, records: list[dict] | None = None, format: str | None = None,
        title: str | None = None, source_url: str | None = None, organization: str | None = None,
        license: str | None = None, max_bytes: int | None = None, multi_line: bool = False, **provenance,
    ) -> RelationInfo:
        """Adds a CSV or Parquet path, or up to 500 records. ``max_bytes`` refuses larger files; all rows are kept.
        Parquet is read where it lies, with the schema it has now; CSV, which cannot be pruned, is written once as
        Parquet. ``multi_line`` reads CSV cells with line breaks. ``provenance`` holds further fields of
        :class:`Dataset`, such as ``methodology``, ``caveats`` or ``sources``."""
        if (path is None or not path.strip()) == (records is None):
            raise ValueError("A dataset comes either from a path or from records.")
        relation = relation_name(name)
        if relation in self.catalog:
            raise ValueError(f"The name {relation} is taken; choose another one for this dataset.")
        place = None if path is None else path.split("?")[0]
        if place is not None and max_bytes is not None and file_bytes(self.spark, place) > max_bytes:
            raise ValueError(f"The files hold more than {max_bytes} bytes.")
        if records is not None:
            kept = from_records(self.spark, records)
        elif format_of(path, format) == "parquet":
            kept = read_parquet(self.spark, place)
        else:
            kept = None
        if kept is None:
            text = read_csv(self.spark, place, multi_line=multi_line)
            _refuse_duplicate_names(text.columns)
            kept = store(text, "dataset")
        _refuse_duplicate_names(kept.columns)
        inline = records is not None
        self.catalog.add(Dataset(
            relation, lambda: kept, kind="agent" if inline else "remote", title=title or relation,
            organization=organization or ("Supplied records" if inline else _place_of(path)),
            source_url=clean_link_text(source_url) or clean_link_text(path), license=license or "Not specified",
            retrieved=_now(), notes="Given as records; nobody has checked them." if inline else "Loaded from a path.",
            **provenance,
        ))
        return self.inspect_relation(relation)

    # SQL and results

    def execute_sql(self, sql: str, title: str = "SQL result", actor: str = "user") -> Result:
        """Runs one reading query and saves its rows, in order, as ``_result_NNNN``."""
        started = time.monotonic()
        query = self._guarded(sql)
        return self._save(self.spark.sql(query.sql), title, actor, query.sql, query.relations, started)

    def query(self, sql: str) -> DataFrame:
        """The same guarded query as a lazy DataFrame that is not saved."""
        return self.spark.sql(self._guarded(sql).sql)

    def _guarded(self, sql: str) -> GuardedQuery:
        query = guard(self.spark, sql, [*self.catalog.names(), *(r.relation for r in self.results.values())])
        for name in query.relations:
            if name in self.catalog:
                self.catalog.frame(name)
        return query

    def save_frame(self, df: DataFrame, title: str, sources: tuple[str, ...] = (), actor: str = "user") -> Result:
        """Saves a DataFrame, such as a named report, as a result."""
        return self._save(df, title, actor, None, sources, time.monotonic())

    def _save(self, df, title, actor, sql, sources, started) -> Result:
        """Stores rows in the order that the query gave them. A result is truncated if the cap cut it or anything it
        was read from."""
        _refuse_duplicate_names(df.columns)
        self._sequence += 1
        result_id = f"result_{self._sequence:04d}"
        rows, cut = store_rows(df, self.result_cap)
        self._stored[result_id] = rows
        parents = [r for r in self.results.values() if r.relation in sources]
        return self.register_result(
            rows.indexed(), rows.frame(), id=result_id, title=title, sql=sql, row_count=rows.rows,
            truncated=cut or any(r.truncated for r in parents), sources=tuple(sources), created_at=_now(),
            duration_ms=round((time.monotonic() - started) * 1000), actor=actor,
        )

    def rows_between(self, result_id: str, low: int, high: int) -> DataFrame:
        """Rows of a result, with their index, from ``low`` to ``high`` - 1."""
        result = self.result(result_id)
        if result.id in self._stored:
            return self._stored[result.id].between(low, high)
        return self._frames[result.id].where((F.col(ROW_INDEX) >= low) & (F.col(ROW_INDEX) < high))

    def register_result(self, indexed: DataFrame, plain: DataFrame | None = None, *, id: str, **fields) -> Result:
        """Registers rows that have a row index as the result ``id``, and ``plain`` (the same without the index) as
        the view ``_<id>``."""
        plain = indexed.drop(ROW_INDEX) if plain is None else plain
        schema = tuple((f.name, f.dataType.simpleString()) for f in plain.schema.fields)
        result = Result(id=id, relation=f"_{id}", columns=tuple(plain.columns), schema=schema, **fields)
        plain.createOrReplaceTempView(result.relation)
        self._frames[id] = indexed
        self.results[id] = result
        self.active_result_id = id
        return result

    def result(self, id_or_relation: str) -> Result:
        for result in self.results.values():
            if id_or_relation in (result.id, result.relation):
                return result
        raise KeyError(f"Unknown result {id_or_relation}.")

    def result_frame(self, result_id: str) -> DataFrame:
        """Rows of a result with ``_row_index``."""
        return self._frames[result_id]

    def results_frame(self) -> DataFrame:
        """Metadata of all results as a table; rows are counted where they are stored."""
        none = self.spark.createDataFrame([], RESULT_FIELDS)
        return reduce(DataFrame.unionByName, [self._described(r) for r in self.results.values()], none)

    def _described(self, r: Result) -> DataFrame:
        said = {"id": r.id, "relation": r.relation, "title": r.title, "sql": r.sql, "truncated": r.truncated,
                "actor": r.actor, "created_at": r.created_at}
        plain = self._stored[r.id].frame() if r.id in self._stored else self._frames[r.id]
        return plain.agg(F.count(F.lit(1)).alias("row_count")).select(
            "row_count", *[F.lit(v).alias(k) for k, v in said.items()],
            F.array(*[F.lit(s) for s in r.sources]).cast("array<string>").alias("sources"))

    def count_report(self) -> DataFrame:
        """Datasets whose stated row count differs from the counted one: (relation, rowCount, rows)."""
        stated = [(n, self.catalog.entry(n).row_count) for n in self.catalog.names()]
        said = self.spark.createDataFrame([x for x in stated if x[1] is not None], "relation string, rowCount bigint")
        return count_mismatches(said, self.relation_sizes().select("relation", "rows"))

    def provenance(self, result_id: str) -> dict:
        """Where a result comes from: its query, the catalog entries and results it was read from (also indirectly), and
        how the current scene shows it."""
        result = self.result(result_id)
        found, open_names = [], list(result.sources)
        while open_names:
            name = open_names.pop(0)
            if name not in found:
                found.append(name)
                open_names += next((r.sources for r in self.results.values() if r.relation == name), ())
        shown = [x for x in (self.scene.layers if self.scene else ()) if x.result_id == result.id]
        return {
            "result": result.id, "title": result.title, "sql": result.sql, "createdAt": result.created_at, "actor": result.actor,
            "rowCount": result.row_count, "truncated": result.truncated,
            "datasets": [_plain(self.catalog.entry(n)) for n in found if n in self.catalog],
            "results": [r.id for r in self.results.values() if r.relation in found],
            "scene": {"headline": self.scene.headline, "subheadline": self.scene.subheadline,
                      "layers": [{"id": x.id, "type": x.type, "title": x.title} for x in shown]} if shown else None,
        }

    def lineage(self) -> DataFrame:
        """One row per (result, parent): relations and earlier results that a result was read from."""
        edges = [(r.relation, parent) for r in self.results.values() for parent in r.sources]
        return self.spark.createDataFrame(edges, "result string, parent string")

    def ancestry(self) -> DataFrame:
        """All direct and indirect parents: (result, ancestor, distance), by the distance of the shortest way."""
        return ancestors(self.lineage(), "result").withColumnRenamed("node", "result")

    def page(self, result_id: str, page: int = 1, size: int = PAGE_SIZE, max_columns: int = PAGE_COLUMNS):
        """(rows of a 1-based page, page shown, number of pages); the page is clamped to the result."""
        result = self.result(result_id)
        pages = max(1, -(-result.row_count // size))
        shown = min(max(1, page), pages)
        start = (shown - 1) * size
        rows = self.rows_between(result.id, start, start + size)
        return rows.select(ROW_INDEX, *[quoted(c) for c in result.columns[:max_columns]]), shown, pages

    def present_result(self, result_id: str | None = None, page: int = 1, selected: int | None = None) -> dict:
        """Makes a result active, on a page or on the page of a selected row."""
        result = self.result(result_id or self.active_result_id or "")
        if page < 1 or (selected is not None and selected < 0):
            raise ValueError("page counts from 1 and selected from 0.")
        if selected is not None:
            if selected >= result.row_count:
                raise IndexError(f"Row {selected} was selected, but the result has {result.row_count}.")
            page = selected // PAGE_SIZE + 1
        self.active_result_id = result.id
        _, shown, _ = self.page(result.id, page)
        return {"resultId": result.id, "page": shown, "selectedIndex": selected}

    def row_detail(self, result_id: str, index: int) -> DataFrame:
        """Label, first four other columns, place in the result and focus of one row; empty past the end."""
        result = self.result(result_id)
        df = self.rows_between(result.id, index, index + 1)
        roles = self._roles_of(result)
        label, group = roles["label"], roles["group"]
        shown = [c for c in result.columns if c != label][:DETAIL_COLUMNS]
        fields = [F.struct(F.lit(c).alias("name"), quoted(c).cast("string").alias("value")) for c in shown]
        focus = F.lit(None).cast("struct<latitude: double, longitude: double, altitude: double>")
        if roles["latitude"] and roles["longitude"]:
            lat, lon = as_number(df, roles["latitude"]), as_number(df, roles["longitude"])
            altitude = as_number(df, roles["altitude"]) if roles["altitude"] else None
            point = F.struct(
                lat.alias("latitude"), lon.alias("longitude"),
                focus_altitude(relative_altitude(altitude, 0.0)).alias("altitude"),
            )
            focus = F.when(is_finite(lat) & is_finite(lon), point)
        return df.select(
            row_label(quoted(label) if label else None, quoted(group) if group else None).alias("label"),
            F.array(*fields).alias("fields"),
            F.concat(F.col(ROW_INDEX) + 1, F.lit(f" of {result.row_count}")).alias("position"), focus.alias("focus"),
        )

    def _roles_of(self, result: Result) -> dict:
        for layer in reversed(self.scene.layers if self.scene else ()):
            if layer.result_id == result.id:
                return layer.encoding
        return infer_roles(result.columns)

    # Inspection

    def inspect_relation(self, name: str) -> RelationInfo:
        """Schema, counted rows, first 5 rows, roles and provenance of a dataset or result."""
        found = next((r for r in self.results.values() if name in (r.id, r.relation)), None)
        cleaned = name.lower() if name in self.catalog else relation_name(name)
        if cleaned in self.catalog:
            df, provenance, relation = self.catalog.frame(cleaned), self.catalog.entry(cleaned), cleaned
            sample = df.limit(SAMPLE_ROWS)
            # Stated, or counted now and kept; the count of Parquet files comes from their footers.
            rows = provenance.row_count
            if rows is None:
                rows = df.count()
                self.catalog.set_row_count(cleaned, rows)
                provenance = self.catalog.entry(cleaned)
        elif found is not None:
            df, provenance, relation = self._frames[found.id].drop(ROW_INDEX), found, found.relation
            rows, sample = found.row_count, self.rows_between(found.id, 0, SAMPLE_ROWS).drop(ROW_INDEX)
        else:
            raise KeyError(f"Unknown relation {name}.")
        schema = tuple((f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields)
        return RelationInfo(relation, rows, schema, sample, infer_roles(df.columns), provenance)

    def relation_sizes(self) -> DataFrame:
        """Rows and columns of every dataset, in one query."""
        return self._sizes(self.catalog.names())

    def _sizes(self, names: list[str]) -> DataFrame:
        frames = [(name, self.catalog.frame(name)) for name in names]
        return reduce(DataFrame.unionByName, [df.agg(
            F.lit(name).alias("relation"), F.count(F.lit(1)).alias("rows"),
            F.lit(len(df.columns)).cast("bigint").alias("columns")) for name, df in frames])

    def compact_relation(self, name: str) -> dict:
        """The same, short enough for a message: 2 rows, 10 columns with roles first, 12 schema fields."""
        info = self.inspect_relation(name)
        return {
            "relation": info.relation, "rowCount": info.row_count, "schema": list(info.schema[:SHORT_SCHEMA]),
            "schemaTruncated": len(info.schema) > SHORT_SCHEMA, "roles": info.roles,
            "sample": compact_sample(info.sample, info.roles),
            "provenance": {k: v for k, v in _plain(info.provenance).items() if k not in ("columns", "schema")},
        }

    def inspect_workspace(self) -> DataFrame:
        """Datasets, results and the scene's layers in one table; the last 8 results are marked as recent. Rows of
        results and of datasets that have been read are counted."""
        entries = [self.catalog.entry(n) for n in self.catalog.names()]
        rows = [("dataset", d.relation, d.relation, d.row_count, self.catalog.is_loaded(d.relation), d.title, [], True,
                 False) for d in entries]
        recent = list(self.results)[-SHORT_RESULTS:]
        rows += [("layer", x.id, f"_{x.result_id}", None, True, x.title, [x.result_id], True,
                  x.result_id == self.active_result_id) for x in (self.scene.layers if self.scene else ())]
        listed = self.spark.createDataFrame(
            rows, "kind string, id string, relation string, stated bigint, loaded boolean, title string, "
            "sources array<string>, recent boolean, active boolean")
        loaded = [d.relation for d in entries if self.catalog.is_loaded(d.relation)]
        counted = self._sizes(loaded).select("relation", "rows") if loaded else self.spark.createDataFrame([], "relation string, rows bigint")
        # One row per dataset on either side.
        listed = listed.join(F.broadcast(counted), "relation", "left").withColumn("rows", F.coalesce("rows", "stated")).drop("stated")
        results = self.results_frame().select(
            F.lit("result").alias("kind"), "id", "relation", F.col("row_count").alias("rows"), F.lit(True).alias("loaded"),
            "title", "sources", F.col("id").isin(recent).alias("recent"), F.col("id").eqNullSafe(F.lit(self.active_result_id)).alias("active"))
        return listed.unionByName(results)

    def layer_columns(self) -> tuple[DataFrame, DataFrame]:
        """The scene's layer mappings and the results' columns as tables, for the integrity check."""
        layers = [(layer.id, layer.result_id, role, column) for layer in (self.scene.layers if self.scene else ())
                  for role, column in layer.encoding.items()]
        columns = [(r.id, c) for r in self.results.values() for c in r.columns]
        return (
            self.spark.createDataFrame(layers, "layer_id string, result_id string, role string, column_name string"),
            self.spark.createDataFrame(columns, "result_id string, column_name string"),
        )

    # Scenes

    def render_scene(self, spec: dict, actor: str = "user") -> Scene:
        """Checks and keeps a scene; its last layer's result becomes the active one."""
        scene = normalize_scene(
            spec, lambda rid: list(self.results[rid].columns) if rid in self.results else None, actor
        )
        self.scene = scene
        self.active_result_id = scene.active_result_id
        return scene

    def marks(self) -> DataFrame:
        """Marks of the current scene."""
        return scene_marks(self.scene, self.result_frame)

    def camera(self) -> DataFrame | None:
        """Extent the current scene's camera fits."""
        return scene_extent(self.scene, self.result_frame)

    def active_extent(self) -> DataFrame | None:
        """Extent of the active result, by its layer or by inferred roles; None without coordinates."""
        result = self.result(self.active_result_id)
        layer = next((x for x in reversed(self.scene.layers if self.scene else ()) if x.result_id == result.id), None)
        if layer is None:
            layer = Layer("active", "points", infer_roles(result.columns), result_id=result.id)
        if layer.type != "polygons" and not (layer.encoding["latitude"] and layer.encoding["longitude"]):
            return None
        return extent(layer_locations(self._frames[result.id], layer))


def compact_sample(df: DataFrame, roles: dict) -> DataFrame:
    """2 rows of at most 10 columns, role columns first, with long text and arrays cut."""
    first = [roles[r] for r in ("label", "latitude", "longitude", "altitude", "geometry", "group", "order", "size")]
    names = list(dict.fromkeys([*[c for c in first if c], *df.columns]))[:SHORT_COLUMNS]
    return compact_values(df.limit(SHORT_ROWS).select(*[quoted(n) for n in names]))


def compact_values(df: DataFrame) -> DataFrame:
    """All rows with long text, arrays and structs cut."""
    return df.select(*[_compact(quoted(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def _compact(value, dtype: T.DataType):
    if isinstance(dtype, T.StringType):
        return short_text(value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(F.slice(value, 1, SHORT_ITEMS), lambda x: _compact(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        kept = dtype.fields[:SHORT_ITEMS]
        return F.when(value.isNotNull(), F.struct(*[_compact(value[f.name], f.dataType).alias(f.name) for f in kept]))
    return value


def _plain(provenance: Dataset | Result) -> dict:
    if isinstance(provenance, Result):
        return asdict(provenance)
    return {k: v for k, v in vars(provenance).items() if k != "load"}


def _refuse_duplicate_names(columns: list[str]) -> None:
    lower = [c.lower() for c in columns]
    repeated = sorted({c for c in columns if lower.count(c.lower()) > 1})
    if repeated:
        raise ValueError(f"Give each output column its own name; repeated: {', '.join(repeated)}.")
    for reserved in (ROW_INDEX, PLACE):
        if reserved in lower:
            raise ValueError(f"{reserved} is a reserved column name.")


def _place_of(path: str) -> str:
    return urlsplit(path).hostname or os.path.basename(re.sub(r"/+\Z", "", path.split("?")[0]))


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds")
