"""Scene snapshots: the rows of every result as Parquet, beside one small metadata row.

A snapshot is a folder: ``rows/<run>/<result>`` holds each result's rows with their index, ``meta`` one JSON record with
scenes and results, which names these folders. The record is written last, so a snapshot is there when its rows are,
and one that is written again points to its old rows until the new ones are complete. Documents that hold rows and
metadata in one JSON text are read as well.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from geoloom.operators.layers import ROW_INDEX

VERSION = 2

# Type names inside a snapshot.
TYPE_NAMES = {
    "string": "Utf8", "double": "Float64", "float": "Float32", "bigint": "Int64", "int": "Int32",
    "smallint": "Int16", "tinyint": "Int8", "boolean": "Bool", "timestamp_ntz": "Timestamp<MICROSECOND>",
    "timestamp": "Timestamp<MICROSECOND>", "date": "Date32<DAY>",
}
SPARK_TYPES = {
    "Utf8": "string", "Float64": "double", "Float32": "float", "Int64": "bigint", "Int32": "int", "Int16": "smallint",
    "Int8": "tinyint", "Bool": "boolean", "Timestamp<MICROSECOND>": "timestamp_ntz", "Date32<DAY>": "date",
}

STYLE = "struct<color: string, opacity: double, width: double, radius: double, animate: boolean>"
SCENE = (
    "struct<id: string, headline: string, subheadline: string, layers: array<struct<id: string, type: string, "
    f"title: string, style: {STYLE}, resultId: string>>, camera: struct<fit: string, layerId: string>>"
)
DOCUMENT = (
    f"version int, generatedAt string, defaultSceneId string, scene {SCENE}, scenes array<{SCENE}>, "
    "results array<struct<id: string, relation: string, title: string, sql: string, columns: array<string>, "
    "schema: array<struct<name: string, type: string>>, rows: array<string>, rowsPath: string, rowCount: bigint, truncated: boolean, "
    "sources: array<string>, durationMs: bigint, actor: string>>"
)


def _place(snapshot: str, run: str, result_id: str) -> str:
    return f"{snapshot}/rows/{run}/{result_id}"


def write_snapshot(workspace, out: str, scene_id: str, spec: dict, results: dict[str, str], snapshot_date: str) -> str:
    """Writes the snapshot of one scene to ``out/<scene id>`` and returns that path.

    ``results`` maps a saved result id to the id it has in the snapshot. Nothing that is read back depends on the
    clock: the time stamp is the catalog's latest retrieval date and durations are 0.
    """
    path, run = f"{out.rstrip('/')}/{scene_id}", uuid.uuid4().hex
    scene = {"id": scene_id, **spec, "layers": [
        {**layer, "resultId": results[layer["resultId"]]} for layer in spec["layers"]
    ]}
    entries = []
    for saved_id, snapshot_id in results.items():
        result = workspace.result(saved_id)
        workspace.result_frame(saved_id).write.parquet(_place(path, run, snapshot_id))
        entries.append({
            "id": snapshot_id, "relation": f"_{snapshot_id}", "title": result.title, "sql": result.sql,
            "columns": list(result.columns), "rowsPath": f"rows/{run}/{snapshot_id}", "rowCount": result.row_count,
            "schema": [{"name": n, "type": TYPE_NAMES.get(t, t)} for n, t in result.schema],
            "truncated": result.truncated, "sources": list(result.sources), "durationMs": 0, "actor": "snapshot",
        })
    record = {
        "version": VERSION, "generatedAt": f"{snapshot_date}T00:00:00.000Z", "defaultSceneId": scene_id,
        "scene": scene, "scenes": [scene], "results": entries,
    }
    meta = workspace.spark.range(1).select(F.from_json(F.lit(json.dumps(record)), DOCUMENT).alias("d")).select("d.*")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return path


def build_snapshots(workspace, out: str, reports, snapshot_date: str) -> list[str]:
    """Runs reports over the workspace's relations and writes one snapshot for each."""
    paths = []
    for report in reports:
        frames = {name: workspace.catalog.frame(name) for name in report.relations}
        saved = workspace.save_frame(report.build(frames), report.title, report.relations)
        named = {saved.id: f"bootstrap_{report.id}_{report.query_id}"}
        paths.append(write_snapshot(workspace, out, report.id, report.scene(saved.id), named, snapshot_date))
    return paths


def read_snapshots(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Metadata of one or more snapshots, and the folder each lies in (``base``). Rows of a document that holds them
    stay JSON text, one value per row."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    base = F.regexp_replace(F.col("_metadata.file_path"), r"/meta/[^/]*\z", "")
    return files.text(path).select(F.from_json("value", DOCUMENT).alias("d"), base.alias("base")).select("d.*", "base")


def stored_counts(documents: DataFrame) -> DataFrame:
    """(rowsPath, base, rows, in_order) of the results with rows of their own: counted rows, and whether their indexes
    are 0 onwards without gaps."""
    spark = documents.sparkSession
    places = documents.select("base", F.explode("results.rowsPath").alias("rowsPath")).where("rowsPath IS NOT NULL")
    held = [f"{r['base']}/{r['rowsPath']}" for r in places.collect()]  # a few paths per scene
    if not held:
        return spark.createDataFrame([], "base string, rowsPath string, rows long, in_order boolean")
    rows = spark.read.schema(f"{ROW_INDEX} long").option("recursiveFileLookup", True).parquet(*held)
    folder = F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*\z", "")
    n, at = F.count(F.lit(1)), F.col(ROW_INDEX)
    counted = rows.groupBy(folder.alias("folder")).agg(
        n.alias("rows"), ((F.min(at) == 0) & (F.max(at) == n - 1) & (F.sum(at) == n * (n - 1) / 2)).alias("in_order"))
    return counted.select(
        F.regexp_extract("folder", r"\A(.*)/(rows/[^/]*/[^/]*)\z", 1).alias("base"),
        F.regexp_extract("folder", r"\A(.*)/(rows/[^/]*/[^/]*)\z", 2).alias("rowsPath"), "rows", "in_order")


def snapshot_rows(documents: DataFrame, result_id: str, schema: list[tuple[str, str]]) -> DataFrame:
    """Typed rows of one result with their row index; ``schema`` has the snapshot's type names."""
    read_as = []
    for name, kind in schema:
        spark_type = SPARK_TYPES.get(kind, "string")
        read_as.append(T.StructField(name, T.StringType() if spark_type in ("timestamp_ntz", "date") else
                                     T._parse_datatype_string(spark_type)))
    rows = documents.select(F.explode("results").alias("r")).where(F.col("r.id") == result_id).select(
        F.posexplode("r.rows").alias(ROW_INDEX, "row")
    )
    parsed = rows.select(F.col(ROW_INDEX).cast("bigint"), F.from_json("row", T.StructType(read_as)).alias("v"))
    cells = [F.col("v").getField(n).cast(SPARK_TYPES.get(k, "string")).alias(n) for n, k in schema]
    return parsed.select(ROW_INDEX, *cells)


def load_snapshot(workspace, path: str, show: bool = True):
    """Registers the results of a snapshot as queryable results and shows its scene.

    Metadata (at most 8 results and their columns) comes to the driver; rows do not.
    """
    documents = read_snapshots(workspace.spark, path)
    heads = documents.select(
        "base", "generatedAt", "scene", F.transform("results", lambda r: r.dropFields("rows")).alias("results"))
    scene = None
    for head in heads.collect():
        scene = head["scene"]
        for r in head["results"]:
            rows = workspace.spark.read.parquet(f"{head['base']}/{r['rowsPath']}") if r["rowsPath"] else snapshot_rows(
                documents, r["id"], [(f["name"], f["type"]) for f in r["schema"]])
            workspace.register_result(
                rows, id=r["id"], title=r["title"], sql=r["sql"], row_count=r["rowCount"],
                truncated=bool(r["truncated"]), sources=tuple(r["sources"] or ()), created_at=head["generatedAt"],
                duration_ms=r["durationMs"] or 0, actor=r["actor"],
            )
    if not show or scene is None:
        return None
    layers = []
    for layer in scene["layers"]:
        kept = {k: v for k, v in layer.asDict(recursive=True).items() if v is not None}
        if "style" in kept:
            kept["style"] = {k: v for k, v in kept["style"].items() if v is not None}
        layers.append(kept)
    camera = {k: v for k, v in (scene["camera"].asDict() if scene["camera"] else {}).items() if v is not None}
    return workspace.render_scene(
        {"headline": scene["headline"], "subheadline": scene["subheadline"], "layers": layers, "camera": camera}
    )


def snapshot_contract(documents: DataFrame) -> DataFrame:
    """One row per snapshot with its rule results and whether all hold. Rows are counted where they lie."""
    result_ids = F.transform("results", lambda r: r["id"])
    linked = F.forall(F.col("scene.layers"), lambda layer: F.array_contains(result_ids, layer["resultId"]))
    results = documents.select("base", F.explode("results").alias("r")).select("base", "r.rowsPath", F.col("r")).join(
        stored_counts(documents), ["base", "rowsPath"], "left")
    rows = F.coalesce("rows", F.when(F.col("rowsPath").isNull(), F.size("r.rows")), F.lit(0))
    sound = (rows > 0) & (rows == F.col("r.rowCount")) & (F.size("r.columns") > 0) & F.coalesce("in_order", F.lit(True))
    per_snapshot = results.groupBy("base").agg(F.min(F.coalesce(sound, F.lit(False))).alias("results_sound"))
    rules = {
        "version_ok": F.col("version") == VERSION,
        "ids_agree": (F.col("defaultSceneId") == F.col("scene.id")) & (F.get("scenes", 0)["id"] == F.col("scene.id"))
        & (F.size("scenes") == 1),
        "one_layer": F.size("scene.layers") == 1,
        "one_result": F.size("results") == 1,
        "layers_linked": linked,
        "results_sound": F.col("results_sound"),
    }
    checked = documents.join(per_snapshot, "base", "left").select(
        "defaultSceneId", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in rules.items()])
    every = F.lit(True)
    for name in rules:
        every = every & F.col(name)
    return checked.withColumn("passed", every)
