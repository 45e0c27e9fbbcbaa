import hashlib
import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from geoloom.operators import prep
from geoloom.operators.quality import (
    COVERAGE_RULES, broken_layers, check_rules, count_mismatches, coverage_metrics, list_differences, missing_metadata,
)
from geoloom.plans import reports
from geoloom.plans.workspace import Workspace
from geoloom.session import isolated_session, scratch_path, shared_dir
from geoloom.sources.catalog import RELATION_FILES, bundled_loaders
from geoloom.sources.digest import digest_mismatches, directory_fingerprint, file_digests
from geoloom.sources.manifest import latest_retrieval, manifest_sources, read_manifest
from geoloom.sources.readers import from_records, read_csv, read_csv_text
from geoloom.sources.snapshots import build_snapshots, load_snapshot, read_snapshots, snapshot_contract, write_snapshot
from tests.conftest import values


def write_relations(spark, base):
    """Small files of the ten relations, with rows on both sides of every report's filters."""
    rnd = random.Random(11)
    drift = ["id,latitude,longitude,period,persist,radius,drogue,t,u,v"]
    for k in range(30):
        for i in range(rnd.randrange(3, 9)):
            drift.append(f"{300234062328360.0 + k},{20 + rnd.random() * 20:.4f},{-60 + rnd.random() * 20:.4f},5.5,"
                         f"{100 + rnd.random() * 150:.3f},{rnd.randrange(10000, 60000)},{rnd.randrange(2)},{12000 + i / 4},0.1,0.2")
    (base / "drifter-loopers.csv").write_text("\n".join(drift) + "\n")
    storms = ["sid,season,name,iso_time,nature,latitude,longitude,wind_kts,pressure_mb,extra"]
    for k in range(12):
        for i in range(8):
            at = datetime(2011, 11, 8) + timedelta(hours=6 * i) if k < 6 else datetime(2025, 9, 1) + timedelta(hours=6 * i)
            storms.append(f"AL{k:02d},{at.year},{'UNNAMED' if k % 5 == 0 else f'STORM{k}'},{at:%Y-%m-%d %H:%M:%S},TS,"
                          f"{20 + rnd.random() * 20:.3f},{-60 + rnd.random() * 20:.3f},{rnd.randrange(30, 120)},{990 + i},z")
    (base / "atlantic-storms.csv").write_text("\n".join(storms) + "\n")
    square = json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [5, 0], [5, 5], [0, 0]]]}).replace('"', '""')
    lines = ["country_id,name,center_latitude,center_longitude,area_km2,geometry_geojson"]
    lines += [f'{i},{n},1.5,2.5,100.5,"{square}"' for i, n in enumerate([*reports.COUNTRY_NAMES, "Spain"])]
    (base / "country-boundaries.csv").write_text("\n".join(lines) + "\n")

    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(base / RELATION_FILES[name]))

    quakes = [(f"q{i}", f"{1900 + i}-02-03T04:05:06.789", f"place {i}", 10.0 + i, 20.0, 6.0 + i / 10, 33.0, i % 2 == 0, 1900 + i) for i in range(30)]
    save("earthquakes", quakes, "event_id string, observed_at string, place string, latitude double, longitude double, "
         "magnitude double, depth_km double, tsunami_flag boolean, year int")
    tsunamis = [(i, -2000 + 500 * i, 1, 2, f"loc {i}", "X", 1.0 * i, 2.0 * i, 3.0 * i, "earthquake", "definite" if i % 2 else "probable") for i in range(8)]
    save("tsunami_events", tsunamis, "tsunami_id int, year int, month int, day int, location_name string, country string, "
         "latitude double, longitude double, maximum_water_height_m double, cause string, validity string")
    save("tsunami_runups", [(i, i % 8) for i in range(20)], "runup_id int, tsunami_id int")
    save("us_tornado_tracks", [(i // 2, i % 2, "1950-01-03T11:00:00", 30.0 + i, -90.0) for i in range(10)],
         "tornado_id int, point_order int, observed_at string, latitude double, longitude double")
    rivers = [(s, i, n, 1.0 * i, 2.0, r) for s, (n, r) in enumerate([("Nile", 1), ("Danube", 3), ("Other", 2)]) for i in range(12)]
    save("major_rivers", rivers, "segment_id int, point_order int, name string, latitude double, longitude double, scalerank int")
    chains = [(f"p{i:03d}", ["McDonald's", "Starbucks", "IKEA"][i % 3], ["AA", "BB", None][i % 5 % 3], rnd.random(), 1.0 * i, 2.0) for i in range(90)]
    save("global_chains", chains, "place_id string, brand string, country string, confidence double, latitude double, longitude double")
    parks = [(f"Q{i}", f"park {i}", "C", "theme park" if i % 3 else "UNESCO heritage landmark", 1.0 * i, 2.0, 1000 - i) for i in range(900)]
    save("theme_parks_landmarks", parks, "place_id string, name string, country string, category string, latitude double, "
         "longitude double, sitelinks bigint")


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bundled")
    write_relations(spark, folder)
    return folder


@pytest.fixture
def ws(spark, base):
    workspace = Workspace(isolated_session(spark))
    for name, load in bundled_loaders(workspace.spark, str(base)).items():
        workspace.add_relation(name, load)
    return workspace


def test_typed_relations(ws):
    drifters = ws.catalog.frame("drifter_loopers")
    assert drifters.first()["id"] == "300234062328360.0" and str(drifters.agg(F.min("observed_at")).first()[0]) == "2011-11-09 00:00:00"
    assert ws.catalog.frame("atlantic_storms").columns[-1] == "pressure_mb"
    assert dict(ws.catalog.frame("atlantic_storms").dtypes)["iso_time"] == "timestamp_ntz"
    quakes = ws.catalog.frame("earthquakes")
    assert dict(quakes.dtypes)["observed_at"] == "timestamp_ntz" and len(quakes.columns) == 9


@pytest.mark.parametrize("report_id", list(reports.REPORTS))
def test_reports_and_their_scenes(ws, report_id):
    result, scene = reports.run_report(ws, report_id)
    assert result.row_count > 0 and scene.layers[0].type == reports.REPORTS[report_id].layer_type
    marks = ws.marks()
    assert marks.count() == result.row_count
    if report_id == "mcdonalds":
        per_country = ws.result_frame(result.id).groupBy("country").count().collect()
        assert {r["count"] for r in per_country} <= {1, 2, 3, 4, 5} and all(r["country"] for r in per_country)
    if report_id == "heritage_landmarks":
        assert result.row_count == 260
    if report_id == "ocean_loops":
        assert result.row_count <= 24
    if report_id == "countries":
        assert result.row_count == 6
    if report_id == "major_rivers":
        got = values(ws.result_frame(result.id).where("segment_id = 0").orderBy("point_order"), "point_order")
        assert got == [(0,), (4,), (9,), (11,)]


def test_report_equals_plain_sql(ws):
    """The loops report against the same question as one SQL text."""
    result, _ = reports.run_report(ws, "ocean_loops")
    plain = ws.query("""SELECT id, round(avg(latitude), 3) AS latitude, round(max(persist), 1) AS persistence_days,
        round(median(radius) / 1000, 1) AS radius_km, count(*) AS observations FROM drifter_loopers WHERE drogue = 1 GROUP BY id
        ORDER BY persistence_days DESC, id LIMIT 24""")
    assert sorted(values(ws.result_frame(result.id), *plain.columns)) == sorted(values(plain))


def test_coverage(ws):
    frames = {name: ws.catalog.frame(name) for name in RELATION_FILES}
    checked = {r["metric"]: r for r in check_rules(coverage_metrics(frames), COVERAGE_RULES).collect()}
    assert len(checked) == len(COVERAGE_RULES)
    assert checked["first_earthquake_year"]["passed"] and checked["first_earthquake_year"]["value"] == 1900
    assert not checked["countries"]["passed"] and checked["countries"]["value"] == 7
    missing = check_rules(coverage_metrics(frames), [("unknown", ">=", 0)]).first()
    assert missing["passed"] is False and missing["value"] is None


def test_snapshots_build_replay_and_contract(ws, spark):
    out = scratch_path(spark, "scenes")
    shown = [r for r in reports.REPORTS.values() if r.showcase]
    paths = build_snapshots(ws, out, shown, "2026-09-03")
    documents = read_snapshots(spark, out)
    checked = snapshot_contract(documents)
    assert checked.count() == len(shown) == 10 and checked.where("NOT passed").count() == 0
    assert documents.select("generatedAt").distinct().collect() == [("2026-09-03T00:00:00.000Z",)]
    replay = Workspace(isolated_session(spark))
    for path in paths:
        scene = load_snapshot(replay, path)
        saved = next(r for r in ws.results.values() if r.title == scene.layers[0].title)
        rows = replay.result_frame(scene.layers[0].result_id)
        original = ws.result_frame(saved.id)
        assert sorted(values(rows, *original.columns), key=str) == sorted(values(original), key=str)
        assert dict(rows.dtypes) == dict(original.dtypes)
    assert replay.execute_sql("select count(*) as n from _bootstrap_ikea_locations").sources == ("_bootstrap_ikea_locations",)


def test_snapshot_rows_lie_in_files_of_their_own(spark, tmp_path):
    """Many rows, no value that holds more than one, and a contract that notices lost and doubled rows."""
    ws = Workspace(isolated_session(spark))
    saved = ws.execute_sql("select id, id * 0.5D as latitude, 1.0D as longitude, array(id) as a, timestamp_ntz '2024-01-01 00:00:00' as t from range(0, 30000, 1, 4)")
    spec = {"headline": "h", "subheadline": "s", "layers": [{"id": "l", "resultId": saved.id}], "camera": {"fit": "none"}}
    path = write_snapshot(ws, str(tmp_path), "many", spec, {saved.id: "r"}, "2026-09-03")
    documents = read_snapshots(spark, path)
    assert documents.where("exists(results, r -> r.rows is not null)").count() == 0
    assert snapshot_contract(documents).first()["passed"]
    replay = Workspace(isolated_session(spark))
    load_snapshot(replay, path)
    assert replay.query("select sum(id) from _r").first()[0] == 30000 * 29999 // 2
    assert replay.page("r", 3)[0].columns == ["_row_index", "id", "latitude", "longitude", "a", "t"]
    assert sorted(values(replay.page("r", 3)[0], "id")) == [(i,) for i in range(20, 30)]
    again = write_snapshot(ws, str(tmp_path), "many", spec, {saved.id: "r"}, "2026-09-03")
    assert again == path and read_snapshots(spark, path).count() == 1 and len(list((tmp_path / "many" / "rows").iterdir())) == 2
    current = read_snapshots(spark, path).select(F.get("results", 0)["rowsPath"]).first()[0]
    parts = sorted((tmp_path / "many" / current).glob("part-*"))
    parts[0].rename(parts[0].with_name("_hidden"))
    assert not snapshot_contract(read_snapshots(spark, path)).first()["results_sound"]
    extra = spark.read.parquet(str(tmp_path / "many" / current)).limit(7500)
    extra.write.mode("append").parquet(str(tmp_path / "many" / current))
    assert not snapshot_contract(read_snapshots(spark, path)).first()["results_sound"]


def test_broken_snapshots_fail_the_contract(spark, tmp_path):
    layer = {"id": "a", "type": "points", "title": "t", "resultId": "r"}
    scene = {"id": "s", "headline": "h", "subheadline": "s", "layers": [layer], "camera": {"fit": "none"}}
    result = {"id": "r", "columns": ["x"], "schema": [{"name": "x", "type": "Int64"}], "rows": [{"x": 1}], "rowCount": 1}
    good = {"version": 2, "generatedAt": "d", "defaultSceneId": "s", "scene": scene, "scenes": [scene], "results": [result]}
    variants = {
        "good": good, "version": {**good, "version": 1}, "missing": {**good, "results": []},
        "count": {**good, "results": [{**result, "rowCount": 2}]}, "id": {**good, "defaultSceneId": "z"},
        "link": {**good, "results": [{**result, "id": "q"}]},
    }
    passed = {}
    for name, document in variants.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(document))
        passed[name] = snapshot_contract(read_snapshots(spark, str(tmp_path / f"{name}.json"))).first()["passed"]
    assert passed == {"good": True, "version": False, "missing": False, "count": False, "id": False, "link": False}


def test_manifest(spark, tmp_path):
    entries = [
        {"relation": "a", "rowCount": 2, "description": "d", "license": "l", "sourceUrl": "https://a.org", "retrieved": "2026-01-02",
         "sources": [{"id": "1", "title": "t", "url": "https://a.org"}, {"id": "2", "title": "u", "url": "https://b.org"}]},
        {"relation": "b", "rowCount": 5, "description": "", "sourceUrl": "https://b.org", "retrieved": "2026-03-04"},
    ]
    (tmp_path / "m.json").write_text(json.dumps(entries))
    manifest = read_manifest(spark, str(tmp_path / "m.json"))
    assert manifest_sources(manifest).count() == 3
    assert latest_retrieval(manifest).first()[0] == "2026-03-04"
    assert values(missing_metadata(manifest, ["description", "license", "sourceUrl"])) == [("b", ["description", "license"])]
    counted = spark.createDataFrame([("a", 2), ("b", 6)], "relation string, rows bigint")
    assert values(count_mismatches(manifest, counted)) == [("b", 5, 6)]
    listed = spark.createDataFrame([(0, "a"), (1, "b")], "position int, relation string")
    wanted = spark.createDataFrame([(0, "a"), (1, "c"), (2, "d")], "position int, relation string")
    assert sorted(values(list_differences(listed, wanted, "relation"))) == [(1, "b", "c"), (2, None, "d")]


def test_broken_layers(spark):
    layers = spark.createDataFrame([("l1", "r1", "latitude", "lat"), ("l1", "r1", "label", "gone"), ("l1", "r1", "size", None),
                                    ("l2", "r9", "latitude", "lat")], "layer_id string, result_id string, role string, column_name string")
    columns = spark.createDataFrame([("r1", "lat"), ("r1", "lon")], "result_id string, column_name string")
    got = sorted(values(broken_layers(layers, columns), "layer_id", "role", "problem"), key=str)
    assert got == sorted([("l1", "label", "missing column"), ("l2", None, "missing result")], key=str)


def test_digests(spark, tmp_path):
    for name, data in {"a.txt": b"one", "sub/b.bin": b"two" * 1000, "c.txt": b"c"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    digests = file_digests(spark, str(tmp_path))
    got = {os.path.basename(r["path"]): r["sha256"] for r in digests.collect()}
    assert got["b.bin"] == hashlib.sha256(b"two" * 1000).hexdigest() and len(got) == 3
    expected = spark.createDataFrame([("a.txt", got["a.txt"]), ("b.bin", "0"), ("d.txt", "1")], "file_name string, sha256 string")
    assert sorted(r["file_name"] for r in digest_mismatches(digests, expected).collect()) == ["b.bin", "d.txt"]
    first = directory_fingerprint(spark, str(tmp_path)).first()
    assert (first["files"], first["total_bytes"], first["within_limits"]) == (3, 3004, True)
    assert directory_fingerprint(spark, str(tmp_path)).first() == first
    (tmp_path / "c.txt").write_bytes(b"x")
    assert directory_fingerprint(spark, str(tmp_path)).first()["fingerprint"] != first["fingerprint"]


def test_same_files_elsewhere_have_the_same_fingerprint(spark, tmp_path):
    for folder in ("one", "two"):
        (tmp_path / folder / "x").mkdir(parents=True)
        (tmp_path / folder / "x" / "f").write_text("same")
    prints = {directory_fingerprint(spark, str(tmp_path / f)).first()["fingerprint"] for f in ("one", "two")}
    assert len(prints) == 1


def test_standard_csv(spark, tmp_path):
    shape = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,1],[0,0]]]}'
    quoted = '"' + shape.replace('"', '""') + '"'
    (tmp_path / "b.csv").write_text(f'id,name,geometry\n1,"A ""B"" C",{quoted}\n2,"x, y",\n3,back\\slash,""""\n')
    got = [tuple(r) for r in read_csv(spark, str(tmp_path / "b.csv")).collect()]
    assert got == [(1, 'A "B" C', shape), (2, "x, y", None), (3, "back\\slash", '"')]
    (tmp_path / "m.csv").write_text('id,name\n1,"two\nlines ""q"""\n2,z\n')
    assert [tuple(r) for r in read_csv_text(spark, str(tmp_path / "m.csv"), multi_line=True).collect()] == [
        ("1", 'two\nlines "q"'), ("2", "z")]


def test_csv_and_records(spark, tmp_path):
    (tmp_path / "u.csv").write_text("id,latitude,name\n,degrees,\n1,2.5,a\n2,x,b\n")
    assert dict(read_csv(spark, str(tmp_path / "u.csv")).dtypes)["id"] == "int"
    text = read_csv_text(spark, str(tmp_path / "u.csv"))
    schema = spark.createDataFrame([], "id int, latitude double, name string").schema
    assert values(prep.drop_units_row(text, "id", schema)) == [(1, 2.5, "a"), (2, None, "b")]
    df = from_records(spark, [{"b": 1, "t": "2020-01-02T03:04:05"}, {"a": "x"}], timestamps=["t"])
    assert df.columns == ["b", "t", "a"] and str(df.first()["t"]) == "2020-01-02 03:04:05"
    assert from_records(spark, [{"v": 1}], "v double").dtypes == [("v", "double")]


def test_segments_and_codes(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0), (2, 1.0, 2.0, 0.0, 0.0), (3, 1.0, 2.0, None, None), (4, 1.0, 2.0, 0.0, 5.0)],
                               "id int, a double, b double, c double, d double")
    got = sorted(values(prep.segment_points(df, ("a", "b"), ("c", "d"), ["id"])))
    assert got == [(1, 0, 1.0, 2.0), (1, 1, 3.0, 4.0), (2, 0, 1.0, 2.0), (3, 0, 1.0, 2.0), (4, 0, 1.0, 2.0), (4, 1, 0.0, 5.0)]
    codes = spark.createDataFrame([(4,), (-1,), (77,), (None,)], "c int").select(prep.decode(F.col("c"), prep.VALIDITY_WORDS))
    assert [r[0] for r in codes.collect()] == ["definite", "erroneous entry", None, None]


def test_shared_folder_follows_the_setting(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
