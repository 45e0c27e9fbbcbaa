import threading

import pytest
from pyspark.sql import functions as F

from geoloom.plans.guard import RefusedQuery, guard
from geoloom.plans.scenes import InvalidScene, normalize_scene
from geoloom.plans.workspace import Workspace, compact_sample
from geoloom.session import isolated_session
from geoloom.sources.catalog import Dataset
from tests.conftest import SF_DIR, values

REFUSED = [
    "insert into t select 1", "with a as (select 1) insert into orders select * from a", "select 1; select 2",
    "select transform(x) using 'cat' from orders", "select reflect('a', 'b')", "select java_method('a', 'b')",
    "select * from parquet.`/tmp/x`", "select * from `a.csv`", "select * from orders asof join nation",
    "select 1 as x" + " " * 12_000 + "y", "", None, "values (1)", "table orders", "drop table orders", "select * from stream orders",
    "select * from identifier('orders')", "select * from read_csv('x')", "select * from missing", "select * from default.orders",
    "select * from orders where o_custkey in (select x from (select reflect('a', 'b') as x))",
    "select * from orders where exists (select 1 from missing)", "create table x as select 1", "explain select 1",
    "select session_user()", "select current_user", "select user()", "SELECT user FROM orders", "select current_database()",
    "select current_catalog() from nation", "select input_file_name() from orders", "select version()", "select current_timezone()",
    "select identifier('session_user')()", "select builtin.session_user()", "select my_udf(1)", "select default.my_udf(1)",
    "select o_orderkey from orders group by all having max(session_user()) = 'root'", "select no_such_function(1)",
    "select transform(array(1), x -> concat(x, session_user()))", "select * from orders lateral view my_table(1)",
    "select from_protobuf(x, 'm', '/etc/passwd') from (select 1 as x)", "select * from nation order by current_user()",
    "select * from orders version as of 1", "select (select max(x) from secret)", "selection", "set a = 1",
]
ACCEPTED = [
    ("select 1;", ()), ("  select load, 'update; drop' from (select 1 as load)  ;; ", ()),
    ("select transform(array(1, 2), x -> x + 1)", ()), ("with orders as (select * from orders) select * from orders", ("orders",)),
    ("with x as (select 1 as a) select * from x", ()), ("select * from range(3)", ()), ("SELECT a.* FROM ORDERS a", ("orders",)),
    ("with o as (select * from orders) select * from o where exists (select 1 from nation) and 1 < (select count(*) from region)",
     ("orders", "nation", "region")),
    ("with recursive r(n) as (select 1 union all select n + 1 from r where n < 5) select * from r", ()),
    ("select * from values (1, 2) as v(a, b)", ()), ("select o_custkey, count(*) c from orders group by all having count(*) > 1", ("orders",)),
    ("select 'orders in a text' as a -- nation", ()), ("select o.user from (select 1 as `user`) as o", ()),
    ("select current_date(), now(), current_timestamp, abs(-1), upper('a'), kll_sketch_agg_bigint(a) from (select 1L as a)", ()),
    ("select max(a) over (order by a rows between 3 preceding and current row) from (select 1 as a)", ()),
    ("select col from nation lateral view explode(array(1, 2)) as col", ("nation",)),
    ("select sum(x) filter (where x > 0) over (order by x), count(distinct x), x::int, x is null, x between 1 and 2 from (select 1 as x)", ()), ("select * from orders tablesample (10 percent)", ("orders",)),
]


@pytest.fixture
def ws(spark):
    session = isolated_session(spark)
    workspace = Workspace(session)
    for name in ("orders", "nation", "region", "customer"):
        workspace.add_relation(name, lambda name=name: session.read.parquet(f"{SF_DIR}/{name}.parquet"))
    return workspace


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(ws, sql):
    with pytest.raises(RefusedQuery):
        guard(ws.spark, sql, ws.catalog.names())


def test_registered_functions_are_refused_even_under_a_known_name(ws):
    ws.spark.udf.register("my_udf", lambda x: x, "int")
    ws.spark.udf.register("abs", lambda x: 7, "int")
    for sql in ("select my_udf(1)", "select abs(-1)"):
        with pytest.raises(RefusedQuery):
            guard(ws.spark, sql, ws.catalog.names())


def test_the_session_is_left_as_it_is(spark):
    before = spark.conf.get("spark.sql.runSQLOnFiles")
    Workspace(spark)
    assert spark.conf.get("spark.sql.runSQLOnFiles") == before


@pytest.mark.parametrize("sql,relations", ACCEPTED)
def test_accepted(ws, sql, relations):
    assert set(guard(ws.spark, sql, ws.catalog.names()).relations) == set(relations)


def test_cap_and_truncation(spark):
    ws = Workspace(isolated_session(spark), result_cap=100)
    for rows, flag in ((99, False), (100, False), (101, True)):
        result = ws.execute_sql(f"select id, id * 2 as double from range({rows}) order by id desc")
        assert (result.row_count, result.truncated) == (min(rows, 100), flag)
        got = values(ws.result_frame(result.id).orderBy("_row_index"), "_row_index", "id")
        assert got == [(i, rows - 1 - i) for i in range(min(rows, 100))]
    literal = ws.execute_sql("select * from values (3), (1), (2) as v(a)")
    assert values(ws.result_frame(literal.id).orderBy("_row_index"), "_row_index") == [(0,), (1,), (2,)]


def test_whole_results_by_default(spark):
    ws = Workspace(isolated_session(spark))
    result = ws.execute_sql("select id, id % 7 as k from range(150000) order by k, id desc")
    assert (result.row_count, result.truncated) == (150_000, False)
    got = ws.result_frame(result.id)
    assert got.agg({"_row_index": "max"}).first()[0] == 149_999 and got.select("_row_index").distinct().count() == 150_000
    want = sorted(range(150_000), key=lambda i: (i % 7, -i))
    assert values(got.where("_row_index % 9973 = 0").orderBy("_row_index"), "id") == [(i,) for i in want[::9973]]
    page, shown, pages = ws.page(result.id, 15_000)
    assert (shown, pages) == (15_000, 15_000) and [r.id for r in page.orderBy("_row_index").collect()] == want[-10:]


def scan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_results_are_pruned_file_scans(spark):
    """One column and a filter of a stored result reach the files; pages open only their own, without a join."""
    ws = Workspace(isolated_session(spark))
    result = ws.execute_sql("select id, id % 10 as k, concat('n', id) as name, NULL as nothing from range(0, 40000, 1, 8) order by id")
    plan = scan_of(ws.spark.sql(f"select name from {result.relation} where id > 39990"))
    assert "FileScan parquet" in plan and "ReadSchema: struct<id:bigint,name:string>" in plan and "GreaterThan(id,39990)" in plan
    assert "Join" not in plan and "ExistingRDD" not in plan
    assert "Join" not in scan_of(ws.result_frame(result.id))
    page = ws.page(result.id, 2000, max_columns=1)[0]
    assert values(page.orderBy("id")) == [(i, i) for i in range(19990, 20000)]
    assert len(page.inputFiles()) == 1 < len(ws.result_frame(result.id).inputFiles()) and "Join" not in scan_of(page)
    assert values(ws.rows_between(result.id, 4999, 5002).orderBy("id"), "_row_index", "nothing") == [(i, None) for i in (4999, 5000, 5001)]
    assert ws.rows_between(result.id, 50_000, 50_010).count() == 0
    assert [r.id for r in ws.inspect_relation(result.id).sample.orderBy("id").collect()] == [0, 1, 2, 3, 4]


def test_datasets_of_parquet_are_read_where_they_lie(spark, tmp_path):
    ws = Workspace(isolated_session(spark))
    spark.range(50, numPartitions=2).selectExpr("id", "id * 2 AS double").write.parquet(str(tmp_path / "t.parquet"))
    info = ws.load_dataset("t", path=str(tmp_path / "t.parquet"), caveats="none", sources=(("a", "A", "https://a.org"),))
    assert info.row_count == 50 and ws.catalog.entry("t").row_count == 50 and ws.catalog.entry("t").caveats == "none"
    plan = scan_of(ws.query("select double from t where id = 7"))
    assert "EqualTo(id,7)" in plan and str(tmp_path) in plan
    (tmp_path / "c.csv").write_text("a,b\n1,x\n2,y\n")
    ws.load_dataset("c", path=str(tmp_path / "c.csv"))
    assert "FileScan parquet" in scan_of(ws.query("select a from c")) and ws.query("select sum(a) from c").first()[0] == 3


def test_children_of_cut_results_are_cut(spark):
    ws = Workspace(isolated_session(spark), result_cap=100)
    parent = ws.execute_sql("select id from range(1000)")
    child = ws.execute_sql(f"select count(*) as n from {parent.relation}")
    assert parent.truncated and child.truncated
    assert not ws.execute_sql("select 1 as a").truncated


def test_ancestry_of_a_long_chain_with_many_ways(spark):
    ws = Workspace(isolated_session(spark))
    one = spark.createDataFrame([(1,)], "a int").withColumn("_row_index", F.lit(0))
    for i in range(1, 41):
        sources = tuple(f"_r{j:03d}" for j in (i - 1, i - 2) if j > 0)
        ws.register_result(one, id=f"r{i:03d}", title="t", sql=None, row_count=1, truncated=False, sources=sources,
                           created_at="", duration_ms=0, actor="user")
    found = ws.ancestry()
    assert found.count() == 40 * 39 // 2
    assert found.where("result = '_r040' and ancestor = '_r001'").first()["distance"] == 20


def test_lineage_of_chained_results(ws):
    first = ws.execute_sql("select o_custkey, count(*) as n from orders group by o_custkey")
    second = ws.execute_sql(f"select c.c_name, r.n from {first.relation} r join customer c on c.c_custkey = r.o_custkey")
    third = ws.execute_sql(f"select max(n) as most from {second.relation} -- nation")
    assert third.sources == ("_result_0002",) and not ws.catalog.is_loaded("nation")
    assert sorted(values(ws.lineage())) == [("_result_0001", "orders"), ("_result_0002", "_result_0001"),
                                            ("_result_0002", "customer"), ("_result_0003", "_result_0002")]
    assert ("_result_0003", "orders", 3) in values(ws.ancestry())
    assert ws.results_frame().count() == 3


def test_where_results_come_from(ws):
    first = ws.execute_sql("select n_nationkey as id, n_name as name, 1.0D as latitude, 2.0D as longitude from nation")
    second = ws.execute_sql(f"select r.* from {first.relation} r join region on id = r_regionkey")
    ws.render_scene({"headline": "h", "subheadline": "s", "layers": [{"id": "a", "resultId": second.id}]})
    said = ws.provenance(second.id)
    assert [d["relation"] for d in said["datasets"]] == ["region", "nation"] and said["results"] == [first.id]
    assert said["scene"] == {"headline": "h", "subheadline": "s", "layers": [{"id": "a", "type": "points", "title": second.id}]}
    assert ws.provenance(first.id)["scene"] is None
    assert {r.id: r.row_count for r in ws.results_frame().collect()} == {first.id: 25, second.id: 5}


def test_row_counts_that_differ_from_the_stated_ones(spark):
    ws = Workspace(isolated_session(spark))
    for name, stated in (("right", 3), ("wrong", 4), ("unstated", None)):
        ws.add_relation(name, lambda: ws.spark.range(3), row_count=stated)
    assert values(ws.count_report()) == [("wrong", 4, 3)]


def test_output_names(ws):
    for sql in ("select 1 as a, 2 as A", "select 1 as _row_index", "select 1 as _row_place"):
        with pytest.raises(ValueError):
            ws.execute_sql(sql)


def test_pages(ws):
    for rows, pages in ((0, 1), (10, 1), (11, 2)):
        result = ws.execute_sql(f"select id, 1 a, 2 b, 3 c, 4 d, 5 e from range({rows}) order by id")
        assert ws.page(result.id, 0)[1:] == (1, pages) and ws.page(result.id, 99)[1:] == (pages, pages)
    page, _, _ = ws.page(result.id, 2)
    assert page.columns == ["_row_index", "id", "a", "b", "c", "d"] and values(page, "id") == [(10,)]
    assert ws.present_result(result.id, selected=10) == {"resultId": result.id, "page": 2, "selectedIndex": 10}
    assert ws.present_result(result.id, page=7)["page"] == 2
    with pytest.raises(IndexError):
        ws.present_result(result.id, selected=11)
    with pytest.raises(KeyError):
        ws.present_result("result_9999")


def test_row_detail(ws):
    result = ws.execute_sql("select id as t, 'n' || id as name, cast(id as double) latitude, 5.0D longitude, 637.1D altitude_km, 1 z from range(12) order by id")
    row = ws.row_detail(result.id, 3).first()
    assert row["label"] == "n3" and row["position"] == "4 of 12"
    assert [f["name"] for f in row["fields"]] == ["t", "latitude", "longitude", "altitude_km"]
    assert (row["focus"]["latitude"], row["focus"]["altitude"]) == (3.0, pytest.approx(0.85))
    assert ws.row_detail(result.id, 12).count() == 0


def test_inspection(ws):
    info = ws.inspect_relation("nation")
    assert info.row_count == 25 and info.sample.count() == 5 and info.schema[0] == ("n_nationkey", "int", True)
    result = ws.execute_sql("select n_name as name, n_nationkey as value from nation")
    for name in (result.id, result.relation):
        assert ws.inspect_relation(name).roles["label"] == "name"
    with pytest.raises(KeyError):
        ws.inspect_relation("nowhere")
    listing = {r["relation"]: r for r in ws.inspect_workspace().collect()}
    assert listing["nation"]["loaded"] and not listing["region"]["loaded"] and listing[result.relation]["active"]


def test_compact_sample(spark):
    wide = spark.range(5).select(*[F.lit(i).alias(f"c{i}") for i in range(12)], F.lit("x" * 200).alias("title"),
                                 F.lit(1.0).alias("lat"), F.sequence(F.lit(1), F.lit(20)).alias("a"))
    sample = compact_sample(wide, {**dict.fromkeys(["label", "latitude", "longitude", "altitude", "geometry", "group", "order", "size"]),
                                   "label": "title", "latitude": "lat"})
    assert sample.columns == ["title", "lat", *[f"c{i}" for i in range(8)]] and sample.count() == 2
    assert len(sample.first()["title"]) == 98
    assert compact_sample(wide.select("a"), dict.fromkeys(["label", "latitude", "longitude", "altitude", "geometry", "group", "order", "size"])).first()["a"] == list(range(1, 9))


def test_loading_once_under_concurrency(spark):
    ws, reads = Workspace(isolated_session(spark)), []

    def load():
        reads.append(1)
        return ws.spark.range(3)

    ws.add_relation("numbers", load)
    threads = [threading.Thread(target=ws.catalog.frame, args=("numbers",)) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(reads) == 1
    with pytest.raises(ValueError):
        ws.add_relation("numbers", load)
    with pytest.raises(ValueError):
        ws.catalog.add(Dataset("Bad Name", load))


def test_load_dataset(ws, tmp_path):
    info = ws.load_dataset("My Places.csv", records=[{"id": 1, "lat": 2, "when": "2020-01-01"}, {"id": 2, "lat": 2.5, "tags": ["a"]}],
                           source_url="ftp://x", license="CC0")
    assert info.relation == "my_places" and info.row_count == 2 and info.provenance.kind == "agent"
    assert info.provenance.source_url is None and info.provenance.license == "CC0"
    assert info.sample.columns == ["id", "lat", "when", "tags"] and values(info.sample, "lat") == [(2.0,), (2.5,)]
    with pytest.raises(ValueError):
        ws.load_dataset("my places", records=[{"a": 1}])
    for bad in ({}, {"path": "x", "records": [{"a": 1}]}, {"records": []}, {"records": [{"a": 1}] * 501}, {"records": [1]}):
        with pytest.raises(ValueError):
            ws.load_dataset("other", **bad)
    assert ws.load_dataset("many", records=[{"a": i} for i in range(500)]).row_count == 500
    (tmp_path / "c.csv").write_text("a,b\n1,x\n2,y\n")
    loaded = ws.load_dataset("from_csv", path=str(tmp_path / "c.csv"))
    assert loaded.schema == (("a", "int", True), ("b", "string", True)) and loaded.provenance.kind == "remote"
    parquet = ws.load_dataset("from_parquet", path=f"{SF_DIR}/nation.parquet?v=1")
    assert parquet.row_count == 25
    assert ws.execute_sql("select count(*) as n from from_parquet join my_places on id = n_nationkey").sources == ("from_parquet", "my_places")
    with pytest.raises(ValueError):
        ws.load_dataset("odd", path="x.csv", format="xml")


def scene(**changes):
    return {"headline": "h", "subheadline": "s", "layers": [{"id": "a", "resultId": "r"}], **changes}


COLUMNS = {"r": ["id", "latitude", "longitude", "time", "value"], "g": ["name", "geojson"], "n": ["a"], "o": ["latitude", "longitude", "id"]}


@pytest.mark.parametrize("changes", [
    {"headline": ""}, {"headline": "x" * 121}, {"subheadline": "x" * 221}, {"layers": []}, {"layers": [{"resultId": "r"}] * 9},
    {"extra": 1}, {"layers": [{"id": "a", "resultId": "missing"}]}, {"layers": [{"id": "a", "resultId": "n"}]},
    {"layers": [{"id": "a", "resultId": "r", "type": "cubes"}]}, {"layers": [{"id": "a", "resultId": "r", "type": "polygons"}]},
    {"layers": [{"id": "a", "resultId": "o", "type": "paths"}]}, {"layers": [{"id": "a", "resultId": "r", "encoding": {"shape": "id"}}]},
    {"layers": [{"id": "a", "resultId": "r", "encoding": {"label": "nope"}}]}, {"layers": [{"id": "a", "resultId": "r", "style": {"opacity": 2}}]},
    {"layers": [{"id": "a", "resultId": "r", "style": {"radius": 3}}]}, {"layers": [{"id": "a", "resultId": "r", "style": {"color": "a;b"}}]},
    {"layers": [{"id": "a", "resultId": "r", "style": {"animate": "yes"}}]}, {"layers": [{"id": "a!", "resultId": "r"}, {"id": "A.x", "resultId": "r"}]},
    {"camera": {"fit": "some"}}, {"camera": {"fit": "active-layer", "layerId": "z"}}, {"camera": {"zoom": 1}}, {"layers": "a"},
    {"layers": [{"id": "a", "resultId": "r", "encoding": []}]}, {"layers": [[]]},
])
def test_invalid_scenes(changes):
    with pytest.raises(InvalidScene):
        normalize_scene(scene(**changes), COLUMNS.get)


def test_scene_defaults():
    made = normalize_scene(scene(layers=[
        {"resultId": "r", "type": "rings", "style": {"radius": 20}}, {"id": "My Layer", "resultId": "g", "type": "polygons"},
        {"id": "p", "resultId": "r", "type": "paths", "encoding": {"label": None}}]), COLUMNS.get)
    assert [x.id for x in made.layers] == ["layer_1", "my_layer", "p"] and made.fit == "all-layers" and made.fit_layer is None
    assert made.layers[0].style.radius == 20 and made.layers[2].style.animate and not made.layers[0].style.animate
    assert made.layers[2].encoding["label"] is None and made.active_result_id == "r"
    fitted = normalize_scene(scene(camera={"fit": "active-layer"}), COLUMNS.get)
    assert fitted.fit_layer == "a" and fitted.layers[0].style.radius == 0.28


def test_scene_marks_and_camera(ws):
    points = ws.execute_sql("select n_nationkey as id, n_name as name, 1.0D * n_nationkey as latitude, 170.0D as longitude from nation")
    with_shape = ws.execute_sql("""select 'x' as name, '{"type":"Polygon","coordinates":[[[0,0],[9,0],[9,9],[0,0]]]}' as geojson""")
    ws.render_scene(scene(layers=[{"id": "one", "resultId": points.id}, {"id": "two", "resultId": with_shape.id, "type": "polygons"}]))
    assert values(ws.marks().groupBy("layer_id").count().orderBy("layer_id")) == [("one", 25), ("two", 1)]
    assert ws.camera().first()["locations"] == 29 and ws.active_result_id == with_shape.id
    assert ws.active_extent().first()["locations"] == 4
    ws.render_scene(scene(layers=[{"id": "one", "resultId": points.id}], camera={"fit": "none"}))
    assert ws.camera() is None and ws.active_extent().first()["locations"] == 25
    ws.execute_sql("select 1 as a")
    assert ws.active_extent() is None
