import random
from datetime import datetime, timedelta
from math import cos, floor, radians, sqrt

import pytest
from pyspark.sql import functions as F

from geoloom.functions.geojson import explode_edges
from geoloom.operators.near import near_join
from geoloom.operators.region import assign_region
from geoloom.operators.skew import DEFAULT_POLICY, grid_join, lookup_join
from tests.conftest import values

START = datetime(2024, 1, 1)


@pytest.fixture(params=["default", "tiny"])
def policy(request, tiny):
    return tiny if request.param == "tiny" else DEFAULT_POLICY


def observations(count, seed, crowded):
    """Points at random and, with ``crowded``, a third at one place and day; cell borders and negatives too."""
    rnd = random.Random(seed)
    rows = []
    for i in range(count):
        if crowded and i % 3 == 0:
            rows.append((i, 30.0, -40.0, START + timedelta(hours=rnd.randrange(24))))
        else:
            rows.append((i, rnd.choice([rnd.uniform(-12, 12), 0.0, 5.0, -5.0]), rnd.uniform(-20, 20),
                         START + timedelta(hours=rnd.randrange(24 * 6))))
    return rows


def near(l, r, days, dlat, dlon, km):
    if abs((l[3].date() - r[3].date()).days) > days or abs(l[1] - r[1]) >= dlat or abs(l[2] - r[2]) >= dlon:
        return None
    d = 111.2 * sqrt((l[1] - r[1]) ** 2 + ((l[2] - r[2]) * cos(radians(l[1]))) ** 2)
    d = floor(d * 10 + 0.5) / 10
    return d if d <= km else None


@pytest.mark.parametrize("days,dlat,dlon,km", [(1, 5.0, 7.0, 500.0), (0, 2.0, 3.0, 150.0), (3, 5.0, 7.0, 5000.0)])
def test_near_join_equals_all_pairs(spark, policy, days, dlat, dlon, km):
    left, right = observations(70, 1, True), observations(60, 2, True)
    a = spark.createDataFrame(left + [(999, None, 1.0, START)], "i int, lat double, lon double, t timestamp_ntz")
    b = spark.createDataFrame(right, "j int, lat2 double, lon2 double, t2 timestamp_ntz")
    got = near_join(a, b, ("lat", "lon", "t"), ("lat2", "lon2", "t2"), days, dlat, dlon, km, policy)
    want = [(l[0], r[0], near(l, r, days, dlat, dlon, km)) for l in left for r in right]
    assert sorted(values(got, "i", "j", "distance_km")) == sorted(w for w in want if w[2] is not None)


def test_near_join_beyond_the_poles(spark):
    """Where the longitude shrinks to nothing, a cell's whole width is within reach."""
    rnd = random.Random(5)
    left, right = ([(i, rnd.choice([rnd.uniform(80, 100), 90.0, -90.0]), rnd.uniform(-30, 30), START) for i in range(n)] for n in (60, 50))
    a = spark.createDataFrame(left, "i int, lat double, lon double, t timestamp_ntz")
    b = spark.createDataFrame(right, "j int, lat2 double, lon2 double, t2 timestamp_ntz")
    got = near_join(a, b, ("lat", "lon", "t"), ("lat2", "lon2", "t2"), 1, 5.0, 20.0, 300.0)
    want = [(l[0], r[0], near(l, r, 1, 5.0, 20.0, 300.0)) for l in left for r in right]
    assert sorted(values(got, "i", "j", "distance_km")) == sorted(w for w in want if w[2] is not None)


def test_near_join_plans_no_loop(spark):
    a = spark.createDataFrame(observations(5, 1, False), "i int, lat double, lon double, t timestamp_ntz")
    b = spark.createDataFrame(observations(5, 2, False), "j int, lat2 double, lon2 double, t2 timestamp_ntz")
    plan = near_join(a, b, ("lat", "lon", "t"), ("lat2", "lon2", "t2"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        near_join(a, a, ("lat", "lon", "t"), ("lat", "lon", "t"))


def test_near_join_spreads_the_pairs_of_one_cell(spark):
    """Few bytes may make many pairs: one place with 20,000 rows is dealt to several tasks, and no side is broadcast."""
    place = ["30 + id * 0D AS {}", "id * 0D - 40 AS {}", "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, id % 2) AS {}"]
    left = spark.range(20_000).selectExpr("id AS i", *[p.format(n) for p, n in zip(place, ("lat", "lon", "t"))]).coalesce(1)
    right = spark.range(3).selectExpr("id AS j", *[p.format(n) for p, n in zip(place, ("lat2", "lon2", "t2"))]).coalesce(1)
    got = near_join(left, right, ("lat", "lon", "t"), ("lat2", "lon2", "t2"))
    assert got.count() == 60_000 and got.select(F.spark_partition_id()).distinct().count() > 1


def rows_moved(df):
    """Rows that all exchanges of the last run wrote."""
    total, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            nodes.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                total += node.metrics().apply("shuffleRecordsWritten").value()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_near_join_writes_few_copies(spark):
    """What goes to disk is a few copies of a row: three days of a left one, four tiles of a right one, and the counts."""
    left, right = observations(600, 3, False), observations(600, 4, False)
    a = spark.createDataFrame(left, "i int, lat double, lon double, t timestamp_ntz")
    b = spark.createDataFrame(right, "j int, lat2 double, lon2 double, t2 timestamp_ntz")
    got = near_join(a, b, ("lat", "lon", "t"), ("lat2", "lon2", "t2"))
    want = [near(l, r, 1, 5.0, 7.0, 500.0) for l in left for r in right]
    assert len(got.collect()) == sum(w is not None for w in want)
    assert 0 < rows_moved(got) <= 5 * (len(left) + len(right))


def test_near_join_of_other_types(spark):
    """Whole and short numbers as degrees, dates as times, names with dots; rows at no finite place meet none."""
    rnd = random.Random(9)
    left = [(i, rnd.randrange(-8, 8), rnd.randrange(-9, 9), START.date() + timedelta(days=i % 4)) for i in range(80)]
    right = [(i, rnd.randrange(-8, 8), rnd.randrange(-9, 9), START.date() + timedelta(days=i % 5)) for i in range(70)]
    a = spark.createDataFrame(left, "i int, lat int, lon int, t date")
    nowhere = [(900, float("nan"), 1.0, START.date()), (901, 1.0, float("inf"), START.date())]
    b = spark.createDataFrame(
        [(i, float(y), float(x), t) for i, y, x, t in right] + nowhere, "j int, `lat.2` float, lon2 float, t2 date")
    got = near_join(a, b, ("lat", "lon", "t"), ("lat.2", "lon2", "t2"))
    assert got.columns == ["i", "lat", "lon", "t", "j", "lat.2", "lon2", "t2", "distance_km"]
    moments = [[(i, y, x, START + (t - START.date())) for i, y, x, t in side] for side in (left, right)]
    want = [(l[0], r[0], near(l, r, 1, 5.0, 7.0, 500.0)) for l in moments[0] for r in moments[1]]
    assert sorted(values(got, "i", "j", "distance_km")) == sorted(w for w in want if w[2] is not None)


def test_near_join_cuts_what_meets_in_a_task(spark, tiny):
    """One place with many rows on a side, or on both, is dealt to many tasks; pairs stay whole."""
    place = ["30 + id * 0D AS {}", "id * 0D - 40 AS {}", "DATE '2024-01-01' AS {}"]
    for n, m in ((40, 30), (2, 60), (60, 2), (50, 0), (0, 50)):
        left = spark.range(n).selectExpr("id AS i", *[p.format(x) for p, x in zip(place, ("lat", "lon", "t"))])
        right = spark.range(m).selectExpr("id AS j", *[p.format(x) for p, x in zip(place, ("lat2", "lon2", "t2"))])
        got = near_join(left, right, ("lat", "lon", "t"), ("lat2", "lon2", "t2"), policy=tiny)
        dealt = got.withColumn("task", F.spark_partition_id()).collect()
        assert sorted((r.i, r.j) for r in dealt) == [(i, j) for i in range(n) for j in range(m)]
        assert len({r.task for r in dealt}) > 3 or not n * m


def test_grid_join_of_copies(spark, tiny):
    """Equal rows of a hot key are spread and still meet once each."""
    left = spark.createDataFrame([("h", 1)] * 40 + [("c", 2)], "k string, a int")
    right = spark.createDataFrame([("h", 7)] * 30 + [("c", 8)] * 2, "k string, b int")
    got = grid_join(left, right, ["k"], F.lit(True), tiny)
    assert got.groupBy("a", "b").count().orderBy("a").collect() == [(1, 7, 1200), (2, 8, 2)]


def test_lookup_join_of_a_hot_key(spark, tiny):
    rows = spark.createDataFrame([("h", i % 2) for i in range(50)] + [("c", 1), (None, 3), ("x", 4)], "k string, v int")
    table = spark.createDataFrame([("h", 10), ("c", 20), ("unused", 30)], "k string, t int")
    got = lookup_join(rows, table, "k", "left", tiny)
    assert sorted(values(got, "k", "v", "t"), key=str) == sorted(values(rows.join(table, "k", "left"), "k", "v", "t"), key=str)
    assert lookup_join(rows, table, "k", "inner", tiny).count() == 51


SQUARE = '{"type":"Polygon","coordinates":[[[0,0],[10,0],[10,10],[0,10],[0,0]],[[4,4],[6,4],[6,6],[4,6],[4,4]]]}'
NEIGHBOUR = '{"type":"MultiPolygon","coordinates":[[[[10,0],[20,0],[20,10],[10,10],[10,0]]],[[[-30,-30],[-20,-30],[-25,-20],[-30,-30]]]]}'
OVERLAP = '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[15,5],[25,5],[25,15],[15,15],[15,5]]]}}'
POINTS = [(1, 5.0, 2.0, 1), (2, 5.0, 5.0, None), (3, 5.0, 0.0, 1), (4, 5.0, 30.0, None), (5, 5.0, 10.0, 2),
          (6, -25.0, -25.0, 2), (7, 7.0, 17.0, 2), (8, 12.0, 17.0, 3), (9, None, 3.0, None), (10, 10.0, 5.0, None)]


@pytest.mark.parametrize("limit,key", [(500_000, None), (0, None), (0, "i")])
@pytest.mark.parametrize("cell", [5.0, 3.0, 50.0])
def test_regions(spark, policy, limit, key, cell):
    shapes = spark.createDataFrame([(1, SQUARE), (2, NEIGHBOUR), (3, OVERLAP)], "id int, geometry string")
    edges = explode_edges(shapes, "geometry", ["id"])
    points = spark.createDataFrame([p[:3] for p in POINTS], "i int, latitude double, longitude double")
    got = assign_region(points, edges, "id", cell=cell, key=key, policy=policy, broadcast_edges=limit)
    assert got.columns == ["i", "latitude", "longitude", "region_id"]
    assert sorted(values(got, "i", "region_id")) == [(p[0], p[3]) for p in POINTS]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_regions_of_random_shapes(spark, tiny, limit):
    """Against a plain ray test over all edges."""
    rnd = random.Random(5)
    edges = []
    for polygon in range(12):
        cx, cy = rnd.uniform(-60, 60), rnd.uniform(-60, 60)
        ring = [(cx + rnd.uniform(-15, 15), cy + rnd.uniform(-15, 15)) for _ in range(7)]
        edges += [(polygon, *a, *b) for a, b in zip(ring, ring[1:] + ring[:1])]
    points = [(i, rnd.uniform(-70, 70), rnd.uniform(-70, 70)) for i in range(150)]

    def inside(lat, lon, polygon):
        crossed = 0
        for p, x1, y1, x2, y2 in edges:
            if p == polygon and (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                crossed += 1
        return crossed % 2 == 1

    want = [(i, next((p for p in range(12) if inside(lat, lon, p)), None)) for i, lat, lon in points]
    e = spark.createDataFrame(edges, "polygon int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame(points, "i int, latitude double, longitude double")
    got = assign_region(p, e, "polygon", key="i", policy=tiny, broadcast_edges=limit)
    assert sorted(values(got, "i", "region_id")) == want
    assert sum(r is not None for _, r in want) > 10


def test_regions_plan_no_loop(spark):
    edges = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 9.0), (1, 9.0, 9.0, 9.0, 0.0)], "id int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([p[:3] for p in POINTS], "i int, latitude double, longitude double")
    for limit in (10, 0):
        plan = assign_region(points, edges, "id", key="i", broadcast_edges=limit)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rows_without_a_key_are_spread(spark):
    rows = spark.range(20_000).selectExpr("CASE WHEN id < 20 THEN id END AS k", "id AS v")
    table = spark.range(20).selectExpr("id AS k", "id * 2 AS w")
    joined = lookup_join(rows, table, "k")
    assert joined.count() == 20_000 and joined.where("w IS NOT NULL").count() == 20
    salts = rows.where("k IS NULL").select(F.pmod(F.xxhash64("v"), F.lit(1 << 20)).alias("s")).distinct().count()
    assert salts > 19_000
