import math
import random

import pytest
from pyspark.sql import Window, functions as F

from geoloom.operators.asof import asof_join
from geoloom.operators.ordering import (
    SortKey, add_group_size, add_positions, decimate_path, deduplicate, exact_median, sort_columns, sort_keys, split_hot,
    top_per_group,
)
from geoloom.operators.skew import DEFAULT_POLICY, HotPolicy
from tests.conftest import values


@pytest.fixture(params=["default", "tiny"])
def policy(request, tiny):
    return tiny if request.param == "tiny" else DEFAULT_POLICY


def track_rows(seed=1):
    """A third of the rows in one group, a null group, equal, null, NaN and infinite orders."""
    rnd = random.Random(seed)
    rows = [("hot", rnd.choice([rnd.uniform(-5, 5), 1.0, None, math.nan, math.inf, -math.inf]), i) for i in range(60)]
    rows += [(rnd.choice(["a", "b", None, "c"]), rnd.uniform(0, 1), 100 + i) for i in range(50)]
    return rows + [("single", 3.0, 999)]


def test_positions_match_a_window(spark, policy):
    df = spark.createDataFrame(track_rows(), "g string, o double, i int")
    w = Window.partitionBy("g").orderBy(F.col("o").asc_nulls_last(), "i")
    want = df.select("g", "o", "i", F.row_number().over(w).cast("bigint"), F.count("*").over(Window.partitionBy("g")),
                     F.first("i").over(w))
    got = add_positions(df, "g", "o", ["i"], first=["i"], policy=policy)
    assert sorted(map(str, values(got))) == sorted(map(str, values(want)))


@pytest.mark.parametrize("sql_type", ["timestamp_ntz", "timestamp", "date", "string", "decimal(12,3)", "bigint"])
def test_positions_of_other_order_types(spark, tiny, sql_type):
    number = F.col("id") * 37 % 91
    value = {"timestamp_ntz": F.timestamp_add("SECOND", number * 997, F.lit("2020-01-01").cast("timestamp_ntz")),
             "timestamp": F.timestamp_seconds(number * 997), "date": F.date_add(F.lit("2020-01-01"), number.cast("int")),
             "string": F.concat(F.lit("p"), number)}.get(sql_type, number.cast(sql_type))
    df = spark.range(91).select(F.lit("g").alias("g"), value.alias("o"), number.alias("n"))
    got = add_positions(df, "g", "o", policy=tiny)
    assert got.where(F.col("position") != F.col("n") + 1).count() == 0 and got.count() == 91


@pytest.mark.parametrize("tie", ["i", "s", "t"])
@pytest.mark.parametrize("crowd", ["1.0D", "CAST(NULL AS DOUBLE)", "CAST('NaN' AS DOUBLE)", "0.0D"])
def test_hot_order_values_are_cut_along_the_tiebreak(spark, tiny, crowd, tie):
    """Half of a hot group has one order value; neighbours share its step."""
    df = spark.range(120).selectExpr(
        "'g' AS g", f"CASE WHEN id % 2 = 0 THEN {crowd} ELSE (id % 40) / 19.5D - 0.5D END AS o", "id * 7 % 121 AS i",
        "concat('item-', id * 7 % 121) AS s", "timestampadd(MINUTE, CAST(id * 7 % 121 AS INT), TIMESTAMP_NTZ '2024-01-01') AS t")
    w = Window.partitionBy("g").orderBy(F.col("o").asc_nulls_last(), tie)
    want = df.select("i", F.row_number().over(w).cast("bigint").alias("position"))
    got = add_positions(df, "g", "o", [tie], policy=tiny)
    assert sorted(values(got, "i", "position")) == sorted(values(want))
    assert largest_part(df, tiny, ["o", tie]) <= 2 * tiny.part_rows


def largest_part(df, policy, order):
    split = split_hot(df, F.col("g"), sort_columns(df, sort_keys(order)), policy)
    return split.hot.groupBy("_part").count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("order", [
    "CASE WHEN id = 7 THEN 1e300 ELSE id / 1000D END", "CASE WHEN id = 7 THEN -9e15D ELSE id * 1D END", "pow(1.7D, id % 1000)",
    "CASE WHEN id = 7 THEN repeat('z', 400) ELSE concat('https://example.org/a/b/', id) END",
    "CASE WHEN id = 7 THEN '' ELSE concat(repeat('same ', 60), id) END",
    "TIMESTAMP_NTZ '2024-01-01'", "CASE WHEN id = 7 THEN DATE '0001-01-01' ELSE date_add(DATE '2024-01-01', CAST(id AS INT)) END",
    "CAST(NULL AS STRING)", "CAST(1 AS DECIMAL(38, 2))"])
def test_no_distribution_leaves_a_large_part(spark, order):
    """One outlier, one common value, a long common prefix: every part of a hot group stays near the target."""
    policy = HotPolicy(floor_rows=1000, max_groups=50, part_rows=200)
    df = spark.range(4000, numPartitions=4).selectExpr("'g' AS g", f"{order} AS o", "id", "concat('g', id % 40) AS cold")
    assert largest_part(df, policy, ["o"]) <= 2 * policy.part_rows
    keys = [F.col("o").asc_nulls_last() if "repeat" not in order and "concat" not in order else sort_columns(df, sort_keys("o"))[0]]
    want = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy(*keys, "id")).cast("bigint").alias("position"))
    assert values(add_positions(df, "g", "o", ["id"], policy=policy).select("id", "position").orderBy("id")) == values(want.orderBy("id"))


def test_groups_that_cross_parts_and_rows_that_agree(spark):
    policy = HotPolicy(floor_rows=20, max_groups=50, part_rows=16)
    df = spark.range(600).selectExpr("CASE WHEN id < 90 THEN id % 30 ELSE id % 3 END AS g", "id % 2 AS o", "id")
    got = add_positions(df, "g", "o", policy=policy)
    assert got.count() == 600 and got.groupBy("g", "position").count().where("count > 1").count() == 0
    assert got.where("position > group_rows OR position < 1").count() == 0
    w = Window.partitionBy("g").orderBy("position")
    assert got.withColumn("before", F.lag("o").over(w)).where("before > o").count() == 0


@pytest.mark.parametrize("descending,nulls_first", [(False, False), (False, True), (True, False), (True, True)])
def test_mixed_directions(spark, policy, descending, nulls_first):
    df = spark.range(90).selectExpr("id % 2 AS g", "IF(id % 7 = 0, NULL, id % 5) AS a", "IF(id % 11 = 0, NULL, concat('x', id % 13)) AS b", "id")
    keys = [SortKey("a", descending, nulls_first), SortKey("b", not descending, not nulls_first), SortKey("id", True)]
    got = add_positions(df, "g", keys, policy=policy)
    rows = sorted(df.collect(), key=lambda r: (
        r.g, ((r.a is None) != nulls_first, (r.a or 0) * (-1 if descending else 1)),
        ((r.b is None) == nulls_first, int((r.b or "x0")[1:]) * (1 if descending else -1)), -r.id))
    want, seen = {}, {}
    for r in rows:
        seen[r.g] = seen.get(r.g, 0) + 1
        want[r.id] = seen[r.g]
    assert {r.id: r.position for r in got.collect()} == want
    kept = {r.id for r in decimate_path(df, "g", keys, 5, policy=policy).collect()}
    assert kept == {i for i, n in want.items() if n in (1, 45) or n % 5 == 0}


def test_input_is_read_twice_at_most(spark, tiny):
    """Once for the counts and once to store the split, however the result is used after."""
    reads = spark.sparkContext.accumulator(0)
    rows = spark.range(100, numPartitions=1).rdd.map(lambda r: (reads.add(1), ("g", r[0]))[1])
    df = spark.createDataFrame(rows, "g string, o long")
    reads.value = 0
    out = add_positions(df, "g", "o", policy=tiny)
    assert out.where("position <> o + 1").count() == 0 and out.count() == 100
    assert reads.value <= 200


def test_decimation(spark, policy):
    rows = [("a", i) for i in range(1, 13)] + [("b", 1)] + [(None, i) for i in (3, 1, 2)]
    df = spark.createDataFrame(rows, "g string, o int")
    got = sorted(values(decimate_path(df, "g", "o", 5, policy=policy)), key=str)
    assert got == sorted([("a", 1), ("a", 5), ("a", 10), ("a", 12), ("b", 1), (None, 1), (None, 3)], key=str)


def test_medians(spark, policy):
    rows = [("a", float(v)) for v in [5, 1, 1, 1, 9, 7, 7, 2]] + [("b", 4.0), ("c", None), ("b", 5.0)]
    rows += [("h", float(v % 23)) for v in range(101)] + [("h", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {r[0]: r[1] for r in df.groupBy("g").agg(F.median("v")).where("g <> 'c'").collect()}
    assert {r[0]: r[1] for r in exact_median(df, "g", "v", policy=policy).collect()} == want


def test_group_size_and_top(spark, policy):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 5)] + [("z", i) for i in range(40)], "g string, v int")
    sizes = add_group_size(df, "g", "n", policy)
    assert sizes.groupBy("g").agg(F.min("n"), F.max("n"), F.count("*")).where("g = 'z'").first()[1:] == (40, 40, 40)
    assert sizes.where("g IS NULL").first()["n"] == 1 and sizes.count() == df.count()
    top = top_per_group(df, ["g"], [F.col("v").desc_nulls_last()], 2)
    assert sorted(values(top), key=str) == sorted([("a", 2), ("a", 1), (None, 5), ("z", 39), ("z", 38)], key=str)


def test_deduplication_keeps_the_smallest(spark):
    rows = [("x", 1.0, None, 3), ("x", 1.0, "b", 1), ("x", 1.0, "a", 2), ("x", 2.0, "q", 9), (None, 1.0, "m", 4)]
    df = spark.createDataFrame(rows, "id string, lat double, name string, n int")
    got = sorted(values(deduplicate(df, ["id", "lat"], ["name"])), key=str)
    assert got == sorted([("x", 1.0, "a", 2), ("x", 2.0, "q", 9), (None, 1.0, "m", 4)], key=str)


def test_deduplication_decides_ties_by_the_whole_row(spark):
    """Rows that agree in keys and order have the same survivor in any order of the input; maps do not sort."""
    rows = [("x", 1, 9, "c", {"m": 1}), ("x", 1, 9, None, {"m": 2}), ("x", 1, 7, "b", {"m": 3}), ("x", 1, 7, "a", {"m": 4})]
    for given in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(given, "id string, place int, day int, name string, m map<string,int>").coalesce(1)
        assert values(deduplicate(df, ["id"], ["place"])) == [("x", 1, 7, "a", {"m": 4})]


def test_asof(spark, policy):
    rnd = random.Random(3)
    left = [(rnd.choice(["k", "k", "m", None]), rnd.randrange(100) if rnd.random() > 0.05 else None, i) for i in range(80)]
    right = [(rnd.choice(["k", "m", "n"]), rnd.randrange(100), 1000 + i) for i in range(40)]
    l = spark.createDataFrame(left, "k string, t int, l int")
    r = spark.createDataFrame(right, "k string, rt int, r int")

    def expected(k, t):
        found = [(rt, rid) for rk, rt, rid in right if rk == k and t is not None and rt <= t]
        return max(found) if found else (None, None)

    want = [(k, t, i, *expected(k, t)) for k, t, i in left]
    got = values(asof_join(l, r, "k", "t", "rt", "r", policy), "k", "t", "l", "rt", "r")
    assert sorted(got, key=str) == sorted(want, key=str)


def test_asof_at_one_hot_time(spark):
    """All rows of a key at one time: parts are cut along side and tiebreak, and the largest tiebreak wins everywhere."""
    policy = HotPolicy(floor_rows=50, max_groups=20, part_rows=40)
    left = spark.range(500).selectExpr("'k' AS k", "5 AS t", "id AS l")
    right = spark.range(300).selectExpr("'k' AS k", "5 AS rt", "id * 7 % 300 AS r")
    got = asof_join(left, right, "k", "t", "rt", "r", policy)
    assert got.count() == 500 and values(got.select("rt", "r").distinct()) == [(5, 299)]


def test_asof_refuses_shared_names(spark):
    df = spark.createDataFrame([("a", 1)], "k string, t int")
    with pytest.raises(ValueError):
        asof_join(df, df, "k", "t", "t")
