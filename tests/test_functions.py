import math
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from geoloom.functions.color import PALETTE, palette_color, text_hash
from geoloom.functions.geo import (
    angular_degrees, approx_km, as_number, is_finite, relative_altitude, ring_radius, rounded,
)
from geoloom.functions.roles import infer_roles, roles_of_tables
from geoloom.functions.text import clean_name, float_key_text, natural_key, relation_name, row_label, short_text
from geoloom.functions.times import day_difference, days_after, epoch_timestamp, iso_text
from geoloom.functions.urls import clean_link, clean_link_text, is_public_https


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def utf16_hash(text):
    data, h = text.encode("utf-16-be"), 0
    for i in range(0, len(data), 2):
        h = (h * 31 + int.from_bytes(data[i:i + 2], "big")) % 2**32
    return h - 2**32 if h >= 2**31 else h


def test_finite_numbers_of_text(spark):
    rows = [("1.5", True), (None, False), ("", False), ("abc", False), ("NaN", False), (" 12 ", True),
            ("Infinity", False), ("1d", False), ("-3e2", True), (".5", True), ("1e999", False)]
    df = spark.createDataFrame(rows, "x string, expected boolean")
    assert df.where(F.coalesce(is_finite(as_number(df, "x")), F.lit(False)) != F.col("expected")).count() == 0


def test_finite_numbers_of_other_types(spark):
    df = spark.sql("SELECT 1 AS i, true AS b, CAST('NaN' AS DOUBLE) AS n, array(1) AS a, 2.5BD AS d")
    got = df.select(*[as_number(df, c).alias(c) for c in ("i", "b", "a", "d")]).first()
    assert tuple(got) == (1.0, 1.0, None, 2.5)
    assert df.where(is_finite(as_number(df, "n"))).count() == 0


def test_ring_radius(spark):
    df = spark.createDataFrame([(100.0,), (1.0,), (10000.0,), (-100.0,), (None,)], "s double")
    assert [r[0] for r in df.select(ring_radius(F.col("s"), 6)).collect()] == pytest.approx([7, 2.5, 20, 7, 6])
    assert one(spark, ring_radius(None, 3.5)) == 3.5


def test_altitude(spark):
    df = spark.createDataFrame([(637.1,), (-5.0,), (200000.0,), (None,), (math.nan,)], "a double")
    got = [r[0] for r in df.select(relative_altitude(F.col("a"), 0.014)).collect()]
    assert got == pytest.approx([0.1, 0, 20, 0.014, 0.014])


def test_rounding_on_the_double(spark):
    # 0.285 and 1.005 are below their decimal text as doubles.
    cases = [(0.285, 2, 0.28), (1.005, 2, 1.0), (2.5, 0, 3.0), (-2.5, 0, -3.0), (-0.14, 1, -0.1)]
    for value, digits, expected in cases:
        assert one(spark, rounded(F.lit(value), digits)) == expected
    assert one(spark, rounded(F.lit(None).cast("double"), 1)) is None


def test_distances(spark):
    assert one(spark, approx_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) == pytest.approx(111.2)
    assert one(spark, approx_km(F.lit(60.0), F.lit(0.0), F.lit(60.0), F.lit(2.0))) == pytest.approx(111.2)
    assert one(spark, angular_degrees(F.lit(0.0), F.lit(170.0), F.lit(0.0), F.lit(-170.0))) == pytest.approx(20)
    assert one(spark, angular_degrees(F.lit(0.0), F.lit(0.0), F.lit(None).cast("double"), F.lit(1.0))) is None


def test_hash_and_palette(spark):
    texts = ["default", "AL092023", "", "\U0001F600", "a\U0001F600é", "日本"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r[0]: r[1] for r in df.select("t", text_hash(F.col("t"))).collect()}
    assert got == {t: utf16_hash(t) for t in texts}
    assert got["default"] == 1544803905 and got["AL092023"] == 1772702323
    assert one(spark, palette_color(F.lit(None).cast("string"))) == PALETTE[3]
    assert one(spark, palette_color(F.lit("AL092023"))) == PALETTE[1]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=20, max_size=60))
def test_hash_of_any_text(spark, texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) <= 0xDFFF for c in t)] or ["x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r[1] == utf16_hash(r[0]) for r in df.select("t", text_hash(F.col("t"))).collect())


def test_natural_order(spark):
    df = spark.createDataFrame([(t,) for t in ["a10", "a9", "a1b20", "a1b3", "a007", "A8"]], "t string")
    got = [r[0] for r in df.orderBy(natural_key(F.col("t"))).collect()]
    assert got == ["a1b3", "a1b20", "a007", "A8", "a9", "a10"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.from_regex(r"[a-c]{1,2}[0-9]{1,25}", fullmatch=True), min_size=10, max_size=40, unique=True))
def test_natural_order_of_numbers(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.orderBy(natural_key(F.col("t"))).collect()]

    def key(t):
        letters, digits = re.fullmatch("([a-c]+)([0-9]+)", t).groups()
        return letters, int(digits)

    assert [key(t) for t in got] == sorted(key(t) for t in texts)


def test_clean_names(spark):
    cases = {"My File.csv": "my_file", "9 lives": "data_9_lives", "a" * 60: "a" * 48, "": "dataset", "x.y.z": "x_y",
             "_lead_": "lead"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", clean_name(F.col("t"))).collect()} == cases
    assert {t: relation_name(t) for t in cases} == cases
    with pytest.raises(ValueError):
        relation_name("!!!")
    assert one(spark, clean_name(F.lit("!!!"))) == "data_"


def test_labels_and_short_text(spark):
    assert one(spark, row_label(None, None)) == "Result"
    assert one(spark, row_label(F.lit(None).cast("string"), F.lit("g"))) == "Result"
    assert one(spark, row_label(None, F.lit(5))) == "5"
    assert one(spark, short_text(F.lit("x" * 100))) == "x" * 100
    assert one(spark, short_text(F.lit("x" * 101))) == "x" * 97 + "…"
    assert one(spark, float_key_text(F.lit(300234062328360.0))) == "300234062328360.0"


def test_epoch_units(spark):
    ms = 1700000000000
    got = one(spark, *[iso_text(epoch_timestamp(F.lit(v), u)) for v, u in [
        (ms, None), (ms * 1000, None), (ms * 10**6, None), (ms, "ms"), (ms * 1000, "us"), (ms * 10**6, "ns"),
        (ms // 1000, "s")]])
    assert set(got) == {"2023-11-14T22:13:20.000Z"}
    assert one(spark, iso_text(epoch_timestamp(F.lit(0), "us"))) == "1970-01-01T00:00:00.000Z"
    assert one(spark, iso_text(epoch_timestamp(F.lit(-1), "ms"))) == "1969-12-31T23:59:59.999Z"


def test_days(spark):
    assert str(one(spark, days_after("1979-01-01", F.lit(12000.25)))) == "2011-11-09 06:00:00"
    edge = [F.lit(t).cast("timestamp_ntz") for t in ("2020-01-01 23:59:59", "2020-01-02 00:00:01")]
    assert one(spark, day_difference(*edge)) == 1


def test_source_urls(spark):
    cases = {
        "https://example.org/a.csv": True, "http://example.org/a": False, "https://u:p@example.org/": False,
        "https://localhost/a": False, "https://10.0.0.1/": False, "https://172.16.0.1/": False,
        "https://172.32.0.1/": True, "https://[::1]/": False, "https://a.local/": False, "https://169.254.1.1/": False,
        "https://192.168.3.4/x": False, "https://127.0.0.1/": False, "HTTPS://Example.org/": True, "not a url": False,
    }
    df = spark.createDataFrame([(u,) for u in cases] + [(None,)], "u string")
    got = {r[0]: r[1] for r in df.select("u", is_public_https(F.col("u"))).collect()}
    assert got == {**cases, None: False}


def test_links(spark):
    cases = {"https://a.org/x": "https://a.org/x", "http://a.org": "http://a.org", "ftp://a.org": None,
             "https://u:p@a.org/": None, "javascript:alert(1)": None, "": None}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r[0]: r[1] for r in df.select("u", clean_link(F.col("u"))).collect()} == cases
    assert {u: clean_link_text(u) for u in cases} == cases


def test_roles(spark):
    roles = infer_roles(["Lat", "latitude", "lng", "SID", "id", "iso_time", "wind_kts"])
    assert roles["latitude"] == "latitude" and roles["longitude"] == "lng" and roles["group"] == "id"
    assert roles["order"] == "iso_time" and roles["label"] == "id" and roles["size"] == "wind_kts"
    assert roles["geometry"] is None and roles["altitude"] is None
    tables = {"a": ["Y", "x", "brand"], "b": ["geom", "place_id", "title"]}
    df = spark.createDataFrame([(t, c) for t, cs in tables.items() for c in cs], "table_name string, column_name string")
    got = {(r[0], r[1]): r[2] for r in roles_of_tables(df).collect()}
    want = {(t, role): c for t, cs in tables.items() for role, c in infer_roles(cs).items() if c}
    assert got == want


def test_key_text_keeps_every_digit(spark):
    for value, text in ((1.23, "1.23"), (1.24, "1.24"), (1e20, "100000000000000000000.0"), (-2.5e-7, "-0.00000025"),
                        (12345678.25, "12345678.25"), (0.0, "0.0"), (1.5e8, "150000000.0")):
        assert one(spark, float_key_text(F.lit(value))) == text


def test_addresses_in_other_forms(spark):
    local = ["https://2130706433/", "https://0177.0.0.1/", "https://0x7f.1/", "https://10.1/", "https://0xC0A80001/",
             "https://127.0.0.1./", "https://[::1]:8/"]
    public = ["https://a_b.example.com/x", "https://münchen.example/", "https://134744072/", "https://8.8.8.8:443/", "https://1.2.3.4.5/"]
    df = spark.createDataFrame([(u,) for u in local + public], "u string")
    got = {r[0]: r[1] for r in df.select("u", is_public_https(F.col("u"))).collect()}
    assert not any(got[u] for u in local) and all(got[u] for u in public)
