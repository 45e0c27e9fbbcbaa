"""URL rules and the filter's exactness."""

from geoloom.llm import urls
from geoloom.llm.urls import Rule, bloom_blocks, filter_urls
from geoloom.llm.urls_query import RULES


def judge(spark, pages, listed=(), **options):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(pages)], "id long, url string, host string")
    lists = spark.createDataFrame([(u,) for u in listed], "url string")
    return {r.id: r for r in filter_urls(df, lists, options.pop("rules", RULES), **options).collect()}


def test_rules(spark):
    got = judge(spark, ["https://A.Example.NET/en/1?q#f", "http://x.net/fr/", "http://notnet/", "http://net", "http://q.org/fr/a",
                        "http://example.com/de/://x", "http://m.example.com/en/", None, "no url", "http://", "://h?a/b"])
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(11)] == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("x.net", "/fr/", "net/", "block"),
        ("notnet", "/", None, "allow"), ("net", "", None, "allow"), ("q.org", "/fr/a", "org/fr/", "allow"),
        ("example.com", "/de/://x", "example.com/de/", "block"), ("m.example.com", "/en/", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow")]


def test_listed(spark):
    pages = ["http://www.a.com/x/?b=2&utm_source=q&a=1", "http://a.com/x?a=1&b=2#z", "http://a.com/y", "http://a.com/x", None]
    got = judge(spark, pages, ["https://m.a.com:443/x/?b=2&a=1&ref=9", None, "https://m.a.com:443/x/?b=2&a=1"], rules=[])
    assert [got[i].listed for i in range(5)] == [True, True, False, False, False]
    assert [got[i].verdict for i in range(5)] == ["block", "block", "allow", "allow", "allow"]


def test_shuffled_probe_and_false_positives(spark, monkeypatch):
    pages = [f"http://h{i % 50}.com/{i % 400}" for i in range(2_000)]
    listed = [f"http://h{i % 50}.com/{i % 400}" for i in range(0, 400, 3)]
    want = {i: p in set(listed) for i, p in enumerate(pages)}
    assert {i: r.listed for i, r in judge(spark, pages, listed, rules=[]).items()} == want
    monkeypatch.setattr(urls, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(urls, "BITS_PER_URL", 1)  # nearly every page is a possible hit
    assert {i: r.listed for i, r in judge(spark, pages, listed, rules=[]).items()} == want


def test_filter_has_no_false_negatives_and_empty_tables(spark):
    keys = spark.range(1_000).selectExpr("CAST(id AS STRING) AS key")
    assert bloom_blocks(keys, 250).count() <= 250
    assert judge(spark, []) == {} and judge(spark, ["http://a.com/"])[0].verdict == "allow"
    assert judge(spark, ["http://a.b.c/xy"], rules=[Rule("c", "/xy", "block"), Rule("b.c", "/x", "allow")])[0].rule == "b.c/x"
