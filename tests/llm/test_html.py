"""Main text against an independent reading of the test pages, and the template's parts."""

import html as entities
import re

import pytest
from pyspark.sql import functions as F

from geoloom.llm.html import candidate_classes, extract_text, main_text, occurrence_vectors, page_tokens, templates
from geoloom.llm.html_query import op10_html

SF = "/root/testdata/sf0.01"


def article(page):
    """The text between the article's tags, its tags taken out."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r"</?(?:p|h1|br)>", " ", inner)
    return " ".join(entities.unescape(re.sub(r"</?b>", "", inner)).split())


def test_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op10_html(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id]) and r.n_chars == len(r.text)


def test_blocks_and_boilerplate():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>A<li>B</ul></nav>
      <!-- <p>no</p> --><div class="cookie-notice">We use</div><div id='sidebar'>Side</div>
      <article><header><p>By x</p></header><h1>Head&amp;line</h1><p>One <b>bo</b>ld&nbsp;text<br>next
      <p>Two &lt;tag&gt; &#233;&eacute; 1 < 2<form>Mail</form><aside>More</aside><script>var a="</p>";</script>
      <section class="comments"><p>Nice!</p></section><span class="ad">Buy</span><p>End</article><footer>F</footer>"""
    assert main_text(page_tokens(page)) == "Head&line One bold text next Two <tag> éé 1 < 2 End"
    assert main_text(page_tokens("<p>a<p>b<div>c</div> d")) == "a b c d"
    assert main_text(page_tokens("<body><main><p>m</p></main><p>x</p>")) == "m"
    assert main_text(page_tokens("")) == main_text(page_tokens("<<<>")).replace("<", "").replace(">", "").strip() == ""
    assert main_text(page_tokens("<a " * 3000)) is not None


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string")


@pytest.mark.parametrize("pages", [2, 19, 20, 25])
def test_text_of_an_article_stays_whatever_repeats(spark, pages):
    rows = [(i, "http://a.com/x", f"<body><article><p>Read on our site.</p><p>own {i}</p></article><div>links</div></body>",
             "clash", "clash") for i in range(pages)]
    out = extract_text(pages_of(spark, rows))
    assert out.columns == ["page_id", "url", "html", "host", "text", "n_chars"]
    assert {r.page_id: r.text for r in out.collect()} == {i: f"Read on our site. own {i}" for i in range(pages)}


@pytest.mark.parametrize("pages", [2, 19, 20, 25])
def test_template_text_is_left_out_where_no_element_tells(spark, pages):
    """No article, no main element and no telling names: what all pages of the host share is the template."""
    rows = [(i, "http://a.com/x", f"<body><div class='topline'><b>Home</b> About us</div><div><p>Page {i} has words of its own</p><p>and "
             f"a second block, number {i}.</p></div><div class='q7'>Imprint and rules</div></body>", "", "") for i in range(pages)]
    assert {r.page_id: r.text for r in extract_text(pages_of(spark, rows)).collect()} == {
        i: f"Page {i} has words of its own and a second block, number {i}." for i in range(pages)}


@pytest.mark.parametrize("copies", [2, 19, 20, 2000])
def test_copies_of_a_page_keep_their_text(spark, copies):
    rows = [(i, f"http://a.com/{i}", f"<body><article><h1>Head</h1><p>First part.</p><p>Second part.</p></article>"
             "<div>links</div></body>", "", "") for i in range(copies)]
    got = [r.text for r in extract_text(pages_of(spark, rows)).collect()]
    assert got == ["Head First part. Second part."] * copies
    rows = [(i, u, h.replace("</article>", f"<p>{i}</p></article>"), t, o) for i, u, h, t, o in rows]
    got = sorted((r.page_id, r.text) for r in extract_text(pages_of(spark, rows)).collect())
    assert got == [(i, f"Head First part. Second part. {i}") for i in range(copies)]


def test_an_article_of_the_template_is_not_the_main_text():
    tokens = page_tokens("<article><p>Teaser</p></article><main><p>Own text of this page</p></main>")
    shared = frozenset(t for t, text, _, _ in tokens if text == "Teaser")
    assert main_text(tokens, shared) == "Own text of this page"


def test_classes(spark):
    rows = [("h", i, f"<div><i>x{i}</i></div>" + "<ul><li>q</li></ul>" * (1 + i % 2)) for i in range(30)]
    pages = spark.createDataFrame(rows, "host string, page long, html string")
    (only,) = candidate_classes(occurrence_vectors(pages)).collect()
    classes = {}
    for t in only.tokens:
        classes.setdefault(t["class"], []).append(t)
    # Tags that occur once, and tags (with their text) that occur once or twice.
    assert sorted((len(v), v[0].is_root) for v in classes.values()) == [(4, True), (5, False)]
    assert len(templates(pages).collect()[0].template) == 9


def test_unordered_classes_are_no_template(spark):
    rows = [("h", i, "<b>x</b><i>y</i>" if i % 2 else "<i>y</i><b>x</b>") for i in range(30)]
    pages = spark.createDataFrame(rows, "host string, page long, html string")
    assert templates(pages).count() == 0


def test_defined_cases(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "no host", "", None, None),
            (3, "http://b.org", "<p>only page</p>", None, None), (None, "http://b.org", "text & more", None, None)]
    got = sorted(((r.page_id or 0), r.text, r.n_chars) for r in extract_text(pages_of(spark, rows)).collect())
    assert got == [(0, "text & more", 11), (1, "", 0), (1, "", 0), (2, "", 0), (3, "only page", 9)]
    assert extract_text(pages_of(spark, [])).count() == 0
    assert extract_text(spark.createDataFrame([("u", "<p>" + "long " * 200_000)], "url string, html string")).select(
        F.max("n_chars")).collect()[0][0] == 999_999
