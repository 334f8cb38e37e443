"""Exact page signals: nested, unclosed and misleading markup, and parity with the regular expressions on settled pages."""

import pytest
from oracle import SF, there
from pyspark.sql import functions as F

from sitelens.operators import markup as M
from sitelens.operators import pages as P

WELL = (
    '<html lang="en"><head><title>Game &amp; News</title><meta name="Description" content="daily"><meta property="og:title" content="OG">'
    '<link rel="canonical" href="https://a.com/"><script type="application/ld+json">{"@type": "NewsArticle", "datePublished": "2024-01-02"}</script></head>'
    '<body><nav><a href="/news/a">News <b>now</b></a><button>Menu</button></nav><h1>One</h1><h2>Two</h2><h1>One</h1><time datetime="2024-05-01">May</time>'
    '<a rel="author" href="/u/1">Ann</a><footer><p>About us</p><span>&copy; 2024</span></footer></body></html>'
)
COLUMNS = [f.name for f in M.SIGNALS.fields] + ["detected_categories", "challenge_indicators", "parking_indicators"]


def signals(spark, html, limits=P.LIMITS):
    return M.page_signals_exact(spark.createDataFrame([(1, html)], "page_id int, html string"), limits=limits).first()


def test_settled_pages_are_read_alike(spark):
    pages = spark.createDataFrame([(1, WELL), (2, None), (3, ""), (4, "plain text"), (5, WELL.replace("Game", "Access denied")), (6, WELL * 2)], "page_id int, html string")
    assert all(r.ok for r in pages.select(M.settled(F.col("html")).alias("ok")).collect())
    by_pattern = {r.page_id: r for r in P.page_signals(pages).collect()}
    by_stack = {r.page_id: r for r in M.parse_pages(pages).collect()}
    assert by_pattern[1].navigation_labels == ["News now", "Menu"] and by_pattern[1].footer_text == ["About us", "© 2024"]
    for i, r in by_pattern.items():
        assert {c: r[c] for c in COLUMNS} == {c: by_stack[i][c] for c in COLUMNS}


@pytest.mark.parametrize(
    "html",
    [
        "<nav><a>x</a><nav><a>y</a></nav></nav>", "<p>a<p>b", "<!-- <h1>no</h1> -->", "<script>var a = '<h1>no</h1>'</script>", '<a title="a>b" href="/x">t</a>', "a < b", "<h1>&eacute;</h1>",
        "<p><a>x</p></a>", "</h1>", "<h1>open", "<div>" * 20 + "</div>" * 20, "<span><span>x</span></span>",
    ],
)
def test_unsettled(spark, html):
    row = signals(spark, html)
    assert row.parsed


def test_nested_elements(spark):
    row = signals(spark, "<nav><a>one</a><nav><a>two</a></nav><a>three</a></nav><footer><p>x<span>y</span></p><footer><p>z</p></footer></footer>")
    assert row.navigation_labels == ["one", "two", "three"] and row.footer_text == ["xy", "y", "z"]
    row = signals(spark, "<ul><li><a href='/news/1'>a<ul><li><a href='/news/2'>b</a></ul></li></ul>")
    assert row.article_links == ["/news/1", "/news/2"]


def test_unclosed_and_stray_tags(spark):
    row = signals(spark, "<h1>first<h2>second</h2></b></h1><h3>last <i>part")
    assert row.headings == ["firstsecond", "second", "last part"]
    row = signals(spark, "<nav><a>x<button>y</nav><h1>z")
    assert row.navigation_labels == ["xy", "y"] and row.headings == ["z"]


def test_what_is_not_markup(spark):
    row = signals(spark, "<!-- <title>no</title> --><script>document.write('<h1>no</h1>')</script><style>h1 > b {}</style><title>T &eacute;</title><h1>a<script>b</script>c<!-- d --></h1><p title='<h1>no</h1>'>")
    assert row.page_title == "T é" and row.headings == ["ac"]
    row = signals(spark, '<script type="application/ld+json">{"@type": "Article", "x": "</p>"}</script><script type="application/ld+json">{broken</script>')
    assert row.json_ld_types == ["Article"]


def test_hostile_pages(spark):
    deep = '<script type="application/ld+json">' + "[" * 24_000 + "]" * 24_000 + "</script>"
    for html in (deep, deep + "<!-- -->", "<a> " * 100_000, "<div><" * 50_000, "<!" * 50_000, "<p " + "a=' " * 50_000, "&" * 100_000, "<nav><a href=/news/>" * 30_000):
        row = signals(spark, html)
        assert row.json_ld_types == []
    assert P.page_signals(spark.createDataFrame([(1, deep)], "page_id int, html string")).first().json_ld_types == []


def test_limits(spark):
    html = "<!-- -->" + "".join(f"<h1>h{i}</h1>" for i in range(300)) + "<nav>" + "".join(f"<a href='/news/{i}'>n{i}</a>" for i in range(700)) + "</nav>"
    row = signals(spark, html)
    assert (len(row.headings), len(row.navigation_labels), len(row.article_links)) == (100, 150, 500)
    every = P.Limits(None, None, None, None, None, None, None, None)
    for text in (html, html[8:]):
        row = signals(spark, text, every)
        assert (len(row.headings), len(row.navigation_labels), len(row.article_links)) == (300, 700, 700)


def test_empty_and_odd_tables(spark):
    none = spark.createDataFrame([], "page_id int, url string, html string")
    assert M.page_signals_exact(none).count() == 0
    row = signals(spark, None)
    assert row.page_title is None and row.headings == []


@pytest.mark.skipif(not there(), reason="no tables")
def test_pages_by_both_paths(spark):
    """The driver's pages are unsettled; without comments, scripts and open tags they are settled, and both paths agree."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert pages.where(~M.settled(F.col("html"))).count() == pages.count()
    html = F.regexp_replace(F.regexp_replace("html", r"(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>", ""), r"<p><b>|<p>|</p>|</?b>|</?article>|</?body>|</?html[^>]*>|</?head>", "")
    tidy = pages.withColumn("html", html).cache()
    ok = tidy.where(M.settled(F.col("html")))
    assert ok.count() == pages.count()
    assert sorted(map(str, P.page_signals(ok).select("page_id", *COLUMNS).collect())) == sorted(map(str, M.parse_pages(ok).select("page_id", *COLUMNS).collect()))
