"""Feeds, and what they add to a site's evidence."""

import datetime

from pyspark.sql import functions as F

from sitelens.operators import pages as P
from sitelens.sources.feeds import feed_date, feed_entries

RSS = "<rss><channel><item><title>{}</title><link>{}</link></item>{}</channel></rss>"


def entries(spark, *bodies):
    d = spark.createDataFrame(list(enumerate(bodies)), "site int, body string")
    return [(r.site, r.entry_seq, r.title, r.link) for r in feed_entries(d).orderBy("site", "entry_seq").collect()]


def test_formats(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">T</title><link rel="self" href="s"/><link rel="alternate" href="a"/></entry></feed>'
    rdf = '<rdf:RDF xmlns:rdf="x"><channel><title>c</title></channel><item><title>R</title><link>r</link></item></rdf:RDF>'
    got = entries(spark, RSS.format("A &lt;b&gt;B&lt;/b&gt;", " l ", "<item><guid>https://g</guid></item><item><guid>g</guid></item>"), atom, rdf)
    assert got == [(0, 0, "A B", "l"), (0, 1, None, "https://g"), (0, 2, None, None), (1, 0, "T", "a"), (2, 0, "R", "r")]


def test_what_is_no_feed(spark):
    assert entries(spark, None, "", "text", "<html><body><p>x</body></html>", RSS.format("a", "b", "<item>"), "<rss><channel/></rss>") == []
    assert feed_entries(spark.createDataFrame([], "site int, body string")).count() == 0


def test_long_feed(spark):
    got = entries(spark, RSS.format("a", "b", "".join(f"<item><title>t{i}</title></item>" for i in range(20_000))))
    assert len(got) == 20_001 and got[-1] == (0, 20_000, "t19999", None)


def test_dates(spark):
    texts = ["Tue, 02 Jan 2024 10:00:00 GMT", "2 Jan 2024 12:00 +0200", "2024-01-02T10:00:00Z", "2024-01-02T10:00:00.000Z", "2024-01-02", "soon", None]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(feed_date(F.col("x")).alias("t")).collect()]
    ten = datetime.datetime(2024, 1, 2, 10)
    assert got == [ten, ten, ten, ten, datetime.datetime(2024, 1, 2), None, None]


def test_two_valid_entries_are_evidence(spark):
    pages = spark.createDataFrame([("a", 1, True, ""), ("b", 1, False, None), ("b", 2, True, "x"), ("b", 3, True, "y"), ("c", 1, None, None), ("d", 1, False, "err")], "site string, page_seq int, success boolean, html string")
    d = spark.createDataFrame([("a", "t", "l"), ("a", "t", "l"), ("c", "t", "l"), ("c", None, "l"), ("e", "t", "l"), ("e", "t", "l")], "site string, title string, link string")
    got = {r.site: tuple(r)[1:] for r in P.acquisition(pages, d).collect()}
    assert got == {"a": (1, False, 0, 2, True), "b": (2, True, 1, 0, True), "c": (1, False, 0, 1, False), "d": (1, True, 0, 0, True), "e": (None, False, 0, 2, True)}
    assert not any(r.usable_evidence for r in P.acquisition(pages.where("site in ('a', 'c')")).collect())
    assert P.acquisition(pages.where("false"), d.where("false")).count() == 0
