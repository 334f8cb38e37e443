"""Queries against their SQL on pages that the test tables lack."""

import duckdb
import pytest
from oracle import same
from pyspark.sql import functions as F

from sitelens.operators import contacts as C
from sitelens.plans.registry import ORACLES, QUERIES

ENTITIES = (
    'token = &quot;77&quot; &lt;b&gt; &amp;quot; &amp;amp; a&nbsp;b &#39; &eacute; &copy; &middot; Q&A',
    "thouerti&amp;&amp;&amp; eroninnt&amp",  # cut inside an entity
    "&&amp;&copy;&copy &amp;copy; x&",
)


def check(spark, tmp_path, name, rows):
    """``rows``: (page_id, url, html)."""
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    same(QUERIES[name](spark, str(tmp_path)), ORACLES[name], con)


def marked():
    return [(i, f"https://www.site{i}.org/x", f'<html lang="en"><head><title>{t}</title></head><body><nav><a href="/a">{t}</a><a href="/b">b {t}</a></nav><h1>{t}</h1><p>{t}</p>') for i, t in enumerate(ENTITIES)]


@pytest.mark.parametrize("name", ["d1_page_metadata", "d2_page_headings", "d3_nav_labels", "d3_labels_by_both_paths", "d9_first_title"])
def test_entities(spark, tmp_path, name):
    check(spark, tmp_path, name, marked())


@pytest.mark.parametrize("name", ["d2_page_headings", "d3_nav_labels", "d3_labels_by_both_paths"])
def test_more_labels_than_the_rules_read(spark, tmp_path, name):
    many = "".join(f"<h2>h{i}</h2>" for i in range(120)) + "<nav>" + "".join(f'<a href="/{i}">n{i}</a>' for i in range(170)) + "</nav>"
    check(spark, tmp_path, name, [(1, "https://a.org/", many)])


def test_words_that_read_as_an_address(spark, tmp_path):
    """The operator puts them together as the rules say; the query keeps what its SQL has."""
    html = ["<p>He is at home. Then write to ann@x.org", "<div>so [at] the [dot] end, me@y.org.</div>", "<p>ann [at] z.org and ann@z.org", "<p>none"]
    check(spark, tmp_path, "g3_emails_in_elements", [(i, f"https://WWW.s{i}.org/x", h) for i, h in enumerate(html)])
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.normalized_email, r.written_out) for r in C.emails_in_elements(pages, F.col("html"), "page_id").collect()}
    assert got == {(0, "is@home.then", True), (0, "ann@x.org", False), (1, "so@the.end", True), (1, "me@y.org", False), (2, "ann@z.org", False)}
