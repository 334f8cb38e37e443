"""URL operators against the standard library's URL functions, on hosts and paths of every kind."""

import urllib.parse

from pyspark.sql import functions as F

from sitelens.functions import urls as U
from sitelens.functions.lists import TRACKING_PARAMS
from sitelens.operators import candidates


def test_domains(spark):
    want = {
        "site.com.pl": "site.com.pl", "a.b.co.id": "b.co.id", "x.gov.br": "x.gov.br", "www.site.co.il": "site.co.il", "com.de": "com.de", "a.com.de": "com.de", "co.uk": None,
        "a.foo.ck": "a.foo.ck", "foo.ck": None, "www.ck": "www.ck", "a.www.ck": "www.ck", "x.city.kobe.jp": "city.kobe.jp", "x.y.z.kobe.jp": "y.z.kobe.jp", "a.localhost": None, "x.test": None,
        "999.1.1.1": None, "a.xn--p1ai": "a.xn--p1ai", "com": None, "": None,
    }
    df = spark.createDataFrame([(h,) for h in want], "h string").select("h", U.registered_domain(F.col("h")).alias("d"))
    assert {r.h: r.d for r in df.collect()} == want
    rules = ("com", "a.b.c", "*.d.e", "!x.d.e")
    own = {"s.com": "s.com", "s.a.b.c": "s.a.b.c", "b.c": None, "t.s.y.d.e": "s.y.d.e", "y.d.e": None, "x.d.e": "x.d.e", "s.org": None}
    df = spark.createDataFrame([(h,) for h in own], "h string").select("h", U.registered_domain(F.col("h"), rules).alias("d"))
    assert {r.h: r.d for r in df.collect()} == own


def test_reasons(spark):
    want = {
        "https://a.com:0/": "unsupported_port", "https://a.com:70000/": "invalid_url", "https://a.com:x/": "invalid_url", "https://a.com:/": None, "http://a.com:080/": None, "https://a.com:1:2/": "invalid_url",
        "https://[::1]/": "raw_ip_not_allowed", "https://[::1/": "invalid_url", "https://[x]/": "invalid_url", "https://1.2.3.4./": "raw_ip_not_allowed", "https://256.1.1.1/": "invalid_registered_domain",
        "https://:pw@a.com/": "embedded_credentials", "https://@a.com/": None, "https:///x": "missing_host", "https://a..com/": "invalid_hostname", "https://.a.com/": "invalid_hostname",
        "https://" + "ü" * 64 + ".com/": "invalid_hostname", "https://" + "a." * 130 + "com/": "host_too_long", "https://a.com／x/": "invalid_url", "https://ゲーム.jp/a": None, "  https://a.com/  ": None,
        "a b.com/": "invalid_url", "https://a.com/\n": "invalid_url", "foo.unknown1": "invalid_registered_domain",
    }
    df = spark.createDataFrame([(u,) for u in want], "url string")
    assert {r.url: r.r for r in df.select("url", U.url_reject_reason(F.col("url")).alias("r")).collect()} == want
    assert {r.url: r.reason for r in U.with_site(df).collect()} == want


def test_normal_forms(spark):
    paths = ["", "/", "/a b", "/ü/%20%zz*~'(x);=+,@$&", "/a%2Fb/../c", "/ゲーム"]
    queries = ["", "b=2&a=1&&c", "x=a+b%20c&utm_source=1&UTM_ID=2", "q=ゲーム&y=%zz%E3%81%82*~", "%75tm_term=x&k=a=b", "=v&+=+"]
    hosts = {"https://münchen.de": "xn--mnchen-3ya.de", "HTTP://ゲーム.JP": "ゲーム.jp".encode("idna").decode(), "https://WWW.a.co.uk.": "a.co.uk", "https://straße.de": "strasse.de"}
    rows, want = [], {}
    for h, host in hosts.items():
        for p in paths:
            for q in queries:
                url = h + p + (("?" if p else "/?") + q if q else "") + "#f"
                left = [(k, v) for k, v in urllib.parse.parse_qsl(q, keep_blank_values=True) if k.lower() not in TRACKING_PARAMS]
                path = urllib.parse.quote(p, safe="/%") or "/"
                want[url] = urllib.parse.urlunsplit((h.partition(":")[0].lower(), host, path, urllib.parse.urlencode(left), ""))
                rows.append((url,))
    df = spark.createDataFrame(rows, "url string")
    assert {r.url: r.normalized_url for r in U.with_site(df).collect()} == want
    assert {r.url: r.n for r in df.select("url", U.normalize_url(F.col("url")).normalized_url.alias("n")).collect()} == want


def test_one_reject_chain_in_the_plan(spark):
    hits = spark.createDataFrame([(1, 1, "https://a.com/", "q", 1)], "seq long, query_seq int, url string, query_text string, position int")
    ok, _ = candidates.split_candidates(hits)
    plan = ok._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("THEN embedded_credentials") == 1


def test_unsafe_hosts(spark):
    hosts = {"metadata.google.internal": True, " Metadata.Google.Internal. ": True, "169.254.169.254": True, "a.com": False}
    assert {r.h: r.u for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", U.unsafe_host(F.col("h")).alias("u")).collect()} == hosts


def test_block_list_and_suffixes_of_the_caller(spark):
    hits = spark.createDataFrame([(1, "https://x.mine.zz/"), (2, "https://bad.com/")], "seq long, url string")
    ok, no = candidates.split_candidates(hits, suffixes=("mine.zz", "com"), extra_blocks=["bad.com"])
    assert [r.registered_domain for r in ok.collect()] == ["x.mine.zz"] and [r.reason for r in no.collect()] == ["blocked_domain"]
