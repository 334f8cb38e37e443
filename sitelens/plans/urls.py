"""Queries over URLs and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.rules import with_blocks, with_suffixes
from ..operators import candidates as C
from ..sources import io
from .inputs import HITS, TENANTS, hits, table
from .registry import query

W = "WITH " + HITS


def accepted(spark, d):
    return C.split_candidates(hits(spark, d), TENANTS)[0]


@query(W + "SELECT seq, reason FROM (SELECT seq, CASE WHEN reason = 'blocked_social' THEN NULL ELSE reason END AS reason FROM parts)")
def b1_url_reject_reason(spark, d):
    return hits(spark, d).select("seq", U.url_reject_reason(F.col("url")).alias("reason"))


@query(W + "SELECT seq, normalized_url, homepage_url, registered_domain, subdomain FROM norm WHERE reason IS NULL OR reason = 'blocked_social'")
def b2_normalize_url(spark, d):
    return hits(spark, d).select("seq", U.normalize_url(F.col("url")).alias("n")).where("n is not null").select("seq", "n.*")


@query("SELECT host, regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS registered_domain, nullif(regexp_replace(regexp_replace(host, '[.]?[^.]+[.][^.]+$', ''), '^www([.]|$)', ''), '') AS subdomain, count(*) AS n FROM (SELECT lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) AS host FROM pages) GROUP BY ALL")
def b3_registered_domain(spark, d):
    host = F.lower(F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1))
    g = table(spark, d, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("host", U.registered_domain(F.col("host")).alias("registered_domain"), U.subdomain(F.col("host")).alias("subdomain"), "n")


@query(W + "SELECT seq, query, q AS stripped FROM named WHERE query <> ''")
def b4_strip_tracking_params(spark, d):
    q = F.regexp_extract("url", r"^[^?#]*\?([^#]*)", 1)
    return hits(spark, d).select("seq", q.alias("query"), U.strip_tracking_params(q).alias("stripped")).where("query <> ''")


@query("""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) AS host FROM pages),
b(h, reason) AS (VALUES ('m.youtube.com', 'blocked_video'), ('search.brave.com', 'blocked_search_engine'), ('t.co', 'blocked_shortener'), ('eu.store.steampowered.com', 'blocked_marketplace'), ('brave.com', NULL), ('notfacebook.com', NULL), ('facebook.com.org', NULL))
SELECT page_id, coalesce(b.reason, CASE WHEN page_id % 8 = 7 AND host = 'example.net' OR page_id % 8 = 7 AND ends_with(host, '.example.net') THEN 'blocked_domain' END) AS reason
FROM (SELECT *, CASE page_id % 8 WHEN 0 THEN 'm.youtube.com' WHEN 1 THEN 'search.brave.com' WHEN 2 THEN 't.co' WHEN 3 THEN 'eu.store.steampowered.com' WHEN 4 THEN 'brave.com' WHEN 5 THEN 'notfacebook.com' WHEN 6 THEN 'facebook.com.org' END AS h FROM p) x LEFT JOIN b USING (h)""")
def b5_block_reason(spark, d):
    """Every page's own host, with example.net blocked by the caller; seven in eight stand for a host on or beside the list."""
    k = F.col("page_id") % 8
    host = F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1)
    for i, h in enumerate(("m.youtube.com", "search.brave.com", "t.co", "eu.store.steampowered.com", "brave.com", "notfacebook.com", "facebook.com.org")):
        host = F.when(k == i, h).otherwise(host)
    return table(spark, d, "pages").select("page_id", U.block_reason(host, ["example.net"]).alias("reason"))


@query(W + "SELECT canonical_key, count(*) AS n FROM accepted GROUP BY canonical_key")
def b6_canonical_key(spark, d):
    return accepted(spark, d).groupBy("canonical_key").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, href, CASE WHEN href LIKE '/%' THEN o || href ELSE href END AS url FROM (
  SELECT page_id, regexp_extract(url, '^([^:]*://[^/?#]*)', 1) AS o, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)""")
def b7_absolute_url(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("href"))
    return p.select("page_id", "href", U.absolute_url(F.col("url"), F.col("href")).alias("url"))


@query("SELECT page_id, page_id % 9 = 0 AS unsafe FROM pages")
def b8_unsafe_host(spark, d):
    host = F.when(F.col("page_id") % 9 == 0, "metadata.google.internal").otherwise(F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1))
    return table(spark, d, "pages").select("page_id", U.unsafe_host(host).alias("unsafe"))


@query(r"""SELECT page_id, unnest(list_distinct(CASE WHEN url LIKE 'https:%' THEN [url, CASE WHEN url LIKE 'https://www.%' THEN 'https://' || url[13:] ELSE 'https://www.' || url[9:] END, 'http:' || url[7:]]
  ELSE [url, 'https:' || url[6:]] END)) AS variant FROM pages""")
def b9_canonical_variants(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(U.canonical_variants(F.col("url"))).alias("variant"))


@query(W + "SELECT seq, url, coalesce(reason, 'accepted') AS reason FROM norm")
def c3_split_candidates(spark, d):
    ok, bad = C.split_candidates(hits(spark, d), TENANTS)
    return ok.select("seq", "url", F.lit("accepted").alias("reason")).unionByName(bad.select("seq", "url", "reason"))


@query(W + """, f AS (SELECT canonical_key, min(seq) AS fs, arg_min(normalized_url, seq) AS fu, arg_min(query_text, seq) AS fq, arg_min(position, seq) AS fp FROM accepted GROUP BY 1),
o AS (SELECT a.canonical_key, min(seq) AS os, arg_min(normalized_url, seq) AS ou FROM accepted a JOIN f USING (canonical_key)
  WHERE seq > fs AND query_text = fq AND position = fp AND normalized_url LIKE 'https:%' AND fu LIKE 'http:%' GROUP BY 1)
SELECT a.seq, canonical_key, a.normalized_url, seq = coalesce(os, fs) AS kept, CASE WHEN seq >= os THEN ou ELSE fu END AS kept_url
FROM accepted a JOIN f USING (canonical_key) LEFT JOIN o USING (canonical_key)""")
def c4_dedup_candidates(spark, d):
    return C.dedup_candidates(accepted(spark, d)).select("seq", "canonical_key", "normalized_url", "kept", "kept_url")


@query(W + "SELECT count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS rejected, count(*) FILTER (reason IS NULL) - count(DISTINCT CASE WHEN reason IS NULL THEN site END) AS duplicates FROM norm")
def c5_candidate_counts(spark, d):
    return C.candidate_counts(hits(spark, d), TENANTS)


@query(W + "SELECT seq, canonical_key FROM accepted WHERE canonical_key NOT IN (SELECT canonical_key FROM accepted WHERE seq < 20)")
def c6_skip_known(spark, d):
    a = accepted(spark, d)
    return C.skip_known(a, a.where("seq < 20").select("canonical_key").distinct()).select("seq", "canonical_key")


@query(W + "SELECT seq, canonical_key, row_number() OVER (PARTITION BY canonical_key ORDER BY query_seq, seq) > 1 AS duplicate FROM accepted")
def c7_dedup_across_queries(spark, d):
    return C.dedup_across_queries(accepted(spark, d)).select("seq", "canonical_key", "duplicate")


@query("""WITH o AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, NULL AS description, 'old' AS homepage_url FROM customer WHERE c_custkey % 2 = 0),
n AS (SELECT c_custkey AS k, 'new ' || c_name AS name, c_mktsegment AS description, 'new' AS homepage_url FROM customer WHERE c_custkey % 2 = 1 OR c_custkey % 5 < 3)
SELECT coalesce(o.k, n.k) AS canonical_key, coalesce(nullif(o.name, ''), n.name) AS name, coalesce(o.description, n.description) AS description, coalesce(o.homepage_url, n.homepage_url) AS homepage_url FROM o FULL JOIN n ON o.k = n.k""")
def c8_upsert_websites(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    old = c.where(k % 2 == 0).select(k.alias("canonical_key"), F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("name"), F.lit(None).cast("string").alias("description"), F.lit("old").alias("homepage_url"))
    new = c.where((k % 2 == 1) | (k % 5 < 3)).select(k.alias("canonical_key"), F.concat(F.lit("new "), "c_name").alias("name"), F.col("c_mktsegment").alias("description"), F.lit("new").alias("homepage_url"))
    return C.upsert_websites(old, new)


@query("""WITH t AS (SELECT l_orderkey AS job, l_suppkey AS site, min(l_linenumber) AS seq FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY 1, 2),
n AS (SELECT l_orderkey AS job, l_suppkey AS site, min(l_linenumber) AS seq FROM lineitem GROUP BY 1, 2)
SELECT * FROM t UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.job = n.job AND t.site = n.site)""")
def c9_insert_if_absent(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_suppkey").alias("site"), F.col("l_linenumber").alias("seq"))
    target = rows.where("job % 4 = 0").groupBy("job", "site").agg(F.min("seq").alias("seq"))
    return C.insert_if_absent(target, rows, ["job", "site"])


@query("SELECT page_id AS seq, url, greatest(0, (SELECT count(*) FROM pages) - 40) AS skipped FROM pages ORDER BY page_id LIMIT 40")
def c10_limit_with_skipped(spark, d):
    return C.limit_with_skipped(table(spark, d, "pages").select(F.col("page_id").alias("seq"), "url"), 40)


@query("""WITH j AS (SELECT c_custkey AS job_id, n_name AS market, CASE WHEN c_custkey % 4 = 0 THEN 'ja' ELSE 'en' END AS language, c_custkey % 30 AS most,
    list_distinct([lower(c_mktsegment), 'esports']) AS cats FROM customer JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT * FROM (VALUES (0, 0, 'independent {c} publication {m}'), (0, 1, 'regional {c} news website {m}'), (0, 2, '{c} editorial media {m}'), (0, 3, '{c} review publication {m}'), (0, 4, '{c} magazine {m}'),
   (0, 5, 'emerging {c} media outlet {m}'), (0, 6, 'local {c} news site {m}'), (1, 0, 'Japanese {c} news websites'), (1, 1, 'Japanese {c} media'), (1, 2, 'Japanese {c} review publications'), (1, 3, 'Japan {c} news websites'),
   (1, 4, 'Japan independent {c} media'), (1, 5, '日本の{j}サイト'), (1, 6, '日本の{j}メディア'), (1, 7, '日本の{j}レビューサイト'), (1, 8, '日本の{j}ニュース'), (1, 9, '日本のインディー{j}メディア'), (1, 10, '{j}業界ニュース 日本'), (1, 11, '{j}雑誌 オンライン')) AS t(jp, i, text)),
b AS (SELECT job_id, most, ci, i, replace(replace(replace(text, '{c}', c), '{m}', market), '{j}', CASE WHEN c = 'esports' THEN 'eスポーツ' ELSE 'ゲームメディア' END) AS q
  FROM (SELECT *, unnest(range(1, len(c2) + 1)) AS ci, unnest(c2) AS c FROM (SELECT job_id, market, language, most, [lower(cats_a), 'esports'] AS c2 FROM (SELECT c_custkey AS job_id, n_name AS market, CASE WHEN c_custkey % 4 = 0 THEN 'ja' ELSE 'en' END AS language, c_custkey % 30 AS most, c_mktsegment AS cats_a FROM customer JOIN nation ON c_nationkey = n_nationkey))) x
  JOIN t ON jp = CASE WHEN language = 'ja' THEN 1 ELSE 0 END),
u AS (SELECT job_id, most, q, row_number() OVER (PARTITION BY job_id ORDER BY ci, i) AS pos, count(*) OVER (PARTITION BY job_id) AS total
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id, lower(q) ORDER BY ci, i) AS n FROM b) WHERE n = 1)
SELECT job_id, (page - 1) * total + pos AS seq, q AS query_text, page FROM (SELECT *, unnest(range(1, 6)) AS page FROM u) WHERE (page - 1) * total + pos <= most""")
def c1_generate_queries(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    jobs = c.select(
        F.col("c_custkey").alias("job_id"), F.col("n_name").alias("market"), F.when(F.col("c_custkey") % 4 == 0, "ja").otherwise("en").alias("language"),
        F.array(F.lower("c_mktsegment"), F.lit("esports")).alias("categories"), F.array().cast("array<string>").alias("keywords"), (F.col("c_custkey") % 30).alias("maximum_queries"),
    )
    return C.generate_queries(jobs).select("job_id", "seq", "query_text", "page")


@query("SELECT c_custkey, [c_mktsegment, 'x', c_name] AS items FROM customer")
def c2_clean_list(spark, d):
    raw = F.array(F.concat(F.lit("  "), "c_mktsegment"), F.lit(""), F.lower("c_mktsegment"), F.lit("x"), F.concat("c_name", F.lit(" ")), F.lit("X"))
    return table(spark, d, "customer").select("c_custkey", C.clean_list(raw).alias("items"))


@query("SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def a8_resume_unprocessed(spark, d):
    p = table(spark, d, "pages").select("page_id")
    return C.resume_unprocessed(p, p.where("page_id % 3 = 0"), "page_id")


@query("""SELECT response_id, list_element([url], 1) AS url, row_number() OVER (PARTITION BY response_id ORDER BY page_id) AS position, title FROM (
  SELECT page_id, page_id // 10 AS response_id, url, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, row_number() OVER (PARTITION BY page_id // 10, url ORDER BY page_id) AS n FROM pages) WHERE n = 1""")
def a4_search_hits(spark, d):
    p = table(spark, d, "pages").select("page_id", F.floor(F.col("page_id") / 10).alias("response_id"), "url", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"))
    items = F.transform(F.sort_array(F.collect_list(F.struct("page_id", "url", "title"))), lambda x: F.struct(x.url.alias("link"), x.title.alias("title")))
    bodies = p.groupBy("response_id").agg(F.to_json(F.struct(items.alias("organic"))).alias("body")).withColumn("query_text", F.lit("q"))
    return io.search_hits_organic(bodies).select("response_id", "url", "position", "title")


@query("""WITH x AS (SELECT regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS domain, page_id, regexp_replace(url, '/(fr|es)/', '/news/') AS u FROM pages),
k AS (SELECT domain, u, row_number() OVER (PARTITION BY domain ORDER BY page_id) - 1 AS seq FROM x WHERE lower(u) SIMILAR TO '.*(article|news|review|post).*')
SELECT domain, seq, u AS url FROM k WHERE seq < 2""")
def a7_sitemap_candidates(spark, d):
    x = table(spark, d, "pages").select(F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1).alias("domain"), "page_id", F.regexp_replace("url", "/(fr|es)/", "/news/").alias("u"))
    # a sitemap file holds the pages of one range of ids, so its size is bounded however many pages a domain has
    locs = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", "u"))), lambda s: F.concat(F.lit("<url><loc> "), s.u, F.lit(" </loc></url>"))), "\n")
    files = x.groupBy("domain", F.floor(F.col("page_id") / 1000).alias("file")).agg(locs.alias("xml"))
    return io.first_candidates(io.sitemap_candidates(files, keep=["file"]))


#: Rules and blocked hosts as tables: made from the pages' own hosts, with a wildcard and an exception.
RULE_TABLES = r"""
h AS (SELECT page_id, lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) AS host FROM pages),
n AS (SELECT *, string_split(host, '.') AS l FROM h),
r AS (SELECT DISTINCT list_slice(l, len(l), len(l))[1] AS rule FROM n UNION SELECT DISTINCT '*.' || array_to_string(list_slice(l, len(l) - 1, len(l)), '.') FROM n WHERE l[-1] = 'net' UNION SELECT '!blog.example.net'),
b AS (SELECT host, CASE WHEN min(page_id) % 2 = 0 THEN 'blocked_spam' ELSE 'blocked_domain' END AS reason FROM h WHERE page_id % 3 = 0 GROUP BY host)"""


@query(f"""WITH {RULE_TABLES},
x AS (SELECT page_id, host, l, CASE WHEN l[-1] = 'net' AND array_to_string(list_slice(l, len(l) - 2, len(l)), '.') = 'blog.example.net' THEN 2 WHEN l[-1] = 'net' AND len(l) > 2 THEN 3 ELSE 1 END AS suffix_labels FROM n)
SELECT page_id, suffix_labels, CASE WHEN len(l) > suffix_labels THEN array_to_string(list_slice(l, len(l) - suffix_labels, len(l)), '.') END AS registered_domain FROM x""")
def b3_suffix_table(spark, d):
    """Registered domains by a table of suffix rules."""
    pages, host = table(spark, d, "pages"), F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1)
    last = lambda k: F.call_function("substring_index", F.lower(host), F.lit("."), F.lit(-k))
    rules = pages.select(last(1).alias("rule")).union(pages.where(last(1) == "net").select(F.concat(F.lit("*."), last(2)))).union(pages.select(F.lit("!blog.example.net"))).distinct()
    return with_suffixes(pages, host, rules).select("page_id", "suffix_labels", "registered_domain")


@query(f"""WITH {RULE_TABLES}, e AS (SELECT page_id, host, array_to_string(list_slice(l, i, len(l)), '.') AS e, len(l) - i AS k FROM n, unnest(range(1, len(l) + 1)) u(i))
SELECT page_id, arg_max(reason, k) AS block_reason FROM e LEFT JOIN b ON e.e = b.host GROUP BY page_id""")
def b5_block_table(spark, d):
    """Block reasons by a table of blocked hosts: those of every third page, and all below them."""
    pages, host = table(spark, d, "pages"), F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1)
    third = pages.where("page_id % 3 = 0").groupBy(F.lower(host).alias("host")).agg(F.min("page_id").alias("k"))
    blocked = third.select("host", F.when(F.col("k") % 2 == 0, "blocked_spam").otherwise("blocked_domain").alias("reason"))
    return with_blocks(pages, host, blocked).select("page_id", "block_reason")
