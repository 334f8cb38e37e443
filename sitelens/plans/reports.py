"""Queries of listings and job reports: an order is a job, a line's supplier a site."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..sources import io
from .inputs import table
from .registry import query
from .sites import MEDIA, media


def registry_sites(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("d"), F.col("c_custkey").cast("string"), F.lit(".com")).alias("domain"), F.col("n_name").alias("country"), F.col("c_mktsegment").alias("category"), F.col("c_acctbal").alias("balance"))


SITES = "s AS (SELECT c_custkey AS id, c_name AS name, 'd' || c_custkey || '.com' AS domain, n_name AS country, c_mktsegment AS category, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query("WITH " + SITES + ", f AS (SELECT * FROM s WHERE category = 'BUILDING' AND (lower(name) LIKE '%1%' OR lower(domain) LIKE '%1%')) SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY balance DESC, id LIMIT 25 OFFSET 25")
def i1_list_websites(spark, d):
    return R.list_websites(registry_sites(spark, d), {"category": "BUILDING"}, "1", [F.col("balance").desc(), F.col("id")], 2, 25)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'approved' WHEN o_orderkey % 4 = 1 THEN 'needs_review' WHEN o_orderstatus = 'F' THEN 'rejected' WHEN o_orderstatus = 'O' THEN 'verified' ELSE 'needs_review' END AS decision FROM orders")
def i3_review_decision(spark, d):
    manual = F.when(F.col("o_orderkey") % 4 == 0, "approved").when(F.col("o_orderkey") % 4 == 1, "needs_review").otherwise("unreviewed")
    auto = F.when(F.col("o_orderstatus") == "F", "rejected").when(F.col("o_orderstatus") == "O", "verified").otherwise("uncertain")
    return table(spark, d, "orders").select("o_orderkey", R.review_decision(manual, auto).alias("decision"))


@query("""WITH """ + SITES + """, t AS (SELECT user_id AS id, max_by(value, (ts, event_id)) AS visits FROM events GROUP BY 1), o AS (SELECT o_custkey AS id, count(*) AS n_orders FROM orders GROUP BY 1)
SELECT s.id, name, visits, n_orders, CASE WHEN s.id % 4 = 0 THEN 'approved' WHEN s.id % 4 = 1 THEN 'needs_review' WHEN balance < 0 THEN 'rejected' WHEN balance > 5000 THEN 'verified' ELSE 'needs_review' END AS effective_review_decision
FROM s LEFT JOIN t USING (id) LEFT JOIN o USING (id)""")
def i4_website_summary(spark, d):
    e = R.latest_by(table(spark, d, "events").select(F.col("user_id").alias("id"), "ts", "event_id", F.col("value").alias("visits")), "id", ["ts", "event_id"]).select("id", "visits")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n_orders"))
    manual = F.when(F.col("id") % 4 == 0, "approved").when(F.col("id") % 4 == 1, "needs_review").otherwise("unreviewed").alias("manual_review_status")
    auto = F.when(F.col("balance") < 0, "rejected").when(F.col("balance") > 5000, "verified").otherwise("uncertain").alias("current_verification_status")
    return R.website_summary(registry_sites(spark, d).select("id", "name", manual, auto), e, o, "id").drop("manual_review_status", "current_verification_status")


@query("SELECT user_id, event_id, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events WHERE event_type = 'error') WHERE n <= 20")
def i5_newest_errors(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    return R.newest_rows(e, "user_id", [F.col("ts").desc(), F.col("event_id")]).select("user_id", "event_id", "rank")


#: Suppliers are sites. Lines are verifications by ship date, those that came back sources, the large ones contacts; events whose user number is a site's are its traffic and errors.
DETAIL = """WITH s AS (SELECT s_suppkey AS site FROM supplier),
v AS (SELECT l_suppkey AS site, l_orderkey * 10 + l_linenumber AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber) AS n FROM lineitem),
c AS (SELECT l_suppkey AS site, l_orderkey * 10 + l_linenumber AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R'),
t AS (SELECT user_id AS site, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events WHERE event_type <> 'error'),
e AS (SELECT user_id AS site, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events WHERE event_type = 'error'),
k AS (SELECT l_suppkey AS site, l_orderkey * 10 + l_linenumber AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 99 END, l_linestatus <> 'F', -l_discount, l_shipdate DESC, l_orderkey * 10 + l_linenumber) AS n FROM lineitem WHERE l_quantity > 40)
SELECT site, {} FROM s""".format(", ".join(f"coalesce((SELECT string_agg(id, ',' ORDER BY n) FROM {t} WHERE {t}.site = s.site AND n <= {n}), '') AS {name}" for t, n, name in (("v", 30, "verification_history"), ("t", 30, "traffic_history"), ("k", 30, "contacts"), ("c", 30, "discovery_sources"), ("e", 20, "recent_processing_errors"))))


@query(DETAIL)
def i5_website_histories(spark, d):
    line = table(spark, d, "lineitem").withColumns({"site": F.col("l_suppkey"), "id": F.col("l_orderkey") * 10 + F.col("l_linenumber")})
    event = table(spark, d, "events").withColumns({"site": F.col("user_id"), "id": F.col("event_id")})
    histories = {
        "verification_history": (line.select("site", "id", F.col("l_shipdate").alias("at")), 30),
        "traffic_history": (event.where("event_type <> 'error'").select("site", "id", F.col("ts").alias("at")), 30),
        "discovery_sources": (line.where("l_returnflag = 'R'").select("site", "id", F.col("l_shipdate").alias("at")), 30),
        "recent_processing_errors": (event.where("event_type = 'error'").select("site", "id", F.col("ts").alias("at")), 20),
    }
    own = {name: (rows, [-F.unix_micros(F.col("at").cast("timestamp")), F.col("id")], most) for name, (rows, most) in histories.items()}
    best = line.where("l_quantity > 40").select("site", "id", F.col("l_returnflag").alias("contact_type"), (F.col("l_linestatus") == "F").alias("is_primary"), F.col("l_discount").cast("double").alias("confidence"), F.col("l_shipdate").alias("discovered_at"))
    own["contacts"] = (best, [*R.contact_order(("R", "N")), F.col("id")], 30)
    sites = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"))
    found = R.website_detail(sites, own)
    return found.select("site", *[F.array_join(F.transform(n, lambda x: x["id"].cast("string")), ",").alias(n) for n in own])


#: Every line is a source. Lines that came back or were accepted are verified too, those still under way are not.
STATUS = "CASE WHEN l_returnflag = 'R' THEN 'rejected' WHEN l_quantity >= 25 THEN 'verified' WHEN l_quantity >= 5 THEN 'uncertain' ELSE 'fetch_failed' END"
LINES = f"v AS (SELECT l_orderkey % 500 AS job_id, l_suppkey AS site, l_linenumber AS attempt, l_shipdate AS t, l_orderkey AS id, {STATUS} AS status FROM lineitem WHERE l_returnflag <> 'N')"
VERIFIED = LINES + ", last AS (SELECT job_id, site, max_by(status, (attempt, t, id)) AS status, max(attempt) AS attempt FROM v GROUP BY 1, 2)"
TRAFFIC = "tr AS (SELECT user_id % 100 AS site, max_by(value, (ts, event_id)) AS visits FROM events WHERE event_type <> 'error' GROUP BY 1)"


def verifications(spark, d):
    q = F.col("l_quantity")
    s = F.when(F.col("l_returnflag") == "R", "rejected").when(q >= 25, "verified").when(q >= 5, "uncertain").otherwise("fetch_failed")
    return table(spark, d, "lineitem").where("l_returnflag <> 'N'").select((F.col("l_orderkey") % 500).alias("job_id"), F.col("l_suppkey").alias("site"), F.col("l_linenumber").alias("attempt"), F.col("l_shipdate").alias("verified_at"), F.col("l_orderkey").alias("id"), s.alias("status"))


def sources(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("job_id"), F.col("l_suppkey").alias("site"), (F.col("l_partkey") % 3).alias("query"))


def errors(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").select((F.col("event_id") % 500).alias("job_id"), (F.col("user_id") % 100).alias("site"))


def traffic(spark, d):
    e = table(spark, d, "events").where("event_type <> 'error'").select((F.col("user_id") % 100).alias("site"), "ts", "event_id", F.col("value").alias("visits"))
    return R.latest_by(e, "site", ["ts", "event_id"]).select("site", "visits")


RESULTS = "WITH " + VERIFIED + ", " + TRAFFIC + """, m AS (SELECT l_orderkey % 500 AS job_id, l_suppkey AS site, count(*) AS source_count, array_to_string(list_sort(list(DISTINCT l_partkey % 3)), ',') AS queries FROM lineitem GROUP BY 1, 2),
f AS (SELECT m.*, status, attempt, visits FROM m LEFT JOIN last USING (job_id, site) LEFT JOIN tr USING (site)) """


@query(RESULTS + "SELECT * FROM f")
def i6_job_results(spark, d):
    jobs = table(spark, d, "orders").select((F.col("o_orderkey") % 500).alias("job_id"))
    r = R.job_results(jobs, sources(spark, d), verifications(spark, d), traffic=traffic(spark, d))
    return r.withColumn("queries", F.array_join("queries", ","))


@query(RESULTS + "SELECT job_id, site, source_count, status, (SELECT count(*) FROM f WHERE status = 'verified') AS total FROM f WHERE status = 'verified' ORDER BY job_id, site LIMIT 20 OFFSET 20")
def i6_job_results_page(spark, d):
    """The second page of 20 verified sites."""
    jobs = table(spark, d, "orders").select((F.col("o_orderkey") % 500).alias("job_id"))
    return R.job_results(jobs, sources(spark, d), verifications(spark, d), "verified", page=2, size=20).select("job_id", "site", "source_count", "status", "total")


JOBS = """x AS (SELECT DISTINCT l_orderkey % 500 AS job_id, l_suppkey AS site FROM lineitem), q AS (SELECT o_orderkey % 500 AS job_id, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1)"""


def job_queries(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "pending").otherwise("failed")
    return table(spark, d, "orders").select((F.col("o_orderkey") % 500).alias("job_id"), s.alias("status"))


@query("WITH " + VERIFIED + ", " + JOBS + """, e AS (SELECT event_id % 500 AS job_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), ct AS (SELECT event_id % 500 AS job_id, count(DISTINCT user_id) AS n FROM events WHERE event_type = 'signup' GROUP BY 1),
w AS (SELECT s_suppkey AS site, CASE s_nationkey % 4 WHEN 0 THEN 'qualified' WHEN 1 THEN 'upcoming' WHEN 2 THEN 'traffic_missing' ELSE 'rejected' END AS ql FROM supplier),
g AS (SELECT job_id, count(*) AS n_sites, count(*) FILTER (status = 'verified') AS n_verified, count(*) FILTER (status = 'rejected') AS n_rejected, count(*) FILTER (status = 'uncertain') AS n_uncertain, count(*) FILTER (status <> 'fetch_failed') AS n_fetched,
  count(*) FILTER (ql = 'qualified') AS n_qualified, count(*) FILTER (ql = 'upcoming') AS n_upcoming, count(*) FILTER (ql = 'traffic_missing') AS n_traffic_missing FROM x LEFT JOIN last USING (job_id, site) LEFT JOIN w USING (site) GROUP BY job_id)
SELECT g.*, coalesce(e.n, 0) AS n_errors, coalesce(q.n, 0) AS n_queries, coalesce(f, 0) AS n_queries_completed, coalesce(ct.n, 0) AS n_contacts FROM g LEFT JOIN e USING (job_id) LEFT JOIN q USING (job_id) LEFT JOIN ct USING (job_id)""")
def i7_job_counters(spark, d):
    contacts = table(spark, d, "events").where("event_type = 'signup'").select((F.col("event_id") % 500).alias("job_id"), F.col("user_id").alias("contact"))
    k = F.col("s_nationkey") % 4
    sites = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.when(k == 0, "qualified").when(k == 1, "upcoming").when(k == 2, "traffic_missing").otherwise("rejected").alias("qualification"))
    return R.job_counters(sources(spark, d), verifications(spark, d), errors(spark, d), job_queries(spark, d), contacts, sites)


@query("WITH " + LINES + ", " + JOBS + """, er AS (SELECT event_id % 500 AS job_id, user_id % 100 AS site FROM events WHERE event_type = 'error'),
o AS (SELECT job_id, count(*) AS n FROM x WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.job_id = x.job_id AND v.site = x.site) AND NOT EXISTS (SELECT 1 FROM er WHERE er.job_id = x.job_id AND er.site = x.site) GROUP BY 1),
b AS (SELECT job_id, count(*) AS n FROM er GROUP BY 1), j AS (SELECT DISTINCT job_id FROM x)
SELECT job_id, coalesce(o.n, 0) AS n_open, coalesce(b.n, 0) AS n_errors, coalesce(p, 0) AS n_pending, CASE WHEN o.n > 0 OR p > 0 THEN 'incomplete' WHEN b.n > 0 THEN 'completed_with_errors' ELSE 'completed' END AS final_status
FROM j LEFT JOIN o USING (job_id) LEFT JOIN b USING (job_id) LEFT JOIN q USING (job_id)""")
def i8_job_completeness(spark, d):
    return R.job_completeness(sources(spark, d), verifications(spark, d), errors(spark, d), job_queries(spark, d))


@query("SELECT o_custkey AS job_id, count(*) AS n_queries, count(*) FILTER (o_orderstatus IN ('F', 'P')) AS executed, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'O') AS skipped FROM orders GROUP BY 1")
def i9_run_summary(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    return R.run_summary(table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), s.alias("status")))


@query("SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 30 OFFSET 30")
def i10_list_jobs(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    return R.page_of(o, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 2, 30)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'approved' ELSE 'unreviewed' END AS manual_review_status FROM customer")
def i11_apply_review(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.lit("unreviewed").alias("manual_review_status"))
    return R.apply_review(c, c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("approved").alias("decision")), "c_custkey")


@query("WITH " + SITES + " SELECT id, name, domain FROM s WHERE category = 'MACHINERY' AND (contains(domain, '2') OR contains(lower(name), '2'))")
def i15_filter_results(spark, d):
    return R.filter_results(registry_sites(spark, d).withColumnRenamed("category", "status"), "MACHINERY", "2").select("id", "name", "domain")


@query("WITH " + MEDIA + """ SELECT row_number() OVER (PARTITION BY status ORDER BY coalesce(est, 0) DESC, seq) AS "Rank", publication_name AS "Name", 'https://s' || seq % 40 || '.com/' AS "Website", market AS "Market", category AS "Category",
  coalesce(est::BIGINT::VARCHAR, 'Needs Verification') AS "Pageviews", coalesce(growth_rate, 'N/A') AS "Growth", CASE WHEN growth_rate LIKE '-%' THEN 'down' WHEN growth_rate = '0%' THEN 'flat' WHEN growth_rate IS NULL THEN 'up' ELSE 'up' END AS "Direction", status AS "Status",
  CASE WHEN market = 'Canada' THEN 'May include global audience. Traffic might not be solely Canadian.' ELSE '' END AS "Notes" FROM m""")
def i16_ranked_export(spark, d):
    from ..operators.traffic import rank_media

    return R.ranked_export(rank_media(media(spark, d)).withColumnRenamed("publication_name", "name").withColumn("direction", F.coalesce("direction", F.lit("up"))))


@query("SELECT event_id, 'search' AS stage, left(repeat(event_type, 60), 255) AS error_code, left(props, 2000) AS error_message FROM events WHERE event_type = 'error'")
def i17_error_rows(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select("event_id", F.repeat("event_type", 60).alias("code"), F.col("props").alias("message"))
    return R.error_rows(e, "search")


@query("WITH " + MEDIA + " SELECT seq, 'dashboard' AS output FROM m UNION ALL SELECT seq, 'qualified' FROM m WHERE status = 'Qualified' UNION ALL SELECT seq, 'raw' FROM m")
def a5_media_outputs(spark, d):
    out = None
    for name, df in io.media_outputs(media(spark, d)).items():
        part = df.select("seq", F.lit(name).alias("output"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT l_orderkey AS job_id, string_agg(DISTINCT l_shipmode, '; ' ORDER BY l_shipmode) AS queries FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1")
def a6_export_results(spark, d):
    q = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("queries"))
    return R.export_results(q, ["job_id", "queries"])
