"""Tables of the driver seen as the library's inputs, each with the SQL that derives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every host of the test pages lies under these, so they count as multi-tenant.
TENANTS = ("example.com", "example.net", "example.org")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits from pages; one in eight kinds of URL is spoilt in each of several ways."""
    p = table(spark, sf_dir, "pages")
    host, rest = F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1), F.regexp_replace("url", r"^[^:]*://[^/?#]*", "")
    k = F.col("page_id") % 16
    url = (
        F.when(k == 1, F.concat(F.lit("ftp://"), host, rest))
        .when(k == 3, F.concat(F.lit("https://user:pw@"), host, rest))
        .when(k == 5, F.concat(F.lit("https://"), host, F.lit(":8443"), rest))
        .when(k == 7, F.concat(F.lit("//"), host, rest))
        .when(k == 9, F.concat(F.lit("http://localhost"), rest))
        .when(k == 11, F.concat(F.lit("https://m.facebook.com"), rest))
        .when(k == 13, F.concat(F.lit("http://10.0.0.1"), rest))
        .otherwise(F.col("url"))
    )
    lang = F.regexp_extract("url", r"^[^:]*://[^/]*/([a-z]+)/", 1)
    return p.select(F.col("page_id").alias("seq"), (F.col("page_id") % 7).alias("query_seq"), url.alias("url"), lang.alias("query_text"), (F.col("page_id") % 10 + 1).alias("position"))


HITS = r"""
hits AS (
  SELECT page_id AS seq, page_id % 7 AS query_seq, regexp_extract(url, '^[^:]*://[^/]*/([a-z]+)/', 1) AS query_text, page_id % 10 + 1 AS position,
    CASE page_id % 16 WHEN 1 THEN 'ftp://' || h || r WHEN 3 THEN 'https://user:pw@' || h || r WHEN 5 THEN 'https://' || h || ':8443' || r
      WHEN 7 THEN '//' || h || r WHEN 9 THEN 'http://localhost' || r WHEN 11 THEN 'https://m.facebook.com' || r WHEN 13 THEN 'http://10.0.0.1' || r ELSE url END AS url
  FROM (SELECT *, regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS h, regexp_replace(url, '^[^:]*://[^/?#]*', '') AS r FROM pages)),
parts AS (
  SELECT *, CASE WHEN url LIKE 'ftp:%' THEN 'unsupported_scheme' WHEN url LIKE '//%' THEN 'invalid_url' WHEN url LIKE '%user:pw@%' THEN 'embedded_credentials'
      WHEN url LIKE 'http://localhost%' THEN 'localhost' WHEN url LIKE 'http://10.%' THEN 'raw_ip_not_allowed' WHEN url LIKE '%:8443%' THEN 'unsupported_port'
      WHEN url LIKE '%facebook.com%' THEN 'blocked_social' END AS reason,
    regexp_extract(url, '^([^:]*)://', 1) AS scheme, lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) AS host,
    regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query FROM hits),
named AS (
  SELECT *, regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS registered_domain,
    nullif(regexp_replace(regexp_replace(host, '[.]?[^.]+[.][^.]+$', ''), '^www([.]|$)', ''), '') AS subdomain,
    array_to_string(list_transform(list_filter(list_transform(list_filter(string_split(query, '&'), lambda kv: kv <> ''),
        lambda kv: {k: url_decode(replace(split_part(kv, '=', 1), '+', ' ')), v: CASE WHEN contains(kv, '=') THEN url_decode(replace(kv[instr(kv, '=') + 1:], '+', ' ')) ELSE '' END}),
      lambda x: lower(x.k) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'utm_id', 'gclid', 'dclid', 'fbclid', 'msclkid', 'mc_cid', 'mc_eid')),
      lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&') AS q FROM parts),
norm AS (
  SELECT *, concat_ws('.', subdomain, registered_domain) AS site,
    scheme || '://' || concat_ws('.', subdomain, registered_domain) || CASE WHEN path = '' THEN '/' ELSE replace(replace(url_encode(path), '%2F', '/'), '%25', '%') END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS normalized_url,
    scheme || '://' || concat_ws('.', subdomain, registered_domain) || '/' AS homepage_url FROM named),
accepted AS (SELECT *, site AS canonical_key FROM norm WHERE reason IS NULL)
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions from labelled documents: expected label from quality, status from bands of the text's length, scores from hashes of the id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    c = F.col
    status = F.when(c("n_chars") >= 3000, "verified").when(c("n_chars") < 800, "rejected").when(c("n_chars") % 11 == 0, "fetch_failed").otherwise("uncertain")
    return d.select(
        c("doc_id").cast("string").alias("domain"),
        F.when(c("toxic") == 1, "uncertain").when(c("quality") == 1, "gaming_media").otherwise("not_gaming_media").alias("expected_label"),
        F.when(c("doc_id") % 10 < 7, "development").otherwise("test").alias("dataset_split"),
        status.alias("predicted_status"),
        "source",
        (c("doc_id") % 31).alias("gaming_score"),
        (c("doc_id") % 26).alias("media_score"),
        (c("doc_id") % 21).alias("market_score"),
        (c("doc_id") % 6).alias("technical_score"),
        (c("n_chars") % 101).alias("total_score"),
        F.when(c("doc_id") % 13 == 0, 0.9).otherwise(0.3).alias("hard_rejection_confidence"),
        F.when(c("doc_id") % 17 == 0, "insufficient_evidence").alias("decision_override"),
        (c("n_chars") > 500).alias("usable"),
    )


PREDICTIONS = """
preds AS (
  SELECT d.doc_id::VARCHAR AS domain, CASE WHEN toxic = 1 THEN 'uncertain' WHEN quality = 1 THEN 'gaming_media' ELSE 'not_gaming_media' END AS expected_label,
    CASE WHEN d.doc_id % 10 < 7 THEN 'development' ELSE 'test' END AS dataset_split,
    CASE WHEN n_chars >= 3000 THEN 'verified' WHEN n_chars < 800 THEN 'rejected' WHEN n_chars % 11 = 0 THEN 'fetch_failed' ELSE 'uncertain' END AS predicted_status,
    source, d.doc_id % 31 AS gaming_score, d.doc_id % 26 AS media_score, d.doc_id % 21 AS market_score, d.doc_id % 6 AS technical_score, n_chars % 101 AS total_score,
    CASE WHEN d.doc_id % 13 = 0 THEN 0.9 ELSE 0.3 END AS hard_rejection_confidence, CASE WHEN d.doc_id % 17 = 0 THEN 'insufficient_evidence' END AS decision_override, n_chars > 500 AS usable
  FROM documents d JOIN labels USING (doc_id)),
judged AS (
  SELECT *, CASE WHEN expected_label = 'uncertain' THEN 'IGNORE' WHEN predicted_status = 'verified' THEN CASE WHEN expected_label = 'gaming_media' THEN 'TP' ELSE 'FP' END
      WHEN predicted_status = 'rejected' THEN CASE WHEN expected_label = 'gaming_media' THEN 'FN' ELSE 'TN' END ELSE 'ABSTAIN' END AS outcome,
    (expected_label = 'gaming_media' AND predicted_status = 'verified') OR (expected_label = 'not_gaming_media' AND predicted_status = 'rejected')
      OR (expected_label = 'uncertain' AND predicted_status IN ('uncertain', 'fetch_failed')) AS correct FROM preds)
"""
