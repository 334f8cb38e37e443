"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEED_SCHEMA = "target_market string, publication_name string, website_url string, category string"
TRAFFIC_SCHEMA = "website_url string, monthly_visits string, pages_per_visit string, growth_rate string, traffic_source_url string"
LABEL_COLUMNS = (
    "domain", "homepage_url", "expected_label", "website_type", "target_market", "language", "activity_status", "label_reason",
    "evidence_summary", "reviewer_notes", "dataset_split", "evidence_url_1", "evidence_url_2", "reviewed_at", "review_method",
)
ARTICLE_WORDS = ("article", "news", "review", "post", "レビュー", "ニュース")
ORGANIC = "organic array<struct<link string, title string, snippet string, position string>>"
WEB = "web struct<results array<struct<url string, title string, description string, page_age string, language string>>>"


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEED_SCHEMA).csv(path, header=True, escape='"')


def read_manual_traffic(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAFFIC_SCHEMA).csv(path, header=True, escape='"')


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken rows) of a labelled CSV; the header must be LABEL_COLUMNS."""
    head = tuple(spark.read.csv(path, header=True, escape='"').columns)
    if head != LABEL_COLUMNS:
        raise ValueError(f"header is {head}")
    schema = ", ".join(f"{c} string" for c in LABEL_COLUMNS) + ", _broken string"
    d = spark.read.schema(schema).csv(path, header=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_broken", multiLine=True)
    read = F.length(F.concat_ws("", *LABEL_COLUMNS)) >= 0  # Spark refuses plans that read nothing but the broken lines
    return d.where("_broken is null").where(read).drop("_broken"), d.where("_broken is not null").where(read)


def search_hits_organic(responses: DataFrame, json: str = "body") -> DataFrame:
    """Hits of (response_id, query_text, body): http links only, the first of a URL in a response, missing positions counted."""
    items = F.from_json(json, ORGANIC).organic
    http = F.filter(items, lambda x: x.link.rlike("^https?://"))
    links = F.transform(http, lambda x: x.link)
    first = F.filter(http, lambda x, i: F.array_position(links, x.link) == i + 1)
    d = responses.select("response_id", "query_text", F.posexplode(first).alias("i", "x"))
    return d.select("response_id", "query_text", F.col("x.link").alias("url"), F.coalesce("x.title", F.lit("")).alias("title"), F.coalesce("x.snippet", F.lit("")).alias("snippet"), F.coalesce(F.col("x.position").try_cast("int"), F.col("i") + 1).alias("position"))


def search_hits_web(responses: DataFrame, json: str = "body") -> DataFrame:
    """Hits of (response_id, query_text, language, body): rows without URL or title left out, positions counted."""
    items = F.filter(F.from_json(json, WEB).web.results, lambda x: (F.coalesce(x.url, F.lit("")) != "") & (F.coalesce(x.title, F.lit("")) != ""))
    d = responses.select("response_id", "query_text", "language", F.posexplode(items).alias("i", "x"))
    return d.select(
        "response_id", "query_text", F.col("x.url").alias("url"), F.col("x.title").alias("title"), F.coalesce("x.description", F.lit("")).alias("snippet"),
        (F.col("i") + 1).alias("position"), F.try_to_timestamp(F.col("x.page_age"), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("published_at"), F.coalesce("x.language", "language").alias("language"),
    )


def sitemap_candidates(sitemaps: DataFrame, k: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """(domain, the ``keep`` columns, seq, url): the first ``k`` article-like locations of each (domain, xml); locations are cut in their row, before anything is exploded."""
    locs = F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1)
    kept = F.slice(F.filter(locs, lambda u: F.lower(u).rlike("|".join(ARTICLE_WORDS))), 1, k)
    return sitemaps.select("domain", *keep, F.posexplode(kept).alias("seq", "url"))


def first_candidates(candidates: DataFrame, k: int = 2) -> DataFrame:
    """The first ``k`` of each domain over all its sitemap files (domain, file, seq, url), seq counted anew."""
    w = Window.partitionBy("domain").orderBy("file", "seq")
    return candidates.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).select("domain", (F.col("_n") - 1).cast("int").alias("seq"), "url")


def media_outputs(media: DataFrame) -> dict[str, DataFrame]:
    """The three outputs of a media list."""
    s = F.col("status")
    return {"raw": media, "dashboard": media.where(s.isin("Qualified", "Upcoming")), "qualified": media.where(s == "Qualified")}


def write_media_list(media: DataFrame, folder: str) -> None:
    for name, df in media_outputs(media).items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_results_csv(results: DataFrame, path: str) -> None:
    """RFC 4180 quoting."""
    results.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)

