"""Traffic evidence and qualification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lists import present
from ..functions.urls import clean_url

MINIMUM_PAGEVIEWS = 1_000_000
RANK_PARTS = 64


def estimated_pageviews(visits: Column, per_visit: Column) -> Column:
    """Exact product of decimals, rounded half up to cents; null for negative or missing factors."""
    product = (visits.cast("decimal(20,2)") * per_visit.cast("decimal(10,4)")).cast("decimal(24,2)")
    return F.when((visits >= 0) & (per_visit >= 0), product)


def metric_violations(kind: Column, visits: Column, per_visit: Column, pageviews: Column, confidence: Column) -> Column:
    """Codes of the rules that a traffic metric breaks."""
    bad = lambda c: F.isnan(c.cast("double")) | (c.cast("double") == float("inf")) | (c < 0)
    return present(
        F.when(~kind.isin("monthly_visits", "monthly_pageviews", "estimated_pageviews"), "unknown_metric_type"),
        F.when((kind == "monthly_visits") & visits.isNull(), "visits_required"),
        F.when((kind == "monthly_pageviews") & pageviews.isNull(), "pageviews_required"),
        F.when((kind == "estimated_pageviews") & (visits.isNull() | per_visit.isNull()), "visits_and_pages_required"),
        F.when(bad(visits) | bad(per_visit) | bad(pageviews), "negative_or_not_finite"),
        F.when((confidence < 0) | (confidence > 1), "confidence_out_of_range"),
    )


def resolve_pageviews(kind: Column, visits: Column, per_visit: Column, pageviews: Column) -> Column:
    return F.when(kind == "estimated_pageviews", estimated_pageviews(visits, per_visit)).when(kind == "monthly_pageviews", pageviews.cast("decimal(24,2)"))


def qualification_status(verification: Column, pageviews: Column, minimum: int = MINIMUM_PAGEVIEWS) -> Column:
    return (
        F.when(verification == "rejected", "rejected")
        .when(verification.isin("uncertain", "fetch_failed"), "needs_review")
        .when(pageviews.isNull(), "traffic_missing")
        .when(pageviews >= minimum, "qualified")
        .otherwise("upcoming")
    )


def latest_traffic(metrics: DataFrame, site: str = "website_id") -> DataFrame:
    """Newest metric of each site by retrieved_at, the larger id on a tie; one aggregate, no sort."""
    row = F.struct(*metrics.columns)
    return metrics.groupBy(site).agg(F.max_by(row, F.struct("retrieved_at", "id")).alias("m")).select("m.*")


def route_traffic_lookup(sites: DataFrame, feed: DataFrame, minimum: int = MINIMUM_PAGEVIEWS) -> DataFrame:
    """Verified sites with what their traffic lookup gave: estimate, qualification_status, error_code.

    ``feed``: site, visits, per_visit, error_code. Missing factors count as 0; a failed lookup needs review.
    """
    d = sites.where(F.col("verification_status") == "verified").join(feed.withColumn("_fed", F.lit(True)), "site", "left")
    pv = estimated_pageviews(F.coalesce("visits", F.lit(0)), F.coalesce("per_visit", F.lit(0)))
    found = F.col("_fed").isNotNull() & F.col("error_code").isNull()
    status = F.when(F.col("error_code") == "exception", "needs_review").when(~found, "traffic_missing").otherwise(qualification_status(F.lit("verified"), pv, minimum))
    return d.select("site", F.when(found, pv).alias("estimated_pageviews"), status.alias("qualification_status"), "error_code")


def site_key(url: Column) -> Column:
    return F.rtrim(F.regexp_replace(clean_url(url), "/+$", ""))


def manual_traffic(rows: DataFrame) -> DataFrame:
    """Manual traffic as read: numbers cast with 0 on failure, growth ``nan`` as ``0%``, and the join key."""
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    growth = F.when(F.lower(F.coalesce("growth_rate", F.lit("nan"))) == "nan", "0%").otherwise(F.col("growth_rate"))
    return rows.select("seq", site_key(F.col("website_url")).alias("key"), number("monthly_visits").alias("monthly_visits"), number("pages_per_visit").alias("pages_per_visit"), growth.alias("growth_rate"))


def join_manual_traffic(seeds: DataFrame, traffic: DataFrame) -> DataFrame:
    """Seeds with the first traffic row of their cleaned URL."""
    first = manual_traffic(traffic).groupBy("key").agg(F.min_by(F.struct("monthly_visits", "pages_per_visit", "growth_rate"), "seq").alias("t"))
    d = seeds.withColumn("key", site_key(F.col("website_url"))).join(first, "key", "left")
    return d.select(*seeds.columns, "t.*")


def media_list(joined: DataFrame, minimum: float = 1e6) -> DataFrame:
    """Seeds with estimate, presentation text and status; strictly more than ``minimum`` qualifies. With a category there is a
    gaming_focus, with a target_market there are notes."""
    est = F.nullif(F.coalesce(F.col("monthly_visits") * F.col("pages_per_visit"), F.lit(0.0)), F.lit(0.0))
    status = F.when(F.coalesce(est, F.lit(0.0)) > minimum, "Qualified").otherwise("Upcoming")
    flags = []
    if "category" in joined.columns:
        flags.append(F.when(F.lower("category").rlike("game|esports"), "Yes").otherwise("Partial/Unverified").alias("gaming_focus"))
    if "target_market" in joined.columns:
        flags.append(F.when(F.col("target_market") == "Canada", "May include global audience. Traffic might not be solely Canadian.").otherwise("").alias("notes"))
    return joined.select("*", *flags, est.alias("estimated_pageviews"), F.coalesce(est.cast("bigint").cast("string"), F.lit("Needs Verification")).alias("pageviews_text"), status.alias("status"))


def rank_media(df: DataFrame, order: str = "seq") -> DataFrame:
    """Rank from 1 within each status by pageviews (missing as 0), and the direction of growth by its sign.

    Quantiles of the values, a constant number of them, cut each status into parts that are ranked by themselves; a
    part's ranks begin after the rows of the parts before it, so no task sorts a whole status.
    """
    value = F.coalesce(F.col("estimated_pageviews").try_cast("double"), F.lit(0.0))
    growth = F.when(F.col("growth_rate").startswith("-"), "down").when(F.col("growth_rate").rlike(r"^\+?0*(\.0*)?%?$"), "flat").otherwise("up")
    marks = [i / RANK_PARTS for i in range(1, RANK_PARTS)]
    numeric = not isinstance(df.schema[order].dataType, T.StringType)
    seen = df.agg(F.percentile_approx(value, marks, 10_000).alias("q"), F.percentile_approx(order if numeric else F.lit(0), marks, 10_000).alias("o")).first()
    cuts, turns = sorted(set(seen.q or []), reverse=True), sorted(set(seen.o or [])) if numeric else []
    # a value that is a cut has a part of its own, which quantiles of the order cut again, as any share of the rows may hold it
    part = sum((F.when(value <= x, 1).otherwise(0) + F.when(value < x, 1).otherwise(0) for x in cuts), F.lit(0)) * (RANK_PARTS + 1)
    tied = F.when(value.isin(*cuts), sum((F.when(F.col(order) > x, 1).otherwise(0) for x in turns), F.lit(0))).otherwise(0) if cuts else F.lit(0)
    part = part + tied
    d = df.withColumn("_value", value).withColumn("_part", part)
    counts = d.groupBy("status", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("status").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("status").alias("_s"), F.col("_part").alias("_p"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("status", "_part").orderBy(F.col("_value").desc(), F.col(order)))
    d = d.withColumn("_own", own).join(F.broadcast(starts), F.col("status").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    return d.withColumn("rank", (F.col("_own") + F.col("_before")).cast("int")).select(*[F.col(f"`{c}`") for c in df.columns], "rank", growth.alias("direction"))


def dashboard_kpis(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("pageviews", F.lit(0))).alias("pageviews"), F.count_distinct(F.coalesce("market", "country")).alias("markets"))
