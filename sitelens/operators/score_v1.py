"""Single-page scoring: whole-number components, status and confidence, one row a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import present

#: Word patterns of the rules.
WORDS = {
    "gaming": r"(?i)\b(gaming|video games|videogames|gamer|gamers|gameplay|esports|mmo|rpg)\b",
    "platform": r"(?i)\b(pc|playstation|xbox|nintendo|switch|ps4|ps5|mobile gaming|ios|android)\b",
    "editorial": r"(?i)\b(news|reviews|guides|features|interviews|editorials|articles|walkthroughs)\b",
    "store": r"(?i)\b(shopping cart|add to cart|buy now|checkout|pricing)\b",
    "developer": r"(?i)\b(developed by|our games|game developer|development studio|published by|game publisher)\b",
    "casino": r"(?i)\b(casino|betting|gambling|slots|poker|roulette|sportsbook|odds)\b",
    "hardware": r"(?i)\b(graphics card|gpu|cpu|motherboard|gaming chair|gaming mouse)\b",
    "about": r"(?i)\b(about us|team|contact us|editorial staff)\b",
    "publication": r"(?i)\b(publication|magazine|journalism|coverage|daily news)\b",
}
#: Category and the substrings that show it.
CATEGORIES = (
    ("gaming_news", ("news",)), ("reviews", ("review",)), ("guides", ("guide", "walkthrough")), ("features", ("feature",)),
    ("interviews", ("interview",)), ("esports", ("esport", "tournament")), ("pc_gaming", ("pc", "steam")),
    ("playstation", ("playstation", "ps4", "ps5")), ("xbox", ("xbox",)), ("nintendo", ("nintendo", "switch")),
    ("mobile_gaming", ("mobile", "ios", "android")), ("indie_games", ("indie",)), ("hardware", ("hardware", "gpu")),
)
EDITORIAL_TYPES = ("NewsArticle", "Article", "Review", "BlogPosting", "NewsMediaOrganization")
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy")


def count_text_hits(texts: Column, pattern: str) -> Column:
    """How many of ``texts`` match."""
    return F.size(F.filter(texts, lambda t: t.rlike(pattern)))


def _capped(n: Column, each: int, most: int) -> Column:
    return F.least(n * each, F.lit(most))


def v1_scores(signals: DataFrame, as_of: Column) -> DataFrame:
    """``signals`` (of page_signals) with gaming_score, editorial_score, activity_score, activity_status, identity_score,
    negative_penalty, n_reasons, detected (categories) and score. ``as_of`` is the time of judgement."""
    c = F.col
    meta = present(c("page_title"), c("meta_description"), c("og_title"), c("og_description"), c("og_site_name"))
    about = present(c("meta_description"), c("page_title"), c("og_description"))
    every = F.concat(present(c("page_title"), c("meta_description"), c("og_description")), c("headings"), c("navigation_labels"), c("footer_text"))
    n_meta, n_platform = count_text_hits(meta, WORDS["gaming"]), count_text_hits(F.concat("headings", "navigation_labels"), WORDS["platform"])
    context = F.array_contains("json_ld_types", "VideoGame") | F.lower(F.concat_ws(" ", meta)).contains("esports")
    n_nav, n_art = count_text_hits(c("navigation_labels"), WORDS["editorial"]), F.size("article_links")
    schema = F.arrays_overlap("json_ld_types", F.array(*[F.lit(t) for t in EDITORIAL_TYPES]))
    n_about, n_pub = count_text_hits(F.concat("navigation_labels", "footer_text"), WORDS["about"]), count_text_hits(about, WORDS["publication"])
    parsed = F.transform("detected_publication_dates", lambda d: F.coalesce(*[F.try_to_timestamp(d, F.lit(f)) for f in DATE_FORMATS]))
    newest = F.array_max(F.filter(parsed, lambda d: F.unix_timestamp(d) - F.unix_timestamp(as_of) < 86400))
    age = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(newest)) / 86400)
    activity = F.when(newest.isNull(), "unknown").when(age <= 90, "active_recently").when(age <= 365, "possibly_active").otherwise("stale")
    hits = {k: count_text_hits(every, WORDS[k]) for k in ("store", "developer", "casino", "hardware")}
    penalty = _capped(hits["store"], 10, 40) + _capped(hits["developer"], 15, 40) + F.when(hits["casino"] > 0, 80).otherwise(0) + _capped(hits["hardware"], 10, 30)
    yes = lambda x: x.cast("int")
    text = F.lower(F.concat_ws(" ", present(c("page_title"), c("meta_description")), "navigation_labels", "headings"))

    def shown(keys):
        found = text.contains(keys[0])
        for k in keys[1:]:
            found = found | text.contains(k)
        return found

    d = signals.withColumns(
        {
            "gaming_score": F.least(_capped(n_meta, 5, 15) + _capped(n_platform, 5, 15) + yes(context) * 5, F.lit(35)),
            "editorial_score": F.least(_capped(n_nav, 10, 20) + F.when(n_art > 2, _capped(n_art, 2, 10)).otherwise(0) + yes(schema) * 10, F.lit(35)),
            "activity_status": activity,
            "newest_date": newest,
            "identity_score": F.least(yes(c("og_site_name").isNotNull()) * 2 + _capped(F.size("author_links"), 2, 4) + yes(n_about > 0) * 3 + yes(n_pub > 0) * 6, F.lit(15)),
            "negative_penalty": F.least(penalty, F.lit(80)),
            "detected": F.sort_array(F.array_compact(F.array(*[F.when(shown(keys), name) for name, keys in CATEGORIES]))),
            "n_reasons": yes(n_meta > 0) + yes(n_platform > 0) + yes(context) + yes(n_nav > 0) + yes(n_art > 2) + yes(schema) + yes(newest.isNotNull())
            + yes(c("og_site_name").isNotNull()) + yes(F.size("author_links") > 0) + yes(n_about > 0) + yes(n_pub > 0),
        }
    )
    d = d.withColumn("activity_score", F.when(c("activity_status") == "active_recently", 15).when(c("activity_status") == "possibly_active", 7).otherwise(0))
    total = c("gaming_score") + c("editorial_score") + c("activity_score") + c("identity_score") - c("negative_penalty")
    return d.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), total)))


def v1_decision(scored: DataFrame, verified: int = 70, uncertain: int = 40) -> DataFrame:
    """``scored`` with verification_status and confidence; challenge and parked pages get score 0."""
    c = F.col
    challenged, parked = F.size("challenge_indicators") > 0, F.size("parking_indicators") > 0
    forced = (c("negative_penalty") >= 40) & (c("editorial_score") < 18)
    by_score = F.when(c("score") >= verified, F.when((c("gaming_score") >= 18) & (c("editorial_score") >= 18), "verified").otherwise("uncertain")).when(c("score") >= uncertain, "uncertain").otherwise("rejected")
    raw = (
        F.least(F.lit(0.40), c("n_reasons") * 0.05)
        + F.when((c("gaming_score") >= 15) & (c("editorial_score") >= 15), 0.20).otherwise(0.0)
        + F.when(F.size("json_ld_types") > 0, 0.15).otherwise(0.0)
        + F.when(c("activity_status").isin("active_recently", "possibly_active"), 0.15).otherwise(0.0)
        + F.when(c("page_title").isNotNull() & (F.size("headings") > 0), 0.10).otherwise(0.0)
        - F.when((c("negative_penalty") > 20) & (c("score") > 40), 0.30).otherwise(0.0)
    )
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    conf = F.when(forced, F.greatest(conf, F.lit(0.8))).otherwise(conf)
    return scored.withColumns(
        {
            "verification_status": F.when(challenged, "uncertain").when(parked, "rejected").when(forced, "rejected").otherwise(by_score),
            "confidence": F.round(F.when(challenged, 0.1).when(parked, 0.9).otherwise(conf), 2),
            "score": F.when(challenged | parked, 0).otherwise(c("score")),
        }
    )


def best_page_per_site(decided: DataFrame, sites: DataFrame) -> DataFrame:
    """Per site of ``sites`` its best page: verified before uncertain before rejected, higher score, first page. Sites without pages are rejected with 0."""
    rank = F.when(F.col("verification_status") == "verified", 0).when(F.col("verification_status") == "uncertain", 1).otherwise(2)
    best = decided.groupBy("site").agg(F.min_by(F.struct("page_id", "verification_status", "score"), F.struct(rank.alias("r"), (-F.col("score")).alias("s"), F.col("page_id"))).alias("b"))
    d = sites.select("site").distinct().join(best, "site", "left")
    return d.select("site", F.col("b.page_id").alias("page_id"), F.coalesce("b.verification_status", F.lit("rejected")).alias("verification_status"), F.coalesce("b.score", F.lit(0)).alias("score"))


def with_failed_fetches(decided: DataFrame, pages: DataFrame, key: str = "page_id", success: str = "success", error: str = "error_code") -> DataFrame:
    """One row a page of ``pages``: its decision, or, where the fetch failed, status fetch_failed, scores and confidence 0,
    n_reasons 1 and the error as ``reason``. Pages that were fetched but have no decision get null columns."""
    zeros = ("score", "gaming_score", "editorial_score", "activity_score", "identity_score", "negative_penalty")
    d = pages.select(key, F.coalesce(success, F.lit(False)).alias("_ok"), F.col(error).alias("_error")).join(decided, key, "left")
    ok = F.col("_ok")
    made = {c: F.when(ok, F.col(c)).otherwise(0) for c in zeros if c in d.columns}
    made |= {c: F.when(ok, F.col(c)).otherwise(v) for c, v in (("verification_status", "fetch_failed"), ("confidence", 0.0), ("n_reasons", 1), ("activity_status", "unknown")) if c in d.columns}
    return d.withColumns(made).withColumn("reason", F.when(~ok, F.coalesce("_error", F.lit("unknown")))).drop("_ok", "_error")


def status_counts(decided: DataFrame) -> DataFrame:
    s = F.col("verification_status")
    return decided.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(s == x).alias(x) for x in ("verified", "uncertain", "rejected", "fetch_failed")])
