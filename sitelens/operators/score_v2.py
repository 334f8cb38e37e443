"""Multilingual multi-page scoring: evidence as a long table (site, kind, source, term, page_type), scored per site."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lists import let, present

#: Vocabulary by kind and language.
VOCABULARY = {
    "identity": {
        "en": ("game", "games", "gaming", "video game", "pc gaming", "console", "steam", "indie game", "esports"),
        "ja": ("ゲーム", "ビデオゲーム", "pcゲーム", "インディーゲーム", "eスポーツ", "新作ゲーム", "ゲームニュース", "ゲーム情報"),
        "fr": ("jeu vidéo", "jeux vidéo", "gaming", "esport", "actualité jeu vidéo"),
    },
    "article": {
        "en": ("review", "walkthrough", "gameplay", "guide", "preview"),
        "ja": ("レビュー", "攻略", "実況", "発売", "アップデート"),
        "fr": ("test de jeu", "critique de jeu"),
    },
    "editorial": {
        "en": ("news", "reviews", "features", "articles", "guides", "interviews", "editorial"),
        "ja": ("ニュース", "レビュー", "特集", "記事", "攻略", "インタビュー"),
        "fr": ("actualités", "tests", "critiques", "articles", "dossiers", "guides", "entrevues"),
    },
    "author": {
        "en": ("author", "by", "published", "updated", "written by", "editorial staff", "journalism"),
        "ja": ("編集部", "ライター", "著者", "公開", "更新"),
        "fr": ("auteur", "publié", "mis à jour"),
    },
    "store": {"en": ("product catalogue", "cart", "checkout", "prices", "purchase", "add to cart", "buy now", "merchandise")},
    "developer": {
        "en": ("our games", "game portfolio", "investor relations", "careers in game development", "corporate company description", "support/download", "official product marketing")
    },
    "hardware": {"en": ("manufacturer", "retail", "hardware store")},
    "casino": {"en": ("casino", "betting", "gambling", "slots", "poker", "sportsbook", "online casino")},
}


def vocab_table(spark: SparkSession) -> DataFrame:
    """(kind, lang, term)."""
    rows = [(kind, lang, t) for kind, by in VOCABULARY.items() for lang, terms in by.items() for t in terms]
    return spark.createDataFrame(rows, "kind string, lang string, term string")


def vocab_fingerprint() -> str:
    """Eight hex digits of the sorted terms, repeats included, written as a list."""
    terms = sorted(t for by in VOCABULARY.values() for terms in by.values() for t in terms)
    return hashlib.sha256(str(terms).encode()).hexdigest()[:8]


def normalize_text(c: Column) -> Column:
    """NFKC (only where there are non-ASCII characters), lower case, other than letters, numbers and underscores as one space."""
    nfkc = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.trim(F.regexp_replace(F.lower(F.when(c.rlike(r"[^\x00-\x7F]"), nfkc).otherwise(c)), r"[^\p{L}\p{N}_]+", " "))


def normalize_term(term: str) -> str:
    """``normalize_text`` of a term of the vocabulary."""
    folded = unicodedata.normalize("NFKC", term).lower()
    return " ".join("".join(x if x == "_" or x.isalnum() else " " for x in folded).split())


def terms_of(*kinds: str) -> list[str]:
    return sorted({t for k in kinds for terms in VOCABULARY[k].values() for t in terms})


def match_terms(texts: Column, terms: list[str]) -> Column:
    """Those of ``terms`` that, normalised, some text (already normalised) holds as a substring; the terms are literals of the plan, the texts stay in their row."""
    held = lambda t: F.array_compact(F.array(*[F.when(t.contains(normalize_term(x)), F.lit(x)) for x in terms]))
    return let(F.array_join(texts, "\n"), held)


def match_kinds(fields: dict[str, Column], uses: dict[str, tuple[Sequence[str], Sequence[str]]], vocabulary: dict[str, dict[str, Sequence[str]]] | None = None) -> Column:
    """Array of (kind, term): for each kind of ``uses`` (names of fields, kinds of the vocabulary) the terms that a text of one of its fields holds.

    ``fields`` are arrays of normalised texts. One automaton over all terms runs once over each text, whatever the number
    of terms and kinds, and the plan has no literal of a term. Terms come sorted and once a kind; null arrays and texts
    hold nothing. The vocabulary travels with the function, so it should fit a task's memory (a million terms do).
    """
    vocabulary = VOCABULARY if vocabulary is None else vocabulary
    names, wanted = list(fields), {kind: (list(f), set(v)) for kind, (f, v) in uses.items()}
    terms: dict[str, list[tuple[str, str]]] = {}
    for kind in sorted({k for _, own in wanted.values() for k in own}):
        for term in sorted({t for by in vocabulary[kind].values() for t in by}):
            terms.setdefault(normalize_term(term), []).append((kind, term))
    terms.pop("", None)

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("term", T.StringType())])))
    def match(texts: pd.DataFrame) -> pd.Series:
        automaton = _automaton(terms)

        def of(row) -> list[dict]:
            held: dict[str, set[tuple[str, str]]] = {}
            for name, own in zip(names, row, strict=True):
                found = held.setdefault(name, set())
                for text in own if own is not None and automaton is not None else ():
                    for _, entries in automaton.iter(text or ""):
                        found.update(entries)
            out = []
            for kind, (where, kinds) in wanted.items():
                hits = {term for name in where for k, term in held[name] if k in kinds}
                out += [{"kind": kind, "term": t} for t in sorted(hits)]
            return out

        return pd.Series([of(row) for row in zip(*(texts[n] for n in names), strict=True)])

    return match(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _automaton(terms: dict[str, list[tuple[str, str]]]):
    """Automaton of normalised terms; kept by a worker for the batches of the same vocabulary."""
    import ahocorasick

    key = hash(frozenset((t, tuple(own)) for t, own in terms.items()))
    if _HELD.get("key") != key:
        made = ahocorasick.Automaton()
        for text, own in terms.items():
            made.add_word(text, own)
        if terms:
            made.make_automaton()
        _HELD.update(key=key, automaton=made if terms else None)
    return _HELD["automaton"]


_HELD: dict = {}


def site_evidence(signals: DataFrame, language: str | None = None, market: str | None = None) -> DataFrame:
    """Long evidence table of ``signals`` (page_signals with site, page_seq, page_type): one row per finding and page.

    Repeats over a site's pages are left to the scores, which take a term's first page by page_seq.
    """
    norm = lambda a: F.transform(a, normalize_text)
    c = F.col
    title = present(c("page_title"), c("og_site_name"), c("og_title"), c("meta_description"), c("og_description"))
    nav, foot = F.concat("headings", "navigation_labels"), c("footer_text")
    fields = {"title": norm(title), "nav": norm(nav), "foot": norm(foot), "links": norm(c("article_links")), "authors": norm(c("author_links"))}
    every = ("title", "nav", "foot")
    uses = {
        "gaming_identity": (("title",), ("identity",)),
        "gaming_navigation": (("nav",), ("identity", "article")),
        "gaming_article": (("links",), ("identity", "article")),
        "editorial_navigation": (("nav",), ("editorial",)),
        "author": (("authors", "foot", "title"), ("author",)),
        **{k: (every, (k,)) for k in ("store", "developer", "hardware", "casino")},
    }
    one = lambda cond, term: F.when(cond, F.array(F.lit(term))).otherwise(F.array().cast("array<string>"))
    found = {
        "article_link": F.array_distinct("article_links"),
        "category": c("detected_categories"),
        "technical": F.concat(one(c("canonical_url").isNotNull() | c("page_title").isNotNull(), "parsed_html"), one(F.size("json_ld_types") > 0, "structured_data")),
        "date": c("detected_publication_dates"),
        "market_language": one(F.lower("html_language").contains(language.lower()), "language") if language else F.array().cast("array<string>"),
        "market_location": one(F.exists(foot, lambda t: F.lower(t).contains(market.lower())), "location") if market else F.array().cast("array<string>"),
    }

    def named(kind: str, terms: Column) -> Column:
        return F.transform(terms, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))

    pairs = F.flatten(F.array(match_kinds(fields, uses), *[named(kind, terms) for kind, terms in found.items()]))
    return signals.select("site", "page_seq", "page_type", F.explode(pairs).alias("e")).select("site", "page_seq", "page_type", "e.kind", "e.term")


def v2_scores(evidence: DataFrame, sites: DataFrame, market: str | None = None) -> DataFrame:
    """Component scores, deductions, hard rule and total of every site in ``sites`` (site), by one conditional aggregation.

    Terms are reduced to (site, kind, term) first, so a site with very many pages is summed before it is gathered; what is
    gathered per site is bounded by the vocabulary.
    """
    first = evidence.groupBy("site", "kind", "term").agg(F.min_by("page_type", "page_seq").alias("page_type"), F.count(F.lit(1)).cast("int").alias("n"), F.max(F.col("page_type") != "primary").alias("elsewhere"))
    k = lambda name: F.col("kind") == name
    gaming = F.col("kind").isin("gaming_identity", "gaming_navigation", "gaming_article")
    terms = lambda name: F.collect_set(F.when(k(name), F.col("term"))).alias(name)
    names = ("gaming_identity", "gaming_navigation", "gaming_article", "editorial_navigation", "author", "article_link", "category", "date")
    d = first.groupBy("site").agg(
        *[F.count_if(k(n)).alias(f"n_{n}") for n in names],
        F.coalesce(F.sum(F.when(k("date"), F.col("n"))), F.lit(0)).alias("all_dates"),
        F.coalesce(F.max(gaming & (F.col("page_type") != "primary")), F.lit(False)).alias("spread"),
        F.count_if(k("technical")).alias("n_technical"),
        F.coalesce(F.max(k("technical") & F.col("elsewhere")), F.lit(False)).alias("technical_spread"),
        F.count_if(k("market_language")).alias("n_language"),
        F.count_if(k("market_location")).alias("n_location"),
        *[terms(n) for n in ("store", "developer", "casino", "hardware")],
    )
    d = sites.select("site").distinct().join(d, "site", "left")
    d = d.fillna(0, [c for c in d.columns if c.startswith("n_") or c == "all_dates"]).fillna(False, ["spread", "technical_spread"])
    d = d.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("store", "developer", "casino", "hardware")})
    c, cap = F.col, lambda n, each, most: F.least(F.col(n) * each, F.lit(most))
    has = lambda col, *t: F.arrays_overlap(col, F.array(*[F.lit(x) for x in t]))
    rule = (
        F.when(has("store", "cart", "checkout") & has("store", "purchase", "buy now"), "dominant_ecommerce_store")
        .when(has("developer", "game portfolio", "our games") & has("developer", "investor relations", "corporate company description"), "game_developer_corporate_site")
        .when(has("casino", "casino", "online casino") & has("casino", "betting", "sportsbook", "gambling"), "casino_or_betting_site")
        .when(has("hardware", "manufacturer") & has("hardware", "retail", "hardware store"), "hardware_manufacturer")
    )
    ruled = {"store": ("dominant_ecommerce_store", 10, 20), "developer": ("game_developer_corporate_site", 10, 20), "casino": ("casino_or_betting_site", 15, 30), "hardware": ("hardware_manufacturer", 5, 15)}
    d = d.withColumn("hard_rule", rule)
    deduct = sum((F.when(c("hard_rule") == r, most).otherwise(F.least(F.size(kind) * each, F.lit(most))) for kind, (r, each, most) in ruled.items()), F.lit(0))
    market_score = F.lit(20) if (market or "").upper() == "GLOBAL" else F.least(F.lit(20), F.when(c("n_language") > 0, 15).otherwise(0) + F.when(c("n_location") > 0, 10).otherwise(0)) if market else F.lit(0)
    d = d.withColumns(
        {
            "gaming_score": F.least(F.lit(30), cap("n_gaming_identity", 5, 15) + cap("n_gaming_navigation", 4, 10) + cap("n_gaming_article", 4, 10) + c("spread").cast("int") * 5 + cap("n_category", 3, 5)),
            "media_score": F.least(F.lit(25), cap("n_editorial_navigation", 3, 10) + cap("n_article_link", 2, 8) + cap("n_date", 2, 6) + cap("n_author", 3, 6) + cap("n_category", 3, 5)),
            "market_score": market_score,
            "activity_score": F.when(c("all_dates") > 3, 11).when(c("all_dates") > 0, 7).otherwise(0),
            "technical_score": (c("n_technical") > 0).cast("int") * 3 + c("technical_spread").cast("int") * 2,
            "deductions": F.when(c("hard_rule").isNull(), F.least(deduct, F.lit(35))).otherwise(F.least(deduct, F.lit(100))),
            "negative_confidence": F.when(c("hard_rule").isNotNull() | F.greatest(*[F.size(x) for x in ruled]).__ge__(2), "high").when(sum((F.size(x) for x in ruled), F.lit(0)) > 0, "medium").otherwise("low"),
        }
    )
    d = d.withColumn("market_status", F.when(c("market_score") >= 15, "confirmed").when(c("market_score") > 0, "probable").otherwise("unconfirmed"))
    total = c("gaming_score") + c("media_score") + c("market_score") + c("activity_score") + c("technical_score")
    return d.withColumn("total_score", F.greatest(F.lit(0), F.least(F.lit(100), total - c("deductions"))))


def v2_decision(scored: DataFrame, verified: int = 70, uncertain: int = 40, technical_minimum: int = 4, usable: Column | None = None) -> DataFrame:
    """``scored`` with predicted_status, relevance_label and decision_override (the evidence gate).

    ``usable``: there was usable evidence. A site without it is uncertain, all its scores are 0 and its market is
    unconfirmed, for nothing was acquired to judge.
    """
    c = F.col
    scored = scored.withColumn("_usable", F.lit(True) if usable is None else F.coalesce(usable, F.lit(False)))
    usable = c("_usable")
    strong = c("hard_rule").isNotNull() | (c("negative_confidence") == "high")
    first = F.when(strong, "rejected").when(c("total_score") >= verified, "verified").when((c("total_score") < uncertain) & (c("technical_score") >= technical_minimum), "rejected").otherwise("uncertain")
    telling = (c("n_gaming_navigation") > 0) | (c("n_gaming_article") > 1) | (c("n_editorial_navigation") > 0) | (c("n_gaming_identity") > 0) | strong
    gated = F.when(c("_s") == "verified", ~(usable & telling)).when(c("_s") == "rejected", ~(usable & strong)).otherwise(False)
    d = scored.withColumn("_s", first).withColumn("_g", gated)
    d = d.withColumn("predicted_status", F.when(c("_g") | ~usable, "uncertain").otherwise(c("_s"))).withColumn("decision_override", F.when(c("_g"), "insufficient_evidence"))
    label = F.when(c("predicted_status") == "verified", "gaming_media").when(c("predicted_status") == "rejected", "not_gaming_media").otherwise("uncertain")
    d = d.withColumn("relevance_label", label).drop("_s", "_g")
    zeros = ("gaming_score", "media_score", "market_score", "activity_score", "technical_score", "deductions", "total_score")
    d = d.withColumns({x: F.when(usable, c(x)).otherwise(0) for x in zeros if x in d.columns})
    bare = {"market_status": "unconfirmed", "negative_confidence": "low", "hard_rule": None, "decision_override": None}
    return d.withColumns({x: F.when(usable, c(x)).otherwise(F.lit(v)) for x, v in bare.items() if x in d.columns}).drop("_usable")


def shadow_compare(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Both decisions of each site and what to do about a difference; V1's stays in force."""
    c = F.col
    d = v1.select("site", c("verification_status").alias("v1")).join(v2.select("site", c("predicted_status").alias("v2")), "site", "left")
    advice = (
        F.when(c("v2").isNull(), "v2_error").when(c("v1") == c("v2"), "agree").when(c("v2") == "uncertain", "v2_abstained")
        .when(c("v2") == "verified", "review_v2_positive").when(c("v2") == "rejected", "review_v2_negative").otherwise("review")
    )
    return d.select("site", "v1", "v2", advice.alias("recommendation"))
