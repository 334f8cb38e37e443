"""Queries over both scores: conversations are sites, their turns pages, and phrases stand in the place of markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import score_v1 as V1
from ..operators import score_v2 as V2
from .inputs import table
from .registry import query

#: Phrases of headings, labels and footers that reach every rule, and the same in compatibility form.
PHRASES = (
    "Game Reviews", "ｅスポーツ News", "Our Games", "Investor Relations", "Shopping Cart", "Buy now!", "Online-Casino", "Betting & Odds", "Support/Download",
    "ＰＣゲーム", "Manufacturer", "Retail", "Jeux Vidéo", "Dossiers et guides", "Weather", "ｹﾞｰﾑ攻略", "Interviews",
)
COMPOSED = tuple({"ｅスポーツ News": "eスポーツ News", "ＰＣゲーム": "PCゲーム", "ｹﾞｰﾑ攻略": "ゲーム攻略"}.get(p, p) for p in PHRASES)
STRINGS = "array<string>"


def site_pages(spark, d):
    """Signals of pages as ``page_signals`` gives them, with site, page_seq and page_type."""
    k, t = F.col("conv_id"), F.col("turn")
    none = F.array().cast(STRINGS)
    phrase = lambda i: F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.when(k % 5 == 0, 0).otherwise(i % len(PHRASES)) + 1).cast("int"))
    some = lambda cond, *values: F.when(cond, F.array(*[F.lit(v) if isinstance(v, str) else v for v in values])).otherwise(none)
    third = k % 3 == 0
    dates = F.when(k % 6 == 1, F.array(F.lit("2023-05-01"))).when(k % 6 == 3, F.array(F.lit("2020-01-01"), F.lit("soon"))).when(k % 2 == 0, F.array(F.concat(F.lit("2024-01-0"), (t % 3 + 1).cast("string")))).otherwise(none)
    return table(spark, d, "conversations").select(
        k.alias("site"), t.alias("page_seq"), (k * 100 + t).alias("page_id"), F.when(t == 0, "primary").otherwise("supporting").alias("page_type"),
        F.col("text").alias("page_title"), F.when(third, "Daily news and coverage of video games").alias("meta_description"), F.when(third, "Esports and gaming news").alias("og_title"),
        F.lit(None).cast("string").alias("og_description"), F.when(k % 2 == 0, "Gamer Magazine").alias("og_site_name"), F.when(k % 3 == 1, "fr-FR").otherwise("en").alias("html_language"),
        F.lit(None).cast("string").alias("canonical_url"),
        F.concat(F.array(phrase(k * 7 + t * 3)), some(third, "PlayStation and Xbox", "PC")).alias("headings"),
        F.concat(F.array(phrase(k + t * 5)), some(third, "News", "Reviews", "About us")).alias("navigation_labels"),
        F.concat(some(k % 5 != 1, phrase(k * 2 + t)), some(k % 2 == 1, "Site in Paris")).alias("footer_text"),
        F.concat(some(third, F.concat(F.lit("/news/"), t.cast("string"), F.lit("-game-preview")), "/news/all", "/reviews/x"), some(k % 7 == 2, "/post/1")).alias("article_links"),
        some((k + t) % 4 == 0, "By Ann", "/author/b").alias("author_links"), some(k % 5 == 0, "NewsArticle").alias("json_ld_types"), dates.alias("detected_publication_dates"),
        some(k % 4 == 1, "news", "reviews").alias("detected_categories"), some((k % 11 == 3) & (t == 0), "cloudflare_challenge").alias("challenge_indicators"),
        some(k % 13 == 4, "domain_parked_or_for_sale").alias("parking_indicators"),
    )


def _strings(items) -> str:
    return "[" + ", ".join(f"'{p}'" for p in items) + "]"


def _pick(items, i: str) -> str:
    return f"({_strings(items)})[CASE WHEN conv_id % 5 = 0 THEN 0 ELSE ({i}) % {len(PHRASES)} END + 1]"


PAGES = f"""pg AS (SELECT k AS site, t AS page_seq, k * 100 + t AS page_id, CASE WHEN t = 0 THEN 'primary' ELSE 'supporting' END AS page_type, text AS title,
  CASE WHEN k % 3 = 0 THEN 'Daily news and coverage of video games' END AS meta, CASE WHEN k % 3 = 0 THEN 'Esports and gaming news' END AS og_title, CASE WHEN k % 2 = 0 THEN 'Gamer Magazine' END AS og_site,
  CASE WHEN k % 3 = 1 THEN 'fr-FR' ELSE 'en' END AS lang, h || CASE WHEN k % 3 = 0 THEN ['PlayStation and Xbox', 'PC'] ELSE [] END AS heads, n || CASE WHEN k % 3 = 0 THEN ['News', 'Reviews', 'About us'] ELSE [] END AS nav,
  CASE WHEN k % 5 <> 1 THEN f ELSE [] END || CASE WHEN k % 2 = 1 THEN ['Site in Paris'] ELSE [] END AS foot,
  hc || CASE WHEN k % 3 = 0 THEN ['PlayStation and Xbox', 'PC'] ELSE [] END AS heads_c, nc || CASE WHEN k % 3 = 0 THEN ['News', 'Reviews', 'About us'] ELSE [] END AS nav_c,
  CASE WHEN k % 5 <> 1 THEN fc ELSE [] END || CASE WHEN k % 2 = 1 THEN ['Site in Paris'] ELSE [] END AS foot_c,
  CASE WHEN k % 3 = 0 THEN ['/news/' || t || '-game-preview', '/news/all', '/reviews/x'] ELSE [] END || CASE WHEN k % 7 = 2 THEN ['/post/1'] ELSE [] END AS links,
  CASE WHEN (k + t) % 4 = 0 THEN ['By Ann', '/author/b'] ELSE [] END AS authors, CASE WHEN k % 5 = 0 THEN ['NewsArticle'] ELSE [] END AS ld,
  CASE WHEN k % 6 = 1 THEN ['2023-05-01'] WHEN k % 6 = 3 THEN ['2020-01-01', 'soon'] WHEN k % 2 = 0 THEN ['2024-01-0' || (t % 3 + 1)] ELSE [] END AS dates,
  CASE WHEN k % 4 = 1 THEN ['news', 'reviews'] ELSE [] END AS cats, k % 11 = 3 AND t = 0 AS challenged, k % 13 = 4 AS parked
  FROM (SELECT conv_id AS k, turn AS t, text, [{_pick(PHRASES, 'conv_id * 7 + turn * 3')}] AS h, [{_pick(PHRASES, 'conv_id + turn * 5')}] AS n, [{_pick(PHRASES, 'conv_id * 2 + turn')}] AS f,
    [{_pick(COMPOSED, 'conv_id * 7 + turn * 3')}] AS hc, [{_pick(COMPOSED, 'conv_id + turn * 5')}] AS nc, [{_pick(COMPOSED, 'conv_id * 2 + turn')}] AS fc FROM conversations))"""


def _hits(items: str, kind: str) -> str:
    return f"len(list_filter({items}, lambda x: regexp_matches(x, '{V1.WORDS[kind]}')))"


CATEGORIES = ", ".join(f"CASE WHEN {' OR '.join(f'contains(words, {chr(39)}{k}{chr(39)})' for k in keys)} THEN '{name}' END" for name, keys in V1.CATEGORIES)
V1_SQL = f"""WITH {PAGES},
l AS (SELECT *, list_filter([title, meta, og_title, og_site], lambda x: x IS NOT NULL) AS texts, list_filter([title, meta], lambda x: x IS NOT NULL) || heads || nav || foot AS every,
  lower(concat_ws(' ', title, meta, array_to_string(nav, ' '), array_to_string(heads, ' '))) AS words,
  list_max(list_filter(list_transform(dates, lambda x: try_cast(x AS TIMESTAMP)), lambda x: x < TIMESTAMP '2024-02-02')) AS newest FROM pg),
n AS (SELECT *, {_hits('texts', 'gaming')} AS n_meta, {_hits('heads || nav', 'platform')} AS n_platform, contains(lower(array_to_string(texts, ' ')), 'esports') AS context, {_hits('nav', 'editorial')} AS n_nav,
  len(links) AS n_art, len(ld) > 0 AS schema_, {_hits('nav || foot', 'about')} AS n_about, {_hits('list_filter([title, meta], lambda x: x IS NOT NULL)', 'publication')} AS n_pub,
  {_hits('every', 'store')} AS n_store, {_hits('every', 'developer')} AS n_dev, {_hits('every', 'casino')} AS n_casino, {_hits('every', 'hardware')} AS n_hw,
  date_diff('day', newest, TIMESTAMP '2024-02-01') AS age FROM l),
c AS (SELECT *, least(35, least(15, n_meta * 5) + least(15, n_platform * 5) + context::INT * 5) AS gaming_score,
  least(35, least(20, n_nav * 10) + CASE WHEN n_art > 2 THEN least(10, n_art * 2) ELSE 0 END + schema_::INT * 10) AS editorial_score,
  CASE WHEN age <= 90 THEN 15 WHEN age <= 365 THEN 7 ELSE 0 END AS activity_score,
  least(15, (og_site IS NOT NULL)::INT * 2 + least(4, len(authors) * 2) + (n_about > 0)::INT * 3 + (n_pub > 0)::INT * 6) AS identity_score,
  least(80, least(40, n_store * 10) + least(40, n_dev * 15) + CASE WHEN n_casino > 0 THEN 80 ELSE 0 END + least(30, n_hw * 10)) AS negative_penalty,
  (n_meta > 0)::INT + (n_platform > 0)::INT + context::INT + (n_nav > 0)::INT + (n_art > 2)::INT + schema_::INT + (newest IS NOT NULL)::INT + (og_site IS NOT NULL)::INT + (len(authors) > 0)::INT
    + (n_about > 0)::INT + (n_pub > 0)::INT AS n_reasons,
  array_to_string(list_sort(list_filter([{CATEGORIES}], lambda x: x IS NOT NULL)), ',') AS detected FROM n),
s AS (SELECT *, greatest(0, least(100, gaming_score + editorial_score + activity_score + identity_score - negative_penalty)) AS total, negative_penalty >= 40 AND editorial_score < 18 AS forced FROM c),
v AS (SELECT *, CASE WHEN challenged OR parked THEN 0 ELSE total END AS score,
  CASE WHEN challenged THEN 'uncertain' WHEN parked OR forced THEN 'rejected' WHEN total >= 70 AND gaming_score >= 18 AND editorial_score >= 18 THEN 'verified' WHEN total >= 20 THEN 'uncertain' ELSE 'rejected' END AS verification_status,
  greatest(0, least(1, least(0.4, n_reasons * 0.05) + CASE WHEN gaming_score >= 15 AND editorial_score >= 15 THEN 0.2 ELSE 0 END + CASE WHEN len(ld) > 0 THEN 0.15 ELSE 0 END + CASE WHEN age <= 365 THEN 0.15 ELSE 0 END + 0.1
    - CASE WHEN negative_penalty > 20 AND total > 40 THEN 0.3 ELSE 0 END)) AS raw FROM s),
d AS (SELECT *, round(CASE WHEN challenged THEN 0.1 WHEN parked THEN 0.9 WHEN forced THEN greatest(raw, 0.8) ELSE raw END, 2)::DOUBLE AS confidence FROM v)
"""
AS_OF = "2024-02-01"


def v1_scored(spark, d):
    return V1.v1_scores(site_pages(spark, d), F.lit(AS_OF).cast("timestamp"))


def v1_decided(spark, d):
    return V1.v1_decision(v1_scored(spark, d), 70, 20)


@query(V1_SQL + "SELECT page_id, gaming_score, editorial_score, activity_score, identity_score, negative_penalty, total AS score, detected FROM d")
def e1_v1_scores(spark, d):
    s = v1_scored(spark, d)
    return s.select("page_id", "gaming_score", "editorial_score", "activity_score", "identity_score", "negative_penalty", "score", F.array_join("detected", ",").alias("detected"))


@query(V1_SQL + "SELECT page_id, verification_status, score, confidence, n_reasons FROM d")
def e8_v1_decision(spark, d):
    return v1_decided(spark, d).select("page_id", "verification_status", "score", "confidence", "n_reasons")


@query(V1_SQL + """SELECT page_id, CASE WHEN page_seq % 3 = 2 THEN 'fetch_failed' ELSE verification_status END AS verification_status, CASE WHEN page_seq % 3 = 2 THEN 0 ELSE score END AS score, CASE WHEN page_seq % 3 = 2 THEN 0 ELSE confidence END AS confidence,
  CASE WHEN page_seq % 3 = 2 THEN 'timeout' END AS reason FROM d""")
def e10_fetch_failed_result(spark, d):
    fetched = F.col("page_seq") % 3 != 2
    pages = site_pages(spark, d).select("page_id", fetched.alias("success"), F.when(~fetched, "timeout").alias("error_code"))
    return V1.with_failed_fetches(v1_decided(spark, d), pages).select("page_id", "verification_status", "score", "confidence", "reason")


@query(V1_SQL + """, x AS (SELECT site, page_id, verification_status, score, CASE verification_status WHEN 'verified' THEN 0 WHEN 'uncertain' THEN 1 ELSE 2 END AS r FROM d),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY r, score DESC, page_id) AS n FROM x) WHERE n = 1), i AS (SELECT DISTINCT conv_id + j AS site FROM conversations, (VALUES (0), (3)) v(j))
SELECT site, page_id, coalesce(verification_status, 'rejected') AS verification_status, coalesce(score, 0) AS score FROM i LEFT JOIN b USING (site)""")
def e11_best_page_per_site(spark, d):
    sites = table(spark, d, "conversations").select(F.explode(F.array(F.col("conv_id"), F.col("conv_id") + 3)).alias("site"))
    return V1.best_page_per_site(v1_decided(spark, d), sites)


@query(V1_SQL + "SELECT count(*) AS total, count(*) FILTER (verification_status = 'verified') AS verified, count(*) FILTER (verification_status = 'uncertain') AS uncertain, count(*) FILTER (verification_status = 'rejected') AS rejected, 0 AS fetch_failed FROM d")
def e12_status_counts(spark, d):
    return V1.status_counts(v1_decided(spark, d))


def _terms() -> str:
    rows = [(kind, lang, t, V2.normalize_term(t)) for kind, by in V2.VOCABULARY.items() for lang, terms in by.items() for t in terms]
    return ", ".join("('" + "', '".join(r) + "')" for r in rows)


NORM = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
_EVIDENCE = f""", voc(kind, lang, term, n) AS (VALUES {_terms()}),
txt AS (SELECT site, page_seq, page_type, g, {NORM.format('x')} AS n FROM (
  SELECT site, page_seq, page_type, 'title' AS g, unnest(list_filter([title, og_site, og_title, meta], lambda x: x IS NOT NULL)) AS x FROM pg UNION ALL SELECT site, page_seq, page_type, 'nav', unnest(heads_c || nav_c) FROM pg
  UNION ALL SELECT site, page_seq, page_type, 'foot', unnest(foot_c) FROM pg UNION ALL SELECT site, page_seq, page_type, 'links', unnest(links) FROM pg UNION ALL SELECT site, page_seq, page_type, 'authors', unnest(authors) FROM pg)),
use(g, vkind, kind) AS (VALUES ('title', 'identity', 'gaming_identity'), ('nav', 'identity', 'gaming_navigation'), ('nav', 'article', 'gaming_navigation'), ('links', 'identity', 'gaming_article'), ('links', 'article', 'gaming_article'),
  ('nav', 'editorial', 'editorial_navigation'), ('authors', 'author', 'author'), ('foot', 'author', 'author'), ('title', 'author', 'author'), {', '.join(f"('{g}', '{k}', '{k}')" for g in ('title', 'nav', 'foot') for k in ('store', 'developer', 'hardware', 'casino'))}),
ev AS (SELECT DISTINCT site, page_seq, page_type, use.kind, term FROM txt JOIN use USING (g) JOIN voc ON voc.kind = vkind AND contains(txt.n, voc.n)
  UNION ALL SELECT DISTINCT site, page_seq, page_type, 'article_link', unnest(links) FROM pg UNION ALL SELECT site, page_seq, page_type, 'category', unnest(cats) FROM pg UNION ALL SELECT site, page_seq, page_type, 'technical', 'parsed_html' FROM pg
  UNION ALL SELECT site, page_seq, page_type, 'technical', 'structured_data' FROM pg WHERE len(ld) > 0 UNION ALL SELECT site, page_seq, page_type, 'date', unnest(dates) FROM pg
  UNION ALL SELECT site, page_seq, page_type, 'market_language', 'language' FROM pg WHERE lang = 'fr-FR' UNION ALL SELECT site, page_seq, page_type, 'market_location', 'location' FROM pg WHERE list_contains(foot, 'Site in Paris'))"""
EVIDENCE = PAGES + _EVIDENCE

_V2 = f""",
one AS (SELECT site, kind, term, arg_min(page_type, page_seq) AS page_type, count(*) AS n, bool_or(page_type <> 'primary') AS elsewhere FROM ev GROUP BY 1, 2, 3),
agg AS (SELECT site, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ('gaming_identity', 'gaming_navigation', 'gaming_article', 'editorial_navigation', 'author', 'article_link', 'category', 'date', 'technical'))},
  {', '.join(f"list(term) FILTER (kind = '{k}') AS {k}, count(*) FILTER (kind = '{k}') AS n_{k}" for k in ('store', 'developer', 'hardware', 'casino'))},
  coalesce(sum(n) FILTER (kind = 'date'), 0) AS all_dates, coalesce(bool_or(page_type <> 'primary') FILTER (kind IN ('gaming_identity', 'gaming_navigation', 'gaming_article')), false) AS spread,
  coalesce(bool_or(elsewhere) FILTER (kind = 'technical'), false) AS tech_spread, bool_or(kind = 'market_language') AS lang, bool_or(kind = 'market_location') AS loc FROM one GROUP BY site),
hard AS (SELECT *, CASE WHEN list_has_any(store, ['cart', 'checkout']) AND list_has_any(store, ['purchase', 'buy now']) THEN 'dominant_ecommerce_store'
  WHEN list_has_any(developer, ['game portfolio', 'our games']) AND list_has_any(developer, ['investor relations', 'corporate company description']) THEN 'game_developer_corporate_site'
  WHEN list_has_any(casino, ['casino', 'online casino']) AND list_has_any(casino, ['betting', 'sportsbook', 'gambling']) THEN 'casino_or_betting_site'
  WHEN list_has_any(hardware, ['manufacturer']) AND list_has_any(hardware, ['retail', 'hardware store']) THEN 'hardware_manufacturer' END AS hard_rule FROM agg),
sc AS (SELECT *, least(30, least(15, n_gaming_identity * 5) + least(10, n_gaming_navigation * 4) + least(10, n_gaming_article * 4) + spread::INT * 5 + least(5, n_category * 3)) AS gaming_score,
  least(25, least(10, n_editorial_navigation * 3) + least(8, n_article_link * 2) + least(6, n_date * 2) + least(6, n_author * 3) + least(5, n_category * 3)) AS media_score,
  least(20, lang::INT * 15 + loc::INT * 10) AS market_score, CASE WHEN all_dates > 3 THEN 11 WHEN all_dates > 0 THEN 7 ELSE 0 END AS activity_score, (n_technical > 0)::INT * 3 + tech_spread::INT * 2 AS technical_score,
  least(CASE WHEN hard_rule IS NULL THEN 35 ELSE 100 END, CASE WHEN hard_rule = 'dominant_ecommerce_store' THEN 20 ELSE least(20, n_store * 10) END + CASE WHEN hard_rule = 'game_developer_corporate_site' THEN 20 ELSE least(20, n_developer * 10) END
    + CASE WHEN hard_rule = 'casino_or_betting_site' THEN 30 ELSE least(30, n_casino * 15) END + CASE WHEN hard_rule = 'hardware_manufacturer' THEN 15 ELSE least(15, n_hardware * 5) END) AS deductions,
  CASE WHEN hard_rule IS NOT NULL OR greatest(n_store, n_developer, n_casino, n_hardware) >= 2 THEN 'high' WHEN n_store + n_developer + n_casino + n_hardware > 0 THEN 'medium' ELSE 'low' END AS negative_confidence FROM hard),
tot AS (SELECT *, CASE WHEN market_score >= 15 THEN 'confirmed' WHEN market_score > 0 THEN 'probable' ELSE 'unconfirmed' END AS market_status,
  greatest(0, least(100, gaming_score + media_score + market_score + activity_score + technical_score - deductions)) AS total_score FROM sc)
"""
V2_SQL = "WITH " + EVIDENCE + _V2


def evidence(spark, d):
    return V2.site_evidence(site_pages(spark, d), "fr", "paris")


def v2_scored(spark, d):
    return V2.v2_scores(evidence(spark, d), site_pages(spark, d), "FR")


@query(f"WITH {EVIDENCE} SELECT kind, lang, term, (SELECT count(*) FROM txt WHERE contains(txt.n, voc.n)) AS n_texts FROM voc")
def f1_vocabulary(spark, d):
    """The vocabulary, with the texts of all pages that hold each term."""
    voc, c = V2.vocab_table(spark), F.col
    title = F.array_compact(F.array("page_title", "og_site_name", "og_title", "meta_description"))
    texts = F.transform(F.concat(title, "headings", "navigation_labels", "footer_text", "article_links", "author_links"), V2.normalize_text)
    every = sorted({r.term for r in voc.collect()})
    held = site_pages(spark, d).select(F.explode(texts).alias("n")).select(F.explode(V2.match_terms(F.array("n"), every)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return voc.join(held, c("term") == c("t"), "left").select("kind", "lang", "term", F.coalesce("n", F.lit(0)).alias("n_texts"))


@query(f"SELECT doc_id, {NORM.format('text')} AS normal FROM documents")
def f2_normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", V2.normalize_text(F.col("text")).alias("normal"))


@query(f"WITH {EVIDENCE} SELECT site, kind, term, count(*) AS n_pages FROM ev GROUP BY ALL")
def f4_site_evidence(spark, d):
    return evidence(spark, d).groupBy("site", "kind", "term").agg(F.count(F.lit(1)).alias("n_pages"))


@query(V2_SQL + "SELECT site, gaming_score, media_score, market_score, market_status, activity_score, technical_score, deductions, hard_rule, negative_confidence, total_score FROM tot")
def f5_v2_scores(spark, d):
    return v2_scored(spark, d).select("site", "gaming_score", "media_score", "market_score", "market_status", "activity_score", "technical_score", "deductions", "hard_rule", "negative_confidence", "total_score")


@query(V2_SQL + """, st AS (SELECT *, hard_rule IS NOT NULL OR negative_confidence = 'high' AS strong, site % 7 <> 3 AS usable FROM tot),
fs AS (SELECT *, CASE WHEN strong THEN 'rejected' WHEN total_score >= 58 THEN 'verified' WHEN total_score < 40 AND technical_score >= 4 THEN 'rejected' ELSE 'uncertain' END AS first,
  n_gaming_navigation > 0 OR n_gaming_article > 1 OR n_editorial_navigation > 0 OR n_gaming_identity > 0 OR strong AS telling FROM st),
gt AS (SELECT *, CASE first WHEN 'verified' THEN NOT telling WHEN 'rejected' THEN NOT strong ELSE false END AS gated FROM fs)
SELECT site, CASE WHEN usable THEN total_score ELSE 0 END AS total_score, CASE WHEN usable THEN market_status ELSE 'unconfirmed' END AS market_status, CASE WHEN gated OR NOT usable THEN 'uncertain' ELSE first END AS predicted_status,
  CASE WHEN gated OR NOT usable THEN 'uncertain' WHEN first = 'verified' THEN 'gaming_media' WHEN first = 'rejected' THEN 'not_gaming_media' ELSE 'uncertain' END AS relevance_label,
  CASE WHEN usable AND gated THEN 'insufficient_evidence' END AS decision_override FROM gt""")
def f12_v2_decision(spark, d):
    out = V2.v2_decision(v2_scored(spark, d), 58, 40, usable=F.col("site") % 7 != 3)
    return out.select("site", "total_score", "market_status", "predicted_status", "relevance_label", "decision_override")
