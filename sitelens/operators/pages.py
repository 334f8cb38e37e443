"""Signals of pages (page_id, url, html), by JVM regular expressions in one projection; JSON-LD by a vectorised step for pages that have it."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lists import clean_text, present


@dataclass(frozen=True)
class Limits:
    """How much of a page is read; None reads all. The defaults are the values of the published rules."""

    chars: int | None = 2_000_000
    headings: int | None = 100
    nav: int | None = 150
    footer: int | None = 50
    anchors: int | None = 500
    times: int | None = 100
    jsonld_blocks: int | None = 20
    jsonld_chars: int | None = 50_000


LIMITS = Limits()
MAX_ANCHORS, MAX_JSONLD_DEPTH = LIMITS.anchors, 10
#: Paths of articles and of authors.
ARTICLE = r"(?i)/(news|reviews|guides|features|interviews|article|post)/"
AUTHOR = r"(?i)/(author|writer|profile)/"


def first_of(items: Column, most: int | None) -> Column:
    """The first ``most`` items; all if it is None."""
    return items if most is None else F.slice(items, 1, most)


def all_of(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), group)


def entities(c: Column) -> Column:
    """The common character entities decoded."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def inner_text(fragment: Column) -> Column:
    """Text of an HTML fragment: tags removed, entities decoded, cleaned; null if blank."""
    return clean_text(entities(F.regexp_replace(fragment, r"<[^>]*>", "")))


def texts_of(fragments: Column, most: int | None = None) -> Column:
    """Distinct texts in order of the first ``most`` fragments, or of all."""
    return F.array_distinct(F.filter(F.transform(first_of(fragments, most), inner_text), lambda t: t.isNotNull()))


def attribute(tag: Column, name: str) -> Column:
    """Value of a quoted or bare attribute of one tag; null if absent."""
    m = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.when(tag.rlike(m), entities(F.concat(*[F.coalesce(F.regexp_extract(tag, m, i), F.lit("")) for i in (1, 2, 3)])))


def meta_content(html: Column, key: str, value: str) -> Column:
    """``content`` of the first meta tag whose ``key`` attribute is ``value``."""
    tags = F.filter(all_of(html, r"(?is)(<meta\s[^>]*>)"), lambda t: F.lower(attribute(t, key)) == value)
    return clean_text(attribute(F.get(tags, F.lit(0)), "content"))


def anchors(html: Column, most: int | None = MAX_ANCHORS) -> Column:
    """Array of (href, rel, text) of the first ``most`` anchors with an href; of all if ``most`` is None."""
    tags = F.filter(all_of(html, r"(?is)(<a\s.*?</a>)"), lambda t: attribute(F.regexp_extract(t, r"(?is)^(<a[^>]*>)", 1), "href").isNotNull())

    def parts(t: Column) -> Column:
        head = F.regexp_extract(t, r"(?is)^(<a[^>]*>)", 1)
        return F.struct(attribute(head, "href").alias("href"), attribute(head, "rel").alias("rel"), inner_text(t).alias("text"))

    return F.transform(first_of(tags, most), parts)


def first_title(html: Column) -> Column:
    """First title with text, else null."""
    return F.get(F.filter(F.transform(all_of(html, r"(?is)<title[^>]*>(.*?)</title>"), inner_text), lambda t: t.isNotNull()), F.lit(0))


def challenge_flags(title: Column) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    return present(
        F.when(t.contains("just a moment") | t.contains("attention required") | t.contains("cloudflare"), "cloudflare_challenge"),
        F.when(t.contains("access denied") | t.contains("403 forbidden"), "access_denied"),
    )


def parking_flags(title: Column) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    return present(F.when(t.contains("domain for sale") | t.contains("parked domain"), "domain_parked_or_for_sale"))


def with_flags(d: DataFrame) -> DataFrame:
    """Adds what follows from the other signals: no categories, challenge and parking indicators of the title."""
    title = F.col("page_title")
    return d.select("*", F.array().cast("array<string>").alias("detected_categories"), challenge_flags(title).alias("challenge_indicators"), parking_flags(title).alias("parking_indicators"))


def page_signals(pages: DataFrame, html_col: str = "html", limits: Limits = LIMITS) -> DataFrame:
    """All columns of ``pages`` but the html, and its signals. Null html gives null and empty signals."""
    h = F.coalesce(F.col(html_col), F.lit(""))
    h = h if limits.chars is None else F.substring(h, 1, limits.chars)
    nav = F.flatten(F.transform(all_of(h, r"(?is)<nav(?:\s[^>]*)?>(.*?)</nav>"), lambda n: first_of(all_of(n, r"(?is)<(?:a|button)(?:\s[^>]*)?>(.*?)</(?:a|button)>"), limits.nav)))
    foot = F.flatten(F.transform(all_of(h, r"(?is)<footer(?:\s[^>]*)?>(.*?)</footer>"), lambda n: first_of(all_of(n, r"(?is)<(?:a|p|span)(?:\s[^>]*)?>(.*?)</(?:a|p|span)>"), limits.footer)))
    times = F.transform(
        first_of(all_of(h, r"(?is)(<time(?:\s[^>]*)?>.*?</time>)"), limits.times),
        lambda t: F.coalesce(attribute(F.regexp_extract(t, r"(?is)^(<time[^>]*>)", 1), "datetime"), inner_text(t)),
    )
    published = F.transform(
        F.filter(all_of(h, r"(?is)(<meta\s[^>]*>)"), lambda t: attribute(t, "property").isin("article:published_time", "article:modified_time")), lambda t: attribute(t, "content")
    )
    d = pages.select(
        *[c for c in pages.columns if c != html_col],
        clean_text(inner_text(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1))).alias("page_title"),
        meta_content(h, "name", "description").alias("meta_description"),
        *[meta_content(h, "property", f"og:{k}").alias(f"og_{k}") for k in ("title", "description", "site_name")],
        clean_text(attribute(F.regexp_extract(h, r"(?is)(<html[^>]*>)", 1), "lang")).alias("html_language"),
        clean_text(attribute(F.get(F.filter(all_of(h, r"(?is)(<link\s[^>]*>)"), lambda t: F.lower(attribute(t, "rel")) == "canonical"), F.lit(0)), "href")).alias("canonical_url"),
        texts_of(all_of(h, r"(?is)<h[1-3](?:\s[^>]*)?>(.*?)</h[1-3]>"), limits.headings).alias("headings"),
        first_of(texts_of(nav), limits.nav).alias("navigation_labels"),
        first_of(texts_of(foot), limits.footer).alias("footer_text"),
        anchors(h, limits.anchors).alias("_a"),
        F.array_compact(F.concat(times, published)).alias("_dates"),
        F.when(h.contains("ld+json"), jsonld(h, limits)).alias("_ld"),
    )
    href = lambda keep: F.sort_array(F.array_distinct(F.transform(F.filter("_a", keep), lambda a: a.href)))
    return with_flags(
        d.select(
            *[c for c in d.columns if not c.startswith("_")],
            href(lambda a: a.href.rlike(ARTICLE)).alias("article_links"),
            href(lambda a: a.href.rlike(AUTHOR) | F.coalesce(a.rel == "author", F.lit(False))).alias("author_links"),
            F.coalesce(F.col("_ld.types"), F.array().cast("array<string>")).alias("json_ld_types"),
            F.sort_array(F.array_distinct(F.concat("_dates", F.coalesce(F.col("_ld.dates"), F.array().cast("array<string>"))))).alias("detected_publication_dates"),
        )
    )


_LD = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("types", "dates", "emails")])


def read_jsonld(blocks: list[str]) -> dict[str, list[str]]:
    """Sorted and distinct types, dates and emails of JSON-LD blocks; those that are broken or nested too deep to be read are passed over."""
    import json

    found = {"types": set(), "dates": set(), "emails": set()}
    for block in blocks:
        try:
            level = [json.loads(block)]
        except (ValueError, RecursionError):
            continue
        for _ in range(MAX_JSONLD_DEPTH):
            deeper = []
            for x in level:
                if isinstance(x, list):
                    deeper += x
                elif isinstance(x, dict):
                    kinds = x.get("@type", [])
                    found["types"].update(k for k in ([kinds] if isinstance(kinds, str) else kinds if isinstance(kinds, list) else []) if isinstance(k, str))
                    found["dates"].update(x[k] for k in ("datePublished", "dateModified") if isinstance(x.get(k), str))
                    found["emails"].update([x["email"]] if isinstance(x.get("email"), str) else [])
                    deeper += x.values()
            level = deeper
    return {k: sorted(v) for k, v in found.items()}


def jsonld(html: Column, limits: Limits = LIMITS) -> Column:
    """Struct (types, dates, emails) of the JSON-LD blocks, as ``read_jsonld`` finds them."""

    @F.pandas_udf(_LD)
    def read(blocks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_jsonld([] if own is None else list(own)) for own in blocks], columns=["types", "dates", "emails"])

    found = first_of(all_of(html, r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), limits.jsonld_blocks)
    return read(F.filter(found, lambda b: (F.trim(b) != "") & (F.lit(True) if limits.jsonld_chars is None else F.length(b) <= limits.jsonld_chars)))


MAX_CONTACT_BLOCKS, MAX_CONTACT_DEPTH = 10, 8


def jsonld_contacts(html: Column) -> Column:
    """Array of (email, kind) of the ContactPoint and Organization objects in the first JSON-LD blocks that can be read, in order; kind is contactType."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("email", T.StringType()), T.StructField("kind", T.StringType())])))
    def read(blocks: pd.Series) -> pd.Series:
        import json

        def walk(x, depth):
            if depth >= MAX_CONTACT_DEPTH:
                return
            if isinstance(x, dict):
                if x.get("@type") in ("ContactPoint", "Organization") and isinstance(x.get("email"), str):
                    yield x["email"], str(x.get("contactType", ""))
                x = list(x.values())
            for y in x if isinstance(x, list) else []:
                yield from walk(y, depth + 1)

        def contacts(own):
            found, n = [], 0
            for block in [] if own is None else own:
                if n >= MAX_CONTACT_BLOCKS:
                    break
                try:
                    data = json.loads(block)
                except (ValueError, RecursionError):
                    continue
                n += 1
                found += [{"email": e, "kind": k} for e, k in walk(data, 0)]
            return found

        return blocks.map(contacts)

    return read(all_of(html, r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""))


def page_shell_class(html: Column) -> Column:
    """challenge, js_shell or null for the body of a page."""
    t = F.lower(html)
    return F.when(
        t.contains("just a moment...") | t.contains("cf-browser-verification") | (t.contains("attention required") & t.contains("cloudflare")), "challenge"
    ).when((F.length(html) < 2000) & t.contains("enable javascript"), "js_shell")


def fetch_outcome(status: Column, error: Column) -> Column:
    """Struct (code, retryable) of a fetch; null code for a usable answer."""
    code = (
        F.when(error.isNotNull(), error)
        .when(status == 204, "empty_html")
        .when(status.isin(401, 403, 404, 429), F.concat(F.lit("http_"), status.cast("string")))
        .when(status.isin(500, 502, 503, 504), "http_5xx")
        .when(status >= 400, "unknown")
    )
    return F.struct(code.alias("code"), F.coalesce(code.isin("http_5xx", "timeout", "connection_error", "dns_error", "http_429"), F.lit(False)).alias("retryable"))


def usable_evidence(success: Column, html: Column) -> Column:
    return F.coalesce(success & (F.length(html) > 100) & page_shell_class(html).isNull() & (F.size(challenge_flags(first_title(html))) == 0), F.lit(False))


def failure_category(success: Column, error: Column, html: Column) -> Column:
    """Why a page gives no usable evidence: the fetch's error, empty_html, challenge, js_shell or too_short; null if it does."""
    body = F.coalesce(html, F.lit(""))
    shell = F.when(F.size(challenge_flags(first_title(body))) > 0, "challenge").otherwise(page_shell_class(body))
    bad = F.when(~F.coalesce(success, F.lit(False)), F.coalesce(error, F.lit("unknown"))).when(body == "", "empty_html").when(shell.isNotNull(), shell)
    return bad.when(F.length(body) <= 100, "too_short")


def assemble_site_pages(pages: DataFrame) -> DataFrame:
    """Per site: primary page (first success by page_seq, else first failure), counts of pages and of usable supporting pages.

    ``pages``: site, page_seq, success, usable. Only aggregates; no site's pages are gathered.
    """
    order = F.struct((~F.col("success")).cast("int").alias("failed"), "page_seq")
    return pages.groupBy("site").agg(
        F.min_by("page_seq", order).alias("primary_seq"),
        F.max("success").alias("transport_success"),
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if("usable").alias("n_usable"),
    )


def acquisition(pages: DataFrame, entries: DataFrame | None = None, least_entries: int = 2) -> DataFrame:
    """Per site what was acquired: primary_seq, usable_primary, n_usable_supporting, n_valid_entries and usable_evidence.

    ``pages``: site, page_seq, success, html. The primary page is the first success by page_seq, else the first failure;
    pages with html are usable. ``entries``: site, title, link of feed entries; valid ones have both. There is usable
    evidence if the primary page is usable, a supporting one is, or ``least_entries`` entries are valid. Sites with
    entries alone have no primary page. Null and empty html is not usable; a null success is a failure.
    """
    ok = F.coalesce("success", F.lit(False))
    usable = F.coalesce(F.length("html") > 0, F.lit(False))
    order = F.struct((~ok).cast("int").alias("failed"), "page_seq")
    d = pages.groupBy("site").agg(F.min_by("page_seq", order).alias("primary_seq"), F.min_by(usable, order).alias("usable_primary"), F.count_if(usable).alias("n_usable"))
    d = d.withColumn("n_usable_supporting", F.col("n_usable") - F.col("usable_primary").cast("long")).drop("n_usable")
    if entries is None:
        d = d.withColumn("n_valid_entries", F.lit(0).cast("long"))
    else:
        n = entries.groupBy("site").agg(F.count_if(F.col("title").isNotNull() & F.col("link").isNotNull()).alias("n_valid_entries"))
        d = d.join(n, "site", "full_outer").fillna(0, ["n_valid_entries", "n_usable_supporting"]).fillna(False, ["usable_primary"])
    return d.withColumn("usable_evidence", F.col("usable_primary") | (F.col("n_usable_supporting") > 0) | (F.col("n_valid_entries") >= least_entries))
