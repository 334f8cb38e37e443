"""Contact extraction and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lists import let
from ..functions.skew import MOST_HOT, join_by_key
from ..functions.urls import absolute_url, registered_domain, url_parts
from .pages import all_of, anchors, attribute, entities, inner_text, jsonld_contacts

#: Patterns of addresses, roles and categories, in order of priority.
EMAIL = r"^[a-zA-Z0-9._%+-]{1,64}@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
HARD_REJECT = r"(?i)^(example|email|name|yourname)@(example|domain)\.(com|org|net)$"
PLACEHOLDER = r"(?i)^(test|admin|user)@"
ROLE = r"(?i)^(info|contact|hello|support|press|media|pr|ads?|advertising|sponsors?|partners?|partnerships?|editor|editorial|news|tips?|submissions?|business|sales|inquiries|enquiries)$"
#: An address written out: up to 64 characters before a sign for at, a domain, a sign for dot, letters. Looked for once a run of such characters, not from
#: each of them: a match can only begin at a run's start, where the last one ended, or 64 before a run's end, and a run is passed over unless a sign follows.
OBFUSCATED = (
    r"(?i)(?:\G|(?<![a-zA-Z0-9._%+-]))(?=[a-zA-Z0-9._%+-]++\s*+(?:\[at\]|\(at\)|@|(?<=\s)AT\s))(?>[a-zA-Z0-9._%+-]*?([a-zA-Z0-9._%+-]{1,64}+)\s*+(?:\[at\]|\(at\)|@|(?<=\s)AT\s))"
    r"\s*([a-zA-Z0-9.-]+)\s*(?:\[dot\]|\(dot\)|\sDOT\s|\.)\s*([a-zA-Z]{2,})"
)
CATEGORIES = (
    ("tips", r"(?i)\b(tips?|scoops?|leaks?)\b"),
    ("submissions", r"(?i)\b(submissions?|pitches|pitch|contribute)\b"),
    ("advertising", r"(?i)\b(ads?|advertising|sales|sponsor(?:ship|s)?)\b"),
    ("partnerships", r"(?i)\b(partners?|partnerships?|collab(?:orations?)?)\b"),
    ("press", r"(?i)\b(press|media|pr)\b"),
    ("editorial", r"(?i)\b(editor(?:ial|s)?|news|desk)\b"),
    ("business", r"(?i)\b(biz|business|corporate)\b"),
    ("support", r"(?i)\b(support|help|service)\b"),
    ("general", r"(?i)\b(contact|info|hello|enquiries|inquiries|hi)\b"),
)
#: Free mail hosts, words of contact forms and of others, and kinds of links with their points.
FREE_MAIL = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "aol.com", "protonmail.com")
FORM_WORDS = ("message", "contact", "email", "inquiry", "subject", "body")
FORM_REJECTS = ("login", "password", "sign up", "register", "search", "comment", "newsletter", "checkout", "subscribe")
LINK_TYPES = (
    (None, r"(?i)\b(?:login|signup|account|shop|store|comments?|forum|tags?|categories|articles?|authors?|privacy|terms|careers?|newsletter|faq)\b", 0),
    ("support", r"(?i)\b(?:support|help)\b", 30),
    ("advertising", r"(?i)\b(?:advertise|advertising|partnerships?|partner with us|sponsors?|sponsorship)\b|広告", 90),
    ("editorial", r"(?i)\b(?:editorial|editors?|masthead|write for us|submissions?|news tips?|tip us)\b|編集部|情報提供", 90),
    ("contact", r"(?i)\b(?:contact(?: us)?|business|press|media kit)\b|お問い合わせ", 100),
    ("about", r"(?i)\b(?:about(?: us)?|team|staff|contributors?|company|corporate)\b|会社概要|運営会社|採用情報", 70),
)


def validate_email(raw: Column) -> Column:
    """Struct (email, normalized_email, is_role, is_placeholder); null if it is no usable address."""

    def build(e: Column) -> Column:
        local, domain = F.regexp_extract(e, r"^(.*)@", 1), F.lower(F.regexp_extract(e, r"@([^@]*)$", 1))
        norm = F.concat(local, F.lit("@"), domain)
        ok = (F.length(e) <= 254) & e.rlike(EMAIL) & ~domain.rlike(r"\.\.|^\.") & ~norm.rlike(HARD_REJECT)
        return F.when(ok, F.struct(e.alias("email"), norm.alias("normalized_email"), local.rlike(ROLE).alias("is_role"), norm.rlike(PLACEHOLDER).alias("is_placeholder")))

    return let(F.regexp_replace(raw, r"""^[ \t\n\r"'.,:;]+|[ \t\n\r"'.,:;]+$""", ""), build)


def emails_in_text(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """Addresses among the blank-separated tokens of ``text``: the ``keep`` columns, pos (of the token) and the parts of validate_email."""
    tokens = F.filter(F.transform(F.split(text, r"\s+"), lambda t, i: F.struct(i.alias("pos"), t.alias("t"))), lambda x: x.t.contains("@"))
    d = df.select(*keep, F.explode(tokens).alias("x")).select(*keep, "x.pos", validate_email(F.col("x.t")).alias("e"))
    return d.where("e is not null").select(*keep, "pos", "e.*")


def emails_deobfuscated(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """Addresses written with [at] and [dot] or the like, put together again; ``written_out`` is false for those that stand as plain addresses."""
    local, domain, tld = (F.regexp_extract("m", OBFUSCATED, i) for i in (1, 2, 3))
    d = df.select(*keep, F.posexplode(F.regexp_extract_all(text, F.lit(OBFUSCATED), F.lit(0))).alias("pos", "m"))
    d = d.select(*keep, "pos", "m", F.concat(local, F.lit("@"), domain, F.lit("."), tld).alias("raw"))
    d = d.select(*keep, "pos", (~F.endswith("m", "raw")).alias("written_out"), validate_email(F.col("raw")).alias("e"))
    return d.where("e is not null").select(*keep, "pos", "written_out", "e.*")


def emails_mailto(pages: DataFrame, html: Column, *keep: str) -> DataFrame:
    """Addresses of mailto anchors, with the anchor's text."""
    links = F.filter(anchors(html, None), lambda a: F.lower(a.href).startswith("mailto:"))
    d = pages.select(*keep, F.posexplode(links).alias("pos", "a"))
    d = d.select(*keep, "pos", F.col("a.text").alias("nearby_text"), validate_email(F.regexp_replace(F.substring(F.col("a.href"), 8, 1000), r"\?.*$", "")).alias("e"))
    return d.where("e is not null").select(*keep, "pos", "nearby_text", "e.*")


def emails_in_elements(pages: DataFrame, html: Column, *keep: str) -> DataFrame:
    """Addresses in the text of p, div, span, li and td elements, plain and written out; elements without an at sign are passed over.

    An element's text ends where the next of these elements begins or ends, so nested texts are read once. An element's
    address comes once; ``written_out`` is false if it stands there as a plain address too.
    """
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)(?:\s[^>]*)?>.*?</\1>|<!--.*?-->", " ")
    parts = F.split(bare, r"(?i)</?(?:p|div|span|li|td)(?:\s[^>]*)?>")
    texts = F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(entities(F.regexp_replace(x, r"<[^>]*>", " ")), r"\s+", " "))), lambda t: F.lower(t).rlike(r"@|\[at\]|\(at\)"))
    d = pages.select(*keep, F.posexplode(texts).alias("element", "_text"))
    plain = emails_in_text(d, F.col("_text"), *keep, "element").withColumn("written_out", F.lit(False))
    both = plain.unionByName(emails_deobfuscated(d, F.col("_text"), *keep, "element"))
    first = F.min(F.struct("written_out", "email")).alias("f")
    return both.groupBy(*keep, "element", "normalized_email", "is_role", "is_placeholder").agg(first).select(*keep, "element", "f.email", "normalized_email", "is_role", "is_placeholder", "f.written_out")


def emails_jsonld(pages: DataFrame, html: Column, *keep: str) -> DataFrame:
    """Addresses of ContactPoint and Organization objects in JSON-LD, with their contact type as nearby_text and confidence 0.9."""
    d = pages.select(*keep, F.when(F.coalesce(html, F.lit("")).contains("ld+json"), jsonld_contacts(html)).alias("_c"))
    d = d.select(*keep, F.posexplode("_c").alias("pos", "c")).select(*keep, "pos", F.substring("c.kind", 1, 500).alias("nearby_text"), validate_email(F.col("c.email")).alias("e"))
    return d.where("e is not null").select(*keep, "pos", "nearby_text", "e.*", F.lit(0.9).alias("confidence"), F.lit("json_ld").alias("extraction_method"))


def contact_run_totals(sites: DataFrame) -> DataFrame:
    """One row over ``sites`` (success, n_contacts, n_forms): processed, with contacts or forms, contacts, forms, failed."""
    some = F.col("success") & ((F.col("n_contacts") > 0) | (F.col("n_forms") > 0))
    none = lambda c: F.coalesce(c, F.lit(0))
    return sites.agg(
        F.count(F.lit(1)).alias("sites_processed"), F.count_if(some).alias("sites_with_contacts"), none(F.sum("n_contacts")).alias("contacts_found"), none(F.sum("n_forms")).alias("forms_found"),
        F.count_if(~F.col("success")).alias("failed_count"),
    )


def emails_simple(html: Column) -> Column:
    """Struct (advertising, contact): of the addresses anywhere in ``html``, the last with ad, sales or sponsor, and the first other, else the first."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"), 1))
    found = F.filter(found, lambda e: ~F.lower(e).rlike(r"\.(png|jpg|jpeg|gif|svg|webp)$|sentry|example"))
    ad = lambda e: F.lower(e).rlike("ad|sales|sponsor")
    return let(found, lambda a: F.struct(F.try_element_at(F.filter(a, ad), F.lit(-1)).alias("advertising"), F.coalesce(F.get(F.filter(a, lambda e: ~ad(e)), F.lit(0)), F.get(a, F.lit(0))).alias("contact")))


def classify_contact(local: Column, context: Column, is_role: Column) -> Column:
    """Struct (primary_type, secondary_types): categories of local part and context by priority; a role's own category comes first unless it is general."""

    def shown(c: Column) -> Column:
        return F.array_compact(F.array(*[F.when(c.rlike(p), name) for name, p in CATEGORIES]))

    own = shown(local)
    both = shown(F.concat_ws("\n", local, context))
    best = F.get(own, F.lit(0))
    ordered = F.when(is_role & best.isNotNull() & (best != "general"), F.concat(F.array(best), F.array_remove(both, best))).otherwise(both)
    return let(F.when(F.size(ordered) == 0, F.array(F.lit("unknown"))).otherwise(ordered), lambda a: F.struct(F.element_at(a, 1).alias("primary_type"), F.slice(a, 2, 9).alias("secondary_types")))


def merge_contacts(raw: DataFrame) -> DataFrame:
    """One row per (site, normalized_email): the first row's attributes by first_seen_order and the number of distinct pieces of evidence."""
    evidence = F.struct("source_url", "extraction_method", "nearby_text")
    first = F.struct("email", "is_role", "is_placeholder", "confidence", "first_seen_order")
    return raw.groupBy("site", "normalized_email").agg(
        F.min_by(first, "first_seen_order").alias("f"),
        F.count_distinct(evidence).alias("n_evidence"),
        F.max(F.col("extraction_method") == "mailto").alias("has_mailto"),
        F.max(F.col("extraction_method") == "json_ld").alias("has_json_ld"),
        F.max(F.col("off_home") & F.col("source_page_type").isin("contact", "advertising", "editorial", "about")).alias("dedicated"),
        F.max("off_home").alias("off_home"),
    ).select("site", "normalized_email", "f.*", "n_evidence", "has_mailto", "has_json_ld", "dedicated", "off_home")


def rank_contact(merged: DataFrame, domain: Column, primary_type: Column) -> DataFrame:
    """``merged`` with rank_score from 0 to 100. ``displayed`` gives the order in which contacts are shown."""
    mail = F.split_part("normalized_email", F.lit("@"), F.lit(2))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    near = F.when((mail == domain) | mail.endswith(F.concat(F.lit("."), domain)), 20).when(mail.isin(*FREE_MAIL), -20).otherwise(-10)
    score = (
        yes(F.col("dedicated")) * 40 + yes(F.col("has_mailto")) * 30 + near + yes(F.col("is_role")) * 10 + yes(~primary_type.isin("unknown", "general")) * 10
        + yes(F.col("has_json_ld")) * 10 + F.least(F.lit(30), (F.col("n_evidence") - 1) * 10) - yes(~F.col("off_home")) * 50 - yes(F.col("is_placeholder")) * 80
    )
    return merged.withColumn("rank_score", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int"))


def displayed(ranked: DataFrame, site: str = "site") -> DataFrame:
    """``ranked`` with ``display`` from 1 in each site: by rank_score, then address."""
    return ranked.withColumn("display", F.row_number().over(Window.partitionBy(site).orderBy(F.col("rank_score").desc(), "normalized_email")))


def best_contact(ranked: DataFrame, site: str = "site") -> DataFrame:
    row = F.struct(*ranked.columns)
    return ranked.groupBy(site).agg(F.min_by(row, F.struct((-F.col("rank_score")).alias("s"), "normalized_email")).alias("b")).select("b.*")


def detect_forms(pages: DataFrame, html: Column, url: Column, *keep: str) -> DataFrame:
    """Contact forms, at most five of a page: action_url, is_external, method, field_names, confidence, seq."""

    def fields(form: Column) -> Column:
        return F.filter(all_of(form, r"(?is)(<(?:input|textarea|select)(?:\s[^>]*)?>)"), lambda t: F.lower(F.coalesce(attribute(t, "type"), F.lit(""))) != "hidden")

    def keep_form(form: Column) -> Column:
        head, text = F.lower(F.coalesce(attribute(F.regexp_extract(form, r"(?is)^(<form[^>]*>)", 1), "action"), F.lit(""))), F.lower(F.coalesce(inner_text(F.replace(form, F.lit("<"), F.lit(" <"))), F.lit("")))
        kind = lambda t: F.lower(F.coalesce(attribute(t, "type"), F.lit("")))
        name = lambda t: F.lower(F.coalesce(attribute(t, "name"), F.lit("")))
        barred = F.exists(fields(form), lambda t: kind(t).isin("password", "search") | name(t).isin("q", "s"))
        held = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w) | head.contains(w))
        named = F.exists(fields(form), lambda t: name(t).rlike("|".join(FORM_WORDS)))
        return ~barred & ~held(FORM_REJECTS) & (held(FORM_WORDS) | named)

    forms = F.slice(F.filter(all_of(html, r"(?is)(<form(?:\s[^>]*)?>.*?</form>)"), keep_form), 1, 5)
    d = pages.select(*keep, url.alias("page_url"), F.posexplode(forms).alias("seq", "form"))
    head = F.regexp_extract("form", r"(?is)^(<form[^>]*>)", 1)
    action = absolute_url(F.col("page_url"), F.nullif(attribute(head, "action"), F.lit("")))
    names = F.slice(F.filter(F.transform(fields(F.col("form")), lambda t: F.lower(attribute(t, "name"))), lambda n: n.isNotNull() & (n != "")), 1, 20)
    d = d.select(*keep, "page_url", "seq", action.alias("action_url"), F.lower(F.coalesce(attribute(head, "method"), F.lit("get"))).alias("method"), names.alias("field_names"))
    gle = F.coalesce(F.col("action_url").contains("forms.gle"), F.lit(False))
    site = lambda u: registered_domain(url_parts(u).host)
    external = gle | F.coalesce(site(F.col("action_url")) != site(F.col("page_url")), F.lit(False))
    return d.withColumn("is_external", external).withColumn("confidence", F.when(gle, 0.9).otherwise(0.8))


def dedup_forms(forms: DataFrame, site: str = "site") -> DataFrame:
    """One form per site, action and set of fields: the most confident, the first on a tie."""
    key = F.concat_ws("_", F.coalesce("action_url", F.lit("")), F.array_join(F.sort_array("field_names"), "-"))
    row = F.struct(*forms.columns)
    return forms.withColumn("_k", key).groupBy(site, "_k").agg(F.min_by(row, F.struct((-F.col("confidence")).alias("c"), F.col("seq"))).alias("f")).select("f.*")


def contact_page_links(pages: DataFrame, html: Column, base: Column, *keep: str) -> DataFrame:
    """Links of a page to its publisher's contact pages: url, page_type, score, seq (first discovery). One row per URL, the best score kept."""
    found = F.transform(F.slice(F.filter(anchors(html, 300), lambda a: ~F.lower(a.href).startswith("mailto:")), 1, 300), lambda a, i: F.struct(i.alias("seq"), a.href.alias("href"), F.coalesce(a.text, F.lit("")).alias("text")))
    d = pages.select(*keep, base.alias("base"), F.explode(found).alias("a")).select(*keep, "base", "a.*", absolute_url(F.col("base"), F.trim("a.href")).alias("url"))
    d = d.withColumn("url", F.regexp_replace("url", "#.*$", "")).where(F.col("url").rlike("^https?://"))
    path = F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1)
    site = lambda u: registered_domain(url_parts(u).host)
    d = d.where(site(F.col("url")) == site(F.col("base")))
    text = F.concat_ws(" ", F.col("text"), path)
    kind, score = F.lit(None).cast("string"), F.lit(0)
    for name, pattern, points in reversed(LINK_TYPES):
        hit = text.rlike(pattern)
        kind, score = F.when(hit, F.lit(name)).otherwise(kind), F.when(hit, points).otherwise(score)
    depth = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    d = d.withColumn("page_type", kind).withColumn("score", score - F.greatest(depth - 1, F.lit(0)) * 5).where("page_type is not null")
    return d.groupBy(*keep, "url").agg(F.max_by("page_type", F.struct("score", (-F.col("seq")).alias("s"))).alias("page_type"), F.max("score").alias("score"), F.min("seq").alias("seq"))


def select_diverse(links: DataFrame, by: str, k: int = 5) -> DataFrame:
    """Up to ``k`` links of each ``by``: within their type's quota (contact 2, others 1) first, then by score and discovery."""
    order = (F.col("score").desc(), F.col("seq"), F.col("url"))
    quota = F.when(F.col("page_type") == "contact", 2).otherwise(1)
    d = links.withColumn("_t", F.row_number().over(Window.partitionBy(by, "page_type").orderBy(*order)) > quota)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("_t", *order))).where(F.col("rank") <= k).drop("_t")


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(host, seq, allow, path) that hold for ``agent`` (lower case) from robots (host, body): the first group whose token is part of it, else the first ``*`` group."""
    lines = robots.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("seq", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", "#.*$", "")))
    kv = lines.select("host", "seq", F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.regexp_replace("line", r"^[^:]*:?", "")).alias("v"), (F.trim("raw") == "").alias("blank"))
    w = Window.partitionBy("host").orderBy("seq")
    agent_line = F.col("k") == "user-agent"
    kv = kv.withColumn("prev", F.lag(agent_line).over(w)).withColumn("group", F.sum(F.when(agent_line & ~F.coalesce("prev", F.lit(False)), 1).otherwise(0)).over(w))
    names = kv.where(agent_line).withColumn("rank", F.when(F.lit(agent).contains(F.lower("v")) & ~F.col("v").isin("*", ""), 0).when(F.col("v") == "*", 1)).where("rank is not null")
    chosen = names.groupBy("host").agg(F.min_by("group", F.struct("rank", "seq")).alias("g"))
    rules = kv.where(F.col("k").isin("allow", "disallow")).join(chosen, "host").where("group = g")
    return rules.select("host", "seq", (F.col("k") == "allow").alias("allow"), F.col("v").alias("path"))


#: Paths of one host that a task probes together.
ROBOTS_ROWS = 100_000


def first_rules(keys: DataFrame, rules: DataFrame, part_rows: int = ROBOTS_ROWS) -> DataFrame:
    """(host, path, allow): of each of ``keys`` (host, path: distinct) the first rule in file order that begins its path; paths without one are left out.

    A host's rules are put by their paths into one table a task, which is probed with the beginnings of each URL's path in
    the lengths that rules have; no row is made for a path and a rule. Paths of a host beyond ``part_rows`` are dealt to
    parts, each with a copy of its rules. A host's rules are those of one robots file.
    """
    counts = keys.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    parts = counts.select("host", F.greatest(F.ceil(F.col("n") / part_rows), F.lit(1)).cast("int").alias("parts"))
    own = rules.where("path <> ''").join(parts, "host").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    many = F.broadcast(parts.where("parts > 1").orderBy(F.col("parts").desc(), "host").limit(MOST_HOT).withColumnRenamed("host", "__hot"))
    dealt = keys.join(many, F.col("host") == F.col("__hot"), "left").withColumn("part", F.pmod(F.xxhash64("path"), F.coalesce("parts", F.lit(1))).cast("int"))

    def probe(paths, table):
        import pyarrow as pa

        first: dict[str, tuple[int, bool]] = {}
        for seq, allow, path in zip(*(table.column(c).to_pylist() for c in ("seq", "allow", "path")), strict=True):
            if path not in first or seq < first[path][0]:
                first[path] = (seq, allow)
        lengths = sorted({len(p) for p in first})
        verdicts = []
        for path in paths.column("path").to_pylist():
            hits = [first[path[:n]] for n in lengths if n <= len(path) and path[:n] in first] if path is not None else []
            verdicts.append(min(hits)[1] if hits else None)
        return pa.table([paths.column("host"), paths.column("path"), pa.array(verdicts, pa.bool_())], names=["host", "path", "allow"])

    left = dealt.select("host", "path", "part")
    right = own.select(F.col("host").alias("of"), F.col("part").alias("copy"), "seq", "allow", "path")
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("allow", T.BooleanType())])
    return left.groupBy("host", "part").cogroup(right.groupBy("of", "copy")).applyInArrow(probe, schema).where("allow is not null")


def robots_filter(urls: DataFrame, robots: DataFrame, agent: str, on_error: bool = False, part_rows: int = ROBOTS_ROWS) -> DataFrame:
    """``urls`` (host, path, ...) with allowed. ``robots``: host, status_code, body. 404 and 410 allow, 401 and 403 deny, 429, 5xx and other failures are ``on_error``. A robots file that came from another host than it was asked of
    (``final_host``, if there is such a column) denies. The first rule in file order whose path begins the URL's decides; an empty Disallow allows."""
    rules = robots_rules(robots.where("status_code = 200"), agent)
    first = first_rules(urls.select("host", "path").where("host is not null and path is not null").distinct(), rules, part_rows)
    moved = F.coalesce(F.lower("final_host") != F.lower("host"), F.lit(False)) if "final_host" in robots.columns else F.lit(False)
    counts = urls.groupBy("host").agg(F.count(F.lit(1)).alias("__urls"))
    answers = counts.join(robots.select("host", "status_code", moved.alias("_moved")), "host", "left")
    d = join_by_key(urls, answers, "host", "__urls", F.xxhash64("path")).join(first, ["host", "path"], "left")
    s = F.col("status_code")
    verdict = F.when(s.isNull() | s.isin(404, 410), True).when(s.isin(401, 403) | ((s == 200) & F.col("_moved")), False).when(s == 200, F.coalesce("allow", F.lit(True))).otherwise(on_error)
    return d.select(*urls.columns, verdict.alias("allowed"))


def filter_named(contacts: DataFrame, status: Column, include_named: bool = False, allow_uncertain: bool = False) -> DataFrame:
    shut = status.isin("rejected", "fetch_failed") if allow_uncertain else status.isin("rejected", "fetch_failed", "uncertain")
    return contacts.where(~shut & (F.col("is_role") | F.lit(include_named)))


def social_and_pages(html: Column, base: Column) -> Column:
    """Struct of social profiles (last wins), contact page and media kit (first wins)."""

    def pick(a: Column) -> Column:
        last = lambda keep: F.try_element_at(F.filter(a, keep), F.lit(-1)).getField("href")
        first = lambda p: absolute_url(base, F.get(F.filter(a, lambda x: F.lower(F.concat_ws(" ", x.href, x.text)).rlike(p)), F.lit(0)).getField("href"))
        return F.struct(
            last(lambda x: x.href.contains("linkedin.com")).alias("linkedin"),
            last(lambda x: x.href.rlike(r"(twitter|//x)\.com") & ~x.href.rlike("intent/tweet|share")).alias("x"),
            last(lambda x: x.href.contains("youtube.com")).alias("youtube"),
            first("contact").alias("contact_page"),
            first("media.?kit|advertise|sponsor").alias("media_kit"),
        )

    return let(anchors(html, None), pick)


def upsert_counts(old: DataFrame, new: DataFrame, key: str = "contact_key") -> DataFrame:
    """One row: contacts of ``new`` that were created and that were there already, each key once."""
    d = new.select(key).distinct().join(old.select(key, F.lit(True).alias("_old")).distinct(), key, "left")
    return d.agg(F.count_if(F.col("_old").isNull()).alias("created"), F.count_if(F.col("_old").isNotNull()).alias("reused"))


def contact_key(email: Column, form_url: Column) -> Column:
    """The key of a contact: its address in lower case, or its form's URL."""
    return F.when(F.coalesce(email, F.lit("")) != "", F.concat(F.lit("email:"), F.lower(email))).when(F.coalesce(form_url, F.lit("")) != "", F.concat(F.lit("form:"), form_url))


def upsert_contacts(old: DataFrame, new: DataFrame, key: str = "contact_key") -> DataFrame:
    """Old and new contacts, one of each key: the more confident, the old one on a tie."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    row = F.struct(*old.columns)
    return both.groupBy(key).agg(F.min_by(row, F.struct((-F.col("confidence")).alias("c"), "_n")).alias("r")).select("r.*")


def best_contact_by_type(contacts: DataFrame, types: tuple[str, ...], site: str = "site") -> DataFrame:
    """Per site the first active contact by type priority, primary flag, confidence and recency."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in types]), F.col("contact_type")), F.lit(0)), F.lit(99))
    order = F.struct(rank.alias("r"), (~F.col("is_primary")).alias("p"), (-F.col("confidence")).alias("c"), (-F.unix_micros(F.col("seen_at").cast("timestamp"))).alias("t"))
    row = F.struct(*contacts.columns)
    return contacts.where("is_active and email is not null").groupBy(site).agg(F.min_by(row, order).alias("r")).select("r.*")


