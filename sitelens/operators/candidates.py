"""Candidate operators: queries, splitting, first-wins de-duplication, upserts. Order comes from an explicit ``seq`` column."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lists import MULTITENANT, let
from ..functions.skew import HOT_ROWS, join_by_key
from ..functions.urls import with_site

#: Category terms and query templates.
JA_TERMS = {
    "gaming news": "ゲームニュース",
    "video game media": "ゲームメディア",
    "game reviews": "ゲームレビュー",
    "esports": "eスポーツ",
    "indie games": "インディーゲーム",
    "pc gaming": "PCゲーム",
    "console gaming": "コンソールゲーム",
    "mobile gaming": "モバイルゲーム",
}
JA_DEFAULT = "ゲームメディア"
TEMPLATES = {
    "non_jp_template": (
        "independent {category} publication {market}",
        "regional {category} news website {market}",
        "{category} editorial media {market}",
        "{category} review publication {market}",
        "{category} magazine {market}",
        "emerging {category} media outlet {market}",
        "local {category} news site {market}",
    ),
    "jp_en_template": (
        "Japanese {category} news websites",
        "Japanese {category} media",
        "Japanese {category} review publications",
        "Japan {category} news websites",
        "Japan independent {category} media",
    ),
    "jp_ja_template": (
        "日本の{category_ja}サイト",
        "日本の{category_ja}メディア",
        "日本の{category_ja}レビューサイト",
        "日本の{category_ja}ニュース",
        "日本のインディー{category_ja}メディア",
        "{category_ja}業界ニュース 日本",
        "{category_ja}雑誌 オンライン",
    ),
}


def clean_list(items: Column, most: int = 100) -> Column:
    """Trimmed, blanks dropped, case-insensitively distinct with the first spelling kept; null if an item is too long."""
    kept = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    first = F.filter(kept, lambda x, i: F.array_position(F.transform(kept, F.lower), F.lower(x)) == i + 1)
    return F.when(~F.exists(first, lambda x: F.length(x) > most), first)


def generate_queries(jobs: DataFrame) -> DataFrame:
    """(job_id, seq, query_text, category, template_name, page) from ``jobs`` (job_id, market, language, categories, keywords, maximum_queries).

    Templates are literals of the plan. Each row makes its own texts as an array, so only the rows of ``jobs`` are dealt out
    and sorted; texts are so for ids that several rows have, which make one job. Page 1 of every distinct text comes before page 2.
    """
    jp = (F.upper(F.trim("market")) == "JP") | (F.lower(F.trim("language")) == "ja")
    terms = F.create_map(*[F.lit(x) for kv in JA_TERMS.items() for x in kv])
    order = ("kind", "c", "t")

    def made(text: Column, category: Column, template: str, *place: Column) -> Column:
        text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
        return F.struct(F.lower(text).alias("k"), *[x.alias(n) for n, x in zip(order, place)], text.alias("text"), category.alias("category"), F.lit(template).alias("template"))

    def texts(names: Sequence[str], category: Column, c: Column) -> Column:
        ja = F.coalesce(F.try_element_at(terms, F.lower(F.trim(category))), F.lit(JA_DEFAULT))
        fill = lambda t: F.replace(F.replace(F.replace(F.lit(t), F.lit("{category}"), category), F.lit("{category_ja}"), ja), F.lit("{market}"), F.col("market"))
        each = [(f"{name}_{i}", t) for name in names for i, t in enumerate(TEMPLATES[name])]
        return F.array(*[made(fill(t), category, name, F.lit(0), c, F.lit(i)) for i, (name, t) in enumerate(each)])

    def own(name: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast("array<string>"))

    def firsts(every: Column) -> Column:
        """The first of each text but for case, in order, with its place and how many there are."""
        by_text = F.sort_array(F.filter(every, lambda x: F.length(x.text) <= 500))
        once = let(by_text, lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1).k != x.k, F.lit(True))))
        in_order = F.sort_array(F.transform(once, lambda x: F.struct(*[x[n].alias(n) for n in order], x.alias("q"))))
        return let(in_order, lambda s: F.transform(s, lambda x, i: F.struct((i + 1).alias("pos"), F.size(s).alias("total"), x.q.alias("q"))))

    by_category = F.flatten(F.transform(own("categories"), lambda x, c: F.when(jp, texts(["jp_en_template", "jp_ja_template"], x, c)).otherwise(texts(["non_jp_template"], x, c))))
    by_keyword = F.transform(own("keywords"), lambda x, t: made(x, F.lit("custom"), "keyword", F.lit(1), F.lit(0), t))
    job = Window.partitionBy("job_id")
    lean = jobs.select("job_id", "market", "language", "categories", "keywords", "maximum_queries").withColumn("same", F.count(F.lit(1)).over(job))

    def rows(these: Column) -> DataFrame:
        d = lean.where(these).select("job_id", "maximum_queries", F.explode(firsts(F.concat(by_category, by_keyword))).alias("x"))
        return d.select("job_id", "maximum_queries", "x.pos", "x.total", "x.q.*")

    several = rows(F.col("same") > 1).drop("pos", "total")
    several = several.withColumn("n", F.row_number().over(Window.partitionBy("job_id", "k").orderBy(*order, "text"))).where("n = 1").drop("n")
    several = several.withColumn("pos", F.row_number().over(job.orderBy(*order, "text"))).withColumn("total", F.count(F.lit(1)).over(job).cast("int"))
    d = rows(F.col("same") == 1).unionByName(several).withColumn("most", F.coalesce("maximum_queries", "total"))
    pages = F.sequence(F.lit(1), F.ceil(F.col("most") / F.col("total")).cast("int"))
    paged = d.where("most > 0").withColumn("page", F.explode(pages)).withColumn("seq", (F.col("page") - 1) * F.col("total") + F.col("pos"))
    return paged.where("seq <= most").select("job_id", F.col("seq").cast("long").alias("seq"), F.col("text").alias("query_text"), "category", F.col("template").alias("template_name"), "page")


def split_candidates(hits: DataFrame, multitenant: Sequence[str] = MULTITENANT, suffixes: Sequence[str] | None = None, extra_blocks: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of ``hits`` by URL rules and blocklist; both keep all columns. ``suffixes``: as ``suffix_size`` takes them."""
    d = with_site(hits, multitenant=multitenant, suffixes=suffixes, extra_blocks=extra_blocks)
    return d.where("reason is null").drop("reason"), d.where("reason is not null")


def dedup_candidates(accepted: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``accepted`` with ``kept`` and ``kept_url``: one row of each canonical_key is kept.

    The first by seq is kept, unless it is http and a later row with its query_text and position is https, which then
    replaces it. kept_url is the URL that was kept when the row arrived. Rows are aggregated by key, query_text and
    position, those by key, so a site with very many hits is reduced before it is dealt out; then rows are joined once,
    those of a site with more than ``hot_rows`` spread over parts.
    """
    row = F.struct("seq", "normalized_url")
    places = accepted.groupBy("canonical_key", "query_text", "position").agg(
        F.min_by(row, "seq").alias("f"), F.min_by(row, F.when(F.col("normalized_url").startswith("https:"), F.col("seq"))).alias("o"), F.count(F.lit(1)).alias("n")
    )
    sites = places.groupBy("canonical_key").agg(F.min_by(F.struct("f", "o"), "f.seq").alias("s"), F.sum("n").alias("__rows")).select("canonical_key", "__rows", "s.f", F.when(F.col("s.f.normalized_url").startswith("http:"), F.col("s.o")).alias("o"))
    d = join_by_key(accepted, sites, "canonical_key", "__rows", F.xxhash64("seq"), "inner", hot_rows)
    kept = F.col("seq") == F.coalesce("o.seq", "f.seq")
    at = F.when(F.col("o").isNotNull() & (F.col("seq") >= F.col("o.seq")), F.col("o.normalized_url")).otherwise(F.col("f.normalized_url"))
    return d.select(*accepted.columns, kept.alias("kept"), at.alias("kept_url"))


def candidate_counts(hits: DataFrame, multitenant: Sequence[str] = MULTITENANT, suffixes: Sequence[str] | None = None) -> DataFrame:
    """One row: accepted, rejected, duplicates."""
    d = with_site(hits, multitenant=multitenant, suffixes=suffixes)
    return d.agg(
        F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected"),
        (F.count_if(F.col("reason").isNull()) - F.count_distinct(F.when(F.col("reason").isNull(), F.col("canonical_key")))).alias("duplicates"),
    )


def skip_known(accepted: DataFrame, websites: DataFrame, new_only: bool = True) -> DataFrame:
    """Candidates whose site is not in ``websites`` yet; all of them unless ``new_only``."""
    return accepted.join(websites.select("canonical_key"), "canonical_key", "left_anti") if new_only else accepted


def dedup_across_queries(accepted: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``accepted`` with ``duplicate``: false for the first row of a key by (query_seq, seq). Keys of more than ``hot_rows`` rows are spread over parts."""
    order = F.struct("query_seq", "seq")
    first = accepted.groupBy("canonical_key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("__rows"))
    return join_by_key(accepted, first, "canonical_key", "__rows", F.xxhash64("seq"), "inner", hot_rows).select(*accepted.columns, (order != F.col("first")).alias("duplicate"))


def upsert_websites(websites: DataFrame, found: DataFrame) -> DataFrame:
    """``websites`` with new sites added; name, description and homepage_url of old ones filled only where empty."""
    fill = ("name", "description", "homepage_url")
    new = found.select("canonical_key", *[F.col(c).alias(f"new_{c}") for c in fill])
    filled = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"new_{c}")).alias(c) for c in fill]
    return websites.join(new, "canonical_key", "full_outer").select("canonical_key", *filled)


def insert_if_absent(target: DataFrame, new: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """``target`` and the rows of ``new`` whose keys it lacks, the first by ``order`` of each key. Null keys equal each other."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
    on = [first[k].eqNullSafe(target[k]) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return target.unionByName(first.join(target, cond, "left_anti").select(*target.columns))


def limit_with_skipped(df: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The first ``n`` rows by ``order``, each with the number of rows left out."""
    total = df.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("skipped"))
    return df.orderBy(order).limit(n).join(F.broadcast(total))


def resume_unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no stored result."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
