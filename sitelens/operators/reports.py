"""Listings, job reports and counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.skew import join_by_key


def page_of(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """One page of ``df`` in order, each row with the number of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset((page - 1) * size).limit(size).join(F.broadcast(total))


def list_websites(sites: DataFrame, filters: dict[str, str], search: str | None, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """Sites that equal every filter and whose name or domain holds ``search`` in any case."""
    d = sites
    for c, v in filters.items():
        d = d.where(F.col(c) == v)
    if search:
        d = d.where(F.lower("name").contains(search.lower()) | F.lower("domain").contains(search.lower()))
    return page_of(d, order, page, size)


def review_decision(manual: Column, auto: Column) -> Column:
    """The manual decision if there is one, else the automatic status."""
    return F.when(manual.isin("approved", "rejected", "needs_review"), manual).when(auto.isin("verified", "rejected"), auto).otherwise("needs_review")


def latest_by(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; one aggregate."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def website_summary(sites: DataFrame, traffic: DataFrame, contacts: DataFrame, key: str) -> DataFrame:
    """``sites`` with their latest traffic and best contact, and, if they have both statuses, effective_review_decision."""
    d = sites.join(traffic, key, "left").join(contacts, key, "left")
    if {"manual_review_status", "current_verification_status"} <= set(d.columns):
        d = d.withColumn("effective_review_decision", review_decision(F.col("manual_review_status"), F.col("current_verification_status")))
    return d


def newest_rows(df: DataFrame, key: str, order: Sequence[Column], n: int = 20) -> DataFrame:
    """The first ``n`` rows of each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def _field(name: str):
    return lambda x: x[name]


def website_detail(sites: DataFrame, histories: dict[str, tuple[DataFrame, Sequence[Column], int]], key: str = "site", parts: int = 64) -> DataFrame:
    """``sites`` (``key``: distinct) with an array of rows for each of ``histories``, in order, each bounded.

    ``histories`` maps a name to (rows, order, most): the first ``most`` rows of a site by ``order``, numbers of which the
    lower comes first and null last; ties are broken by the row. All histories go through one ranking: first within
    parts of a site, dealt by the row's hash, then among the parts' first ones, so a site with very many rows is never in
    one task. A site without rows of a kind has an empty array; rows of other sites are left out.
    """
    names = list(histories)
    width = max((len(order) for _, order, _ in histories.values()), default=1)
    shapes = {name: rows.drop(key).schema for name, (rows, _, _) in histories.items()}
    every = None
    for i, (name, (rows, order, _)) in enumerate(histories.items()):
        by = [F.coalesce(o.cast("double"), F.lit(float("inf"))) for o in order] + [F.lit(0.0)] * (width - len(order))
        row = F.struct(*[F.col(f"`{f.name}`") for f in shapes[name].fields])
        own = [(row if n == name else F.lit(None).cast(shapes[n])).alias(f"row_{n}") for n in names]
        d = rows.select(F.col(key), F.lit(i).alias("kind"), F.struct(*[b.alias(f"o{j}") for j, b in enumerate(by)], F.xxhash64(row).alias("tie")).alias("o"), *own)
        every = d if every is None else every.unionByName(d)
    most = F.element_at(F.array(*[F.lit(n) for _, _, n in histories.values()]), F.col("kind") + 1)
    rank = F.row_number()
    some = every.withColumn("part", F.pmod(F.col("o.tie"), F.lit(parts)))
    some = some.withColumn("rank", rank.over(Window.partitionBy(key, "kind", "part").orderBy("o"))).where(F.col("rank") <= most)
    some = some.withColumn("rank", rank.over(Window.partitionBy(key, "kind").orderBy("o"))).where(F.col("rank") <= most)
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == i, F.struct("rank", f"row_{n}")))), _field(f"row_{n}")).alias(n) for i, n in enumerate(names)]
    return sites.join(some.groupBy(key).agg(*lists), key, "left").select(*sites.columns, *[F.coalesce(n, F.array().cast(T.ArrayType(shapes[n]))).alias(n) for n in names])


def contact_order(types: Sequence[str]) -> list[Column]:
    """Numbers by which contacts are ordered: place of their type, primary first, confidence, newest first."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in types]), F.col("contact_type")), F.lit(0)), F.lit(99))
    return [place, (~F.col("is_primary")).cast("int"), -F.coalesce("confidence", F.lit(0.0)), -F.unix_micros(F.col("discovered_at").cast("timestamp"))]


def website_histories(
    sites: DataFrame, verifications: DataFrame, traffic: DataFrame, sources: DataFrame, errors: DataFrame, contacts: DataFrame, contact_types: Sequence[str], most: int = 1000, most_errors: int = 20
) -> DataFrame:
    """Per site its verification_history (verified_at), traffic_history (retrieved_at), discovery_sources (discovered_at) and
    recent_processing_errors (created_at), newest first, and its contacts by type, primary flag, confidence and recency
    (contact_type, is_primary, confidence, discovered_at); ``most`` rows of each, ``most_errors`` of the errors."""
    newest = lambda c: [-F.unix_micros(F.col(c).cast("timestamp"))]
    return website_detail(
        sites,
        {
            "verification_history": (verifications, newest("verified_at"), most),
            "traffic_history": (traffic, newest("retrieved_at"), most),
            "contacts": (contacts, contact_order(contact_types), most),
            "discovery_sources": (sources, newest("discovered_at"), most),
            "recent_processing_errors": (errors, newest("created_at"), most_errors),
        },
    )


def _last_status(verifications: DataFrame) -> tuple[DataFrame, list[str]]:
    """(latest verification of each site, of each site and job if verifications name their job; its keys)."""
    keys = ["job_id", "site"] if "job_id" in verifications.columns else ["site"]
    row, order = F.struct("status", "attempt"), F.struct("attempt", "verified_at", "id")
    return verifications.groupBy(*keys).agg(F.max_by(row, order).alias("r")).select(*keys, "r.*"), keys


def job_results(
    jobs: DataFrame, sources: DataFrame, verifications: DataFrame, status: str | None = None, traffic: DataFrame | None = None, page: int | None = None, size: int = 50
) -> DataFrame:
    """(job_id, site, status, attempt, source_count, queries): the sites of each job with their latest verification.

    ``sources``: job_id, site, query; queries are distinct and sorted. ``verifications``: site, attempt, verified_at, id,
    status, and job_id if they belong to one. ``traffic`` (site, ...): latest traffic to join. ``page``: only that page in
    the order of job and site, each row with the number of all rows.
    """
    mine = sources.join(jobs.select("job_id").distinct(), "job_id", "left_semi").groupBy("job_id", "site").agg(F.count(F.lit(1)).alias("source_count"), F.sort_array(F.collect_set("query")).alias("queries"))
    last, keys = _last_status(verifications)
    if keys == ["site"]:  # a site may belong to very many jobs
        last = last.join(mine.groupBy("site").agg(F.count(F.lit(1)).alias("__jobs")), "site")
        d = join_by_key(mine, last, "site", "__jobs", F.xxhash64("job_id"))
    else:
        d = mine.join(last, keys, "left")
    d = d if traffic is None else d.join(traffic, "site", "left")
    d = d if status is None else d.where(F.col("status") == status)
    return d if page is None else page_of(d, [F.col("job_id"), F.col("site")], page, size)


def job_counters(
    sources: DataFrame, verifications: DataFrame, errors: DataFrame, queries: DataFrame | None = None, contacts: DataFrame | None = None, websites: DataFrame | None = None
) -> DataFrame:
    """Per job: distinct sites, sites by latest status, fetched sites, errors; queries and completed ones, contacts, and sites
    by qualification if ``queries`` (job_id, status), ``contacts`` (job_id, contact) and ``websites`` (site, qualification) are given."""
    last, keys = _last_status(verifications)
    sites = sources.select("job_id", "site").distinct().join(last, keys, "left")
    s = F.col("status")
    made = [F.count_if(s == x).alias(f"n_{x}") for x in ("verified", "rejected", "uncertain")] + [F.count_if(s.isNotNull() & (s != "fetch_failed")).alias("n_fetched")]
    if websites is not None:
        sites = sites.join(websites.select("site", "qualification"), "site", "left")
        made += [F.count_if(F.col("qualification") == x).alias(f"n_{x}") for x in ("qualified", "upcoming", "traffic_missing")]
    d = sites.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_sites"), *made)
    more = [errors.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_errors"))]
    if queries is not None:
        more.append(queries.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_queries"), F.count_if(s == "completed").alias("n_queries_completed")))
    if contacts is not None:
        more.append(contacts.groupBy("job_id").agg(F.count_distinct("contact").alias("n_contacts")))
    for x in more:
        d = d.join(x, "job_id", "left")
    return d.fillna(0, [c for c in d.columns if c.startswith("n_")])


def job_completeness(sources: DataFrame, verifications: DataFrame, errors: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Per job: sites with neither verification nor error, pending queries, errors, and the final status.

    ``verifications`` and ``errors`` are those of the job's attempt, the errors terminal ones. ``queries``: job_id, status.
    """
    sites = sources.select("job_id", "site").distinct()
    keys = ["job_id", "site"] if "job_id" in verifications.columns else ["site"]
    open_ = sites.join(verifications.select(*keys).distinct(), keys, "left_anti").join(errors.select("job_id", "site").distinct(), ["job_id", "site"], "left_anti")
    more = [open_.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_open")), errors.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_errors"))]
    if queries is not None:
        more.append(queries.groupBy("job_id").agg(F.count_if(F.col("status") == "pending").alias("n_pending")))
    d = sites.select("job_id").distinct()
    for x in more:
        d = d.join(x, "job_id", "left")
    d = d.fillna(0, [c for c in d.columns if c.startswith("n_")])
    waiting = (F.col("n_open") > 0) | (F.col("n_pending") > 0 if queries is not None else F.lit(False))
    return d.withColumn("final_status", F.when(waiting, "incomplete").when(F.col("n_errors") > 0, "completed_with_errors").otherwise("completed"))


def run_summary(queries: DataFrame) -> DataFrame:
    """Per job: queries in all, executed (completed or failed), failed, skipped (pending)."""
    s = F.col("status")
    return queries.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_queries"), F.count_if(s.isin("completed", "failed")).alias("executed"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "pending").alias("skipped")
    )


def apply_review(sites: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """``sites`` with manual_review_status overridden where a decision exists."""
    d = sites.join(decisions.select(key, F.col("decision")), key, "left")
    return d.withColumn("manual_review_status", F.coalesce("decision", "manual_review_status")).drop("decision")


def filter_results(df: DataFrame, status: str | None, text: str | None) -> DataFrame:
    if status:
        df = df.where(F.col("status") == status)
    return df.where(F.lower("domain").contains(text.lower()) | F.lower("name").contains(text.lower())) if text else df


def error_rows(errors: DataFrame, stage: str) -> DataFrame:
    """Error table rows: code cut to 255 and message to 2000 characters."""
    return errors.select("*", F.lit(stage).alias("stage"), F.substring("code", 1, 255).alias("error_code"), F.substring("message", 1, 2000).alias("error_message")).drop("code", "message")


def ranked_export(ranked: DataFrame) -> DataFrame:
    """Rank, Name, Website, Market, Category, Pageviews, Growth, Direction, Status and Notes; missing columns and values get a word for them."""
    has = set(ranked.columns)
    text = lambda c, empty: F.coalesce(F.col(c).cast("string"), F.lit(empty)) if c in has else F.lit(empty)
    named = {
        "Name": ("name", "Unknown"), "Website": ("website_url", ""), "Market": ("target_market", ""), "Category": ("category", ""), "Pageviews": ("pageviews_text", "N/A"),
        "Growth": ("growth_rate", "N/A"), "Direction": ("direction", ""), "Status": ("status", ""), "Notes": ("notes", ""),
    }
    return ranked.select(F.col("rank").alias("Rank"), *[text(c, empty).alias(n) for n, (c, empty) in named.items()])


def export_results(results: DataFrame, columns: Sequence[str], queries: str = "queries") -> DataFrame:
    """The columns of an export, list of queries joined by semicolons."""
    return results.select(*[F.array_join(c, "; ").alias(c) if c == queries else F.col(c) for c in columns])
