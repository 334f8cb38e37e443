"""Host rules as tables: public suffixes and blocked hosts by their longest match, in a plan that does not grow with the lists.

Each distinct host gives a row for each of its endings, a ten or so; they meet the rules in one join by ending. Spark
broadcasts a list that is small by its measured size and shuffles both sides otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import join_by_key


def _endings(hosts: DataFrame) -> DataFrame:
    """(host, n, k, ending): the last k of a host's n labels."""
    labels = F.split("host", r"\.")
    d = hosts.where("host is not null").select("host", F.size(labels).alias("n")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return d.select("host", "n", "k", F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("k")).alias("ending"))


def suffix_labels(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, labels): labels of the public suffix of each of ``hosts`` (host: distinct, lower case); 0 if no rule fits.

    ``rules`` (rule) are written as public suffix lists write them: a suffix, ``*.`` for any label below one, ``!`` for an
    exception, which holds before all others; of the rest the longest holds. Blank rules and comments (``//``) are passed over.
    """
    own = rules.select(F.lower(F.trim("rule")).alias("rule")).where("rule <> '' and not startswith(rule, '//')").distinct()
    kind = F.when(F.col("rule").startswith("!"), -1).when(F.col("rule").startswith("*."), 1).otherwise(0)
    own = own.select(F.regexp_replace("rule", r"^(!|\*\.)", "").alias("ending"), kind.alias("kind"))
    hit = _endings(hosts).join(own, "ending").where("kind < 1 or n > k")
    best = hit.groupBy("host").agg(F.min(F.when(F.col("kind") == -1, F.col("k") - 1)).alias("exception"), F.max(F.col("k") + F.greatest("kind", F.lit(0))).alias("longest"))
    return hosts.select("host").join(best, "host", "left").select("host", F.coalesce("exception", "longest", F.lit(0)).alias("labels"))


def blocked_hosts(hosts: DataFrame, blocked: DataFrame) -> DataFrame:
    """(host, block_reason): the reason of the longest ending of each of ``hosts`` (host: distinct) that ``blocked`` (host, reason) holds, null if none. Of a host blocked twice the first reason by name holds."""
    own = blocked.groupBy(F.lower(F.trim("host")).alias("ending")).agg(F.min("reason").alias("reason"))
    hit = _endings(hosts).join(own, "ending").groupBy("host").agg(F.max_by("reason", "k").alias("block_reason"))
    return hosts.select("host").join(hit, "host", "left")


def by_host(rows: DataFrame, host: Column, judge, *names: str) -> DataFrame:
    """``rows`` with the columns ``names`` that ``judge`` gives to each distinct host; hosts of very many rows are spread over parts."""
    kept = rows.columns
    d = rows.withColumn("__host", F.lower(host))
    counts = d.where("__host is not null").groupBy(F.col("__host").alias("host")).agg(F.count(F.lit(1)).alias("__rows"))
    verdicts = judge(counts.select("host")).join(counts, "host").withColumnRenamed("host", "__of")
    spread = F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))])
    return join_by_key(d.withColumnRenamed("__host", "__of"), verdicts, "__of", "__rows", spread).select(*[F.col(f"`{c}`") for c in kept], *names)


def with_suffixes(rows: DataFrame, host: Column, rules: DataFrame) -> DataFrame:
    """``rows`` with ``suffix_labels`` and ``registered_domain`` of their host by a table of rules; null without a label before the suffix."""
    d = by_host(rows, host, lambda hosts: suffix_labels(hosts, rules), "labels").withColumnRenamed("labels", "suffix_labels")
    h, n = F.lower(host), F.col("suffix_labels")
    domain = F.when((n > 0) & (F.size(F.split(h, r"\.")) > n) & ~h.rlike(r"^\.|\.\."), F.call_function("substring_index", h, F.lit("."), -(n + 1)))
    return d.withColumn("registered_domain", domain)


def with_blocks(rows: DataFrame, host: Column, blocked: DataFrame) -> DataFrame:
    """``rows`` with ``block_reason`` of their host by a table of blocked hosts."""
    return by_host(rows, host, lambda hosts: blocked_hosts(hosts, blocked), "block_reason")
