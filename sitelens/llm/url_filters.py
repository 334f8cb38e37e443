"""URL filters by rules and by trust over the host graph, in DataFrame functions only.

Rules decide the urls they fit. For the rest, trust spreads from hosts whose pages rules allow along links (personalised
PageRank), and distrust from hosts whose pages rules block against the links' direction (who links to bad hosts is
suspect). Hosts without a page of their own, as most of a blocklist, are known by the urls that link to them. A host
whose distrust exceeds its trust is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut, discard, join_split, let, lower_ascii

DAMPING = 0.85
#: Relative width of the bounds on a host's rank at which iteration stops, and by which distrust must exceed trust.
TOLERANCE = 1e-9
LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?([a-z][a-z0-9+.-]*://[^"'\s>]+)"""


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` (allow or block) for ``pattern``: a host and its subdomains, and the beginning of the path from the first slash on."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, nulls if none does. The rules are literals of the plan, as long as the caller's list."""
    if not rules:
        return F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    found = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for r in sorted(rules, key=lambda r: (-len(r.pattern), r.pattern)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = found.when(fits, F.struct(F.lit(r.pattern).alias("rule"), F.lit(r.verdict).alias("verdict")))
    return found


def page_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, path): the distinct urls on other hosts that each page links to, by host and path. Pages that repeat count each."""
    target = lambda u: F.struct(host_of(u).alias("dst"), path_of(u).alias("path"))
    found = F.regexp_extract_all(F.coalesce(col(html_col), F.lit("")), F.lit(LINK), 1)
    links = pages.select(host_of(col(url_col)).alias("src"), F.explode(F.array_distinct(F.transform(found, target))).alias("u"))
    return links.select("src", "u.dst", "u.path").where("src <> '' and dst <> '' and src <> dst")


def seed_shares(urls: DataFrame, rules: Sequence[UrlRule]) -> DataFrame:
    """(host, n, a, b) of ``urls`` (host, path, n): how many there are, and the shares of them that rules allow and block."""
    ruled = urls.select("host", "n", matching_rule(F.col("host"), F.col("path"), rules).getField("verdict").alias("verdict")).where("host <> ''")
    share = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0)) / F.sum("n")
    return ruled.groupBy("host").agg(F.sum("n").alias("n"), share("allow").alias("a"), share("block").alias("b"))


def site_edges(hosts: DataFrame) -> DataFrame:
    """(src, dst, weight): a host and its nearest parent domain that is a host itself, both ways. Deep names are few labels long, so a host gives a handful of rows."""
    labels = F.split("host", r"\.")
    parents = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("parent"))
    known = hosts.select(F.col("host").alias("parent"))
    near = parents.where("parent <> '' and parent <> host").join(known, "parent").groupBy("host").agg(F.max_by("parent", F.length("parent")).alias("parent"))
    up = near.select(F.col("host").alias("src"), F.col("parent").alias("dst"), F.lit(1).alias("weight"))
    return up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from ``hosts`` (host, good, bad: seed masses that sum to 1 each) over ``edges`` (src, dst, weight).

    Both ranks move in one join a turn: trust from src to dst by src's out-weights, distrust from dst to src by dst's
    in-weights. What ends at a host without edges is lost. Tables are written between turns; joins shuffle plain tables, so hubs can be split.

    A rank is a sum of terms, a turn adds one. Turns go on until every host's rank is known to a relative ``tolerance``,
    so a chain of n links takes n turns at least. See ``_rest`` for the bounds.
    """
    out, into = (edges.groupBy(F.col(c).alias("h")).agg(F.sum("weight").alias("all")) for c in ("src", "dst"))
    trust = edges.join(cut(out, "out"), F.col("src") == F.col("h")).select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("weight") / F.col("all")).alias("t"), F.lit(0.0).alias("d"))
    doubt = edges.join(cut(into, "into"), F.col("dst") == F.col("h")).select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("weight") / F.col("all")).alias("d"))
    moves = cut(trust.unionByName(doubt).groupBy("from", "to").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "moves")
    if moves.isEmpty():
        return cut(hosts.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust")), "ranks")
    first = {"trust": F.col("good") * (1 - damping), "distrust": F.col("bad") * (1 - damping)}
    ranks = cut(hosts.select("host", *[x for r, seed in first.items() for x in (seed.alias(r), F.lit(0.0).alias(f"{r}0"), F.lit(0.0).alias(f"{r}1"), seed.alias(f"{r}2"))]), "ranks")
    while True:
        came = moves.join(ranks, F.col("from") == F.col("host")).groupBy("to").agg(*[F.sum(F.col(f"{r}2") * F.col(w)).alias(f"{r}_in") for r, w in (("trust", "t"), ("distrust", "d"))])
        term = lambda r: F.coalesce(F.col(f"{r}_in"), F.lit(0.0)) * damping
        step = lambda r: ((F.col(r) + term(r)).alias(r), F.col(f"{r}1").alias(f"{r}0"), F.col(f"{r}2").alias(f"{r}1"), term(r).alias(f"{r}2"))
        before = ranks
        ranks = cut(before.join(came, F.col("host") == F.col("to"), "left").select("host", *step("trust"), *step("distrust")), "ranks")
        discard(before)
        rest = _rest(ranks, list(first), damping, tolerance)
        if None not in rest.values():
            return ranks.select("host", *[(F.col(r) + (F.col(f"{r}1") + F.col(f"{r}2")) * more).alias(r) for r, more in rest.items()])


def _rest(ranks: DataFrame, names: Sequence[str], damping: float, tolerance: float) -> dict[str, float | None]:
    """What all later terms of each rank add, as a multiple of the last two; None while that is not known to ``tolerance``.

    A term is a fixed map, without negative weights, of the one before. So if no host's last term is above a times its
    term two turns ago, nor below b times, this holds for all later turns: what is left lies between b / (1 - b) and
    a / (1 - a) times the last two terms. Where terms keep coming to hosts that had none two turns ago (long chains,
    longer cycles), no host gets more than all hosts' last terms together still pass on, and once a turn reaches no new
    host none will.
    """
    made = []
    for r in names:
        all_, old, last, new = (F.col(f"{r}{k}") for k in ("", 0, 1, 2))
        made += [
            F.max(F.when(new > 0, F.when(old > 0, new / old).otherwise(F.lit(float("inf"))))).alias(f"{r}_a"),
            F.min(F.when(old > 0, new / old)).alias(f"{r}_b"),
            F.max(F.when(all_ > 0, (last + new) / all_)).alias(f"{r}_step"),
            F.sum(new).alias(f"{r}_mass"),
            F.min(F.when(all_ > 0, all_)).alias(f"{r}_least"),
            F.count_if((new > 0) & (new == all_)).alias(f"{r}_fresh"),
        ]
    seen, rest = ranks.agg(*made).first(), {}
    for r in names:
        a, b, step, mass, least, fresh = (seen[f"{r}_{k}"] for k in ("a", "b", "step", "mass", "least", "fresh"))
        rest[r] = None
        if a is None:  # the last term is empty, and so are all to come
            rest[r] = 0.0
        elif a < 1:
            low, high = b / (1 - b), a / (1 - a)
            if (high - low) * step <= tolerance:
                rest[r] = (low + high) / 2
        elif not fresh and mass * damping / (1 - damping) <= tolerance * least:
            rest[r] = 0.0
    return rest


def judge_urls(
    pages: DataFrame,
    rules: Sequence[UrlRule],
    url_col: str = "url",
    html_col: str = "html",
    threshold: float = 1.0,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """The ``carry`` columns (default: all) and host, path, rule, verdict, by ("rule" or "graph").

    The longest rule that fits decides; else the host's verdict: block if distrust > threshold * trust, else allow. A
    host is a seed by the shares of its pages that rules allow and block; a host without pages, by those of the links
    to it. A url that is null or lacks ``://`` has an empty host and path, fits no rule and is blocked, for no host
    vouches for it. Null html has no links. Repeated rows get equal verdicts; an empty table gives an empty one. Result
    columns replace input columns of the same names. Pages are joined with host verdicts by host, those of hot hosts in parts.
    """
    made = ("host", "path", "rule", "verdict", "by")
    keep = [c for c in (carry if carry is not None else pages.columns) if c.lower() not in made]
    host, path = host_of(col(url_col)), path_of(col(url_col))
    ruled = let(F.struct(host.alias("host"), path.alias("path")), lambda u: F.struct(u.host.alias("host"), u.path.alias("path"), matching_rule(u.host, u.path, rules).alias("r")))
    own = cut(seed_shares(pages.select(ruled.alias("u")).select("u.host", "u.path", F.lit(1).alias("n")), rules), "crawled")
    links = cut(page_links(pages, url_col, html_col).groupBy("src", "dst", "path").agg(F.count(F.lit(1)).alias("n")), "links")
    crawled = own.select(F.col("host").alias("dst"))
    uncrawled = seed_shares(links.join(crawled, "dst", "left_anti").select(F.col("dst").alias("host"), "path", "n"), rules)
    seeds = cut(own.unionByName(uncrawled.withColumn("n", F.lit(0).cast("long"))), "hosts")
    sums = seeds.agg(F.sum("a"), F.sum("b")).first()
    mass = lambda c, s: F.col(c) / F.lit(float(s)) if s else F.lit(0.0)
    hosts = seeds.select("host", mass("a", sums[0]).alias("good"), mass("b", sums[1]).alias("bad"))
    edges = cut(links.groupBy("src", "dst").agg(F.sum("n").alias("weight")).unionByName(site_edges(hosts)), "edges")
    # ranks are known to a relative tolerance, however small they are: equal ones must not block
    bad = F.col("distrust") > F.col("trust") * threshold * (1 + TOLERANCE)
    ranks = propagate(hosts, edges).select("host", F.when(bad, "block").otherwise("allow").alias("of_host"))
    verdicts = cut(ranks.join(seeds.select("host", "n").where("n > 0"), "host"), "verdicts")
    rows = pages.select(F.struct(*[col(c).alias(c) for c in keep]).alias("row"), ruled.alias("u"), F.xxhash64(col(url_col), F.octet_length(col(html_col))).alias("spread"))
    rows = rows.select("row", "u.host", "u.path", "u.r", "spread")
    both = join_split(rows, verdicts, "host", "n", F.col("spread"))
    return both.select(
        *[F.col("row").getField(c).alias(c) for c in keep],
        "host",
        "path",
        F.col("r").getField("rule").alias("rule"),
        F.coalesce(F.col("r").getField("verdict"), F.col("of_host"), F.lit("block")).alias("verdict"),
        F.when(F.col("r").getField("verdict").isNotNull(), "rule").otherwise("graph").alias("by"),
    )
