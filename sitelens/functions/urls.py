"""Scalar operators over a URL column, in the JVM alone.

A URL is taken apart in steps, each a struct whose fields the next ones read many times: parts, ASCII host, size of its
public suffix. Columns bind each step as a lambda variable; ``with_site`` makes its fields columns with a generator,
which Catalyst doesn't inline, so that every step stands in the plan once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lists import BLOCKLIST, FLAT_COUNTRIES, MULTITENANT, REGISTRY_LABELS, RESERVED, SUFFIXES, TRACKING_PARAMS, let

MAX_URL, MAX_HOST, MAX_LABEL = 2000, 253, 63
_IPV4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"
_IPV6 = r"^\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\]$"
#: Characters that a compatibility normalisation turns into delimiters of a URL.
_FALSE_DELIMITERS = "[\u2047-\u2049\u2100\u2101\u2105\u2106\u2a74\ufe13\ufe16\ufe55\ufe56\ufe5f\ufe6b\uff03\uff0f\uff1a\uff1f\uff20]"


def idna(host: Column) -> Column:
    """Punycode of hosts with non-ASCII characters, null if there is none."""
    return F.when(host.rlike(r"[^\x00-\x7F]"), F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host, F.lit(1)))).otherwise(host)


def url_parts(url: Column) -> Column:
    """Struct of text (with a scheme), scheme, userinfo, host (lower-cased, without a last dot), port (with its colon), path, query."""
    return F.struct(*_parts(url))


def _parts(url: Column) -> list[Column]:
    text = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    full = F.when(text.rlike(r"(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    authority = F.regexp_extract(full, r"^[^:]*://([^/?#]*)", 1)
    hostport = F.regexp_replace(authority, r"^.*@", "")
    return [
        full.alias("text"),
        F.lower(F.regexp_extract(full, r"^([^:]*)://", 1)).alias("scheme"),
        F.when(authority.contains("@"), F.regexp_extract(authority, r"^(.*)@", 1)).otherwise("").alias("userinfo"),
        F.regexp_replace(F.lower(F.regexp_extract(hostport, r"^(\[[^\]]*\]|[^:]*)", 1)), r"\.$", "").alias("host"),
        F.regexp_extract(hostport, r"^(?:\[[^\]]*\]|[^:]*)(.*)$", 1).alias("port"),
        F.regexp_extract(full, r"^[^:]*://[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(full, r"^[^?#]*\?([^#]*)", 1).alias("query"),
    ]


def suffix_size(host: Column, suffixes: Sequence[str] | None = None) -> Column:
    """Labels of the public suffix of ``host``; 0 if it has none that is known.

    ``suffixes`` are rules as public suffix lists write them, in any number of labels; the longest that fits holds, and
    exceptions before all. None stands for the compact rules of ``lists``: any alphabetic last label that is not
    reserved, registry labels below countries, and SUFFIXES.
    """
    rules = SUFFIXES if suffixes is None else suffixes
    exact, wild, never = ({r.removeprefix(p) for r in rules if r.startswith(p) and (p or r[0] not in "*!")} for p in ("", "*.", "!"))
    tail = lambda k: F.substring_index(host, ".", -k)
    n = F.size(F.split(host, r"\."))
    depth = max([1, *(r.count(".") + 1 for r in (*exact, *never)), *(r.count(".") + 2 for r in wild)])
    size = F.when(F.lit(False), 0)
    for k in range(depth, 1, -1):
        if own := sorted(r for r in never if r.count(".") + 1 == k):
            size = size.when((n >= k) & tail(k).isin(*own), k - 1)
    for k in range(depth, 0, -1):
        fits = [tail(k).isin(*own)] if (own := sorted(r for r in exact if r.count(".") + 1 == k)) else []
        fits += [tail(k - 1).isin(*own)] if (own := sorted(r for r in wild if r.count(".") + 2 == k)) else []
        if suffixes is None and k == 2:
            fits.append(tail(2).rlike(rf"^({'|'.join(REGISTRY_LABELS)})\.(?!({'|'.join(FLAT_COUNTRIES)})$)[a-z]{{2}}$"))
        if suffixes is None and k == 1:
            fits.append(tail(1).rlike(rf"^(?!({'|'.join(RESERVED)})$)([a-z]{{2,}}|xn--[a-z0-9-]+)$"))
        for f in fits:
            size = size.when((n >= k) & f, k)
    return size.otherwise(0)


def _domain(host: Column, size: Column) -> Column:
    registered = (size > 0) & (F.size(F.split(host, r"\.")) > size) & ~host.rlike(r"^\.|\.\.")
    return F.when(registered, F.call_function("substring_index", host, F.lit("."), -(size + 1)))


def _below(host: Column, domain: Column) -> Column:
    return F.nullif(F.regexp_replace(F.substring(host, F.lit(1), F.length(host) - F.length(domain) - 1), r"^www(\.|$)", ""), F.lit(""))


def registered_domain(host: Column, suffixes: Sequence[str] | None = None) -> Column:
    """Public suffix and the label before it; null if there is no such label, or no suffix that is known."""
    return let(F.struct(host.alias("h"), suffix_size(host, suffixes).alias("n")), lambda x: _domain(x.h, x.n))


def subdomain(host: Column, suffixes: Sequence[str] | None = None) -> Column:
    """What stands before the registered domain, without a leading www; null if nothing does."""
    return let(F.struct(host.alias("h"), registered_domain(host, suffixes).alias("d")), lambda x: _below(x.h, x.d))


def _escaped(c: Column) -> Column:
    """Percent-encoded but for letters, digits and ``_.-~``; blanks as plus signs."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _unescaped(c: Column) -> Column:
    return F.try_url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))


def escaped_path(path: Column) -> Column:
    """``path`` percent-encoded; slashes and what is encoded already stay."""
    raw = F.replace(F.replace(_escaped(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.replace(raw, F.lit("%25"), F.lit("%"))


def strip_tracking_params(query: Column, params: Sequence[str] = TRACKING_PARAMS) -> Column:
    """``query`` without tracking parameters, decoded and encoded again; order and blank values are kept."""
    pair = lambda kv: F.struct(_unescaped(F.get(kv, F.lit(0))).alias("k"), _unescaped(F.coalesce(F.get(kv, F.lit(1)), F.lit(""))).alias("v"))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda kv: kv != ""), lambda kv: pair(F.split(kv, "=", 2)))
    kept = F.filter(pairs, lambda kv: ~F.lower(kv.k).isin(*params))
    return F.array_join(F.transform(kept, lambda kv: F.concat(_escaped(kv.k), F.lit("="), _escaped(kv.v))), "&")


def _raw(url: Column) -> Column:
    """The first step: parts, and the reason for which the bare text is rejected."""
    text = F.trim(url)
    schemed = text.rlike(r"(?i)^https?://")
    early = (
        F.when(F.coalesce(url, F.lit("")) == "", "invalid_url")
        .when(F.length(url) > MAX_URL, "url_too_long")
        .when(url.rlike(r"[\x00-\x1F]"), "invalid_url")
        .when(~schemed & text.startswith("//"), "invalid_url")
        .when(~schemed & text.contains("://"), "unsupported_scheme")
        .when(~schemed & (text.contains(" ") | (~text.contains("/") & ~text.contains("."))), "invalid_url")
    )
    return F.struct(early.alias("early"), *_parts(url))


def _host(raw: Column) -> Column:
    """The second step: the host as ASCII."""
    return F.struct(idna(raw.host).alias("ascii"))


def _suffix(h: Column, suffixes: Sequence[str] | None) -> Column:
    """The third step: labels of the host's public suffix."""
    return F.struct(suffix_size(h.ascii, suffixes).alias("labels"))


def _site(raw: Column, h: Column, s: Column) -> Column:
    """The fourth step: the registered domain, and the reason for which the URL is rejected."""
    p, host = raw, h.ascii
    number = F.regexp_extract(p.port, "^:([0-9]{1,5})$", 1)
    standard = number.isin("80", "080", "0080", "00080") & (p.scheme == "http") | number.isin("443", "0443", "00443") & (p.scheme == "https")
    bracket = p.host.rlike(r"[\[\]]") | p.port.rlike(r"[\[\]]")
    bad_port = (p.port != "") & (p.port != ":") & ((number == "") | (F.coalesce(number.try_cast("int"), F.lit(0)) > 65535))
    reason = (
        F.when(raw.early.isNotNull(), raw.early)
        .when(bad_port | (bracket & ~p.host.rlike(_IPV6)) | p.host.rlike(_FALSE_DELIMITERS), "invalid_url")
        .when(~p.userinfo.isin("", ":"), "embedded_credentials")
        .when(p.host == "", "missing_host")
        .when(F.length(p.host) > MAX_HOST, "host_too_long")
        .when(host.isNull() | host.rlike(rf"^\.|\.\.|\.$|[^.]{{{MAX_LABEL + 1},}}"), "invalid_hostname")
        .when(host == "localhost", "localhost")
        .when(host.rlike(_IPV4) | bracket, "raw_ip_not_allowed")
        .when((number != "") & ~standard, "unsupported_port")
        .when(_domain(host, s.labels).isNull(), "invalid_registered_domain")
    )
    return F.struct(reason.alias("reason"), _domain(host, s.labels).alias("domain"))


def _built(raw: Column, h: Column, d: Column) -> Column:
    """The last step: reason, and the parts of an accepted URL, null for others."""
    sub = _below(h.ascii, d.domain)
    host = F.concat_ws(".", sub, d.domain)
    path = F.when(raw.path == "", "/").otherwise(escaped_path(raw.path))
    query = strip_tracking_params(raw.query)
    ok = lambda c: F.when(d.reason.isNull(), c)
    return F.struct(
        d.reason.alias("reason"),
        ok(F.concat(raw.scheme, F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))).alias("normalized_url"),
        ok(F.concat(raw.scheme, F.lit("://"), host, F.lit("/"))).alias("homepage_url"),
        ok(d.domain).alias("registered_domain"),
        ok(sub).alias("subdomain"),
    )


def _through(url: Column, suffixes: Sequence[str] | None, last: Callable[[Column, Column, Column], Column]) -> Column:
    return let(_raw(url), lambda raw: let(_host(raw), lambda h: let(_suffix(h, suffixes), lambda s: let(_site(raw, h, s), lambda d: last(raw, h, d)))))


def url_reject_reason(url: Column, suffixes: Sequence[str] | None = None) -> Column:
    """Code of the first rule that rejects the URL, null if none does."""
    return _through(url, suffixes, lambda raw, h, d: d.reason)


def normalize_url(url: Column, suffixes: Sequence[str] | None = None) -> Column:
    """Struct (normalized_url, homepage_url, registered_domain, subdomain); null where the URL is rejected."""
    names = ("normalized_url", "homepage_url", "registered_domain", "subdomain")
    return let(_through(url, suffixes, _built), lambda x: F.when(x.reason.isNull(), F.struct(*[x.getField(n).alias(n) for n in names])))


def block_reason(host: Column, extra: Iterable[str] = ()) -> Column:
    """Reason of the longest blocked suffix of ``host``, null if none is; ``extra`` hosts count as blocked_domain."""
    reasons = F.create_map(*[F.lit(x) for reason, hosts in reversed([*BLOCKLIST, ("blocked_domain", tuple(extra))]) for h in hosts for x in (h, reason)])
    labels = F.split(F.lower(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.get(F.filter(F.transform(suffixes, lambda s: F.try_element_at(reasons, s)), lambda r: r.isNotNull()), F.lit(0))


def canonical_key(domain: Column, sub: Column, multitenant: Sequence[str] = MULTITENANT) -> Column:
    """The whole host on multi-tenant domains, else the registered domain."""
    return F.when(domain.isin(*multitenant), F.concat_ws(".", sub, domain)).otherwise(domain)


def clean_url(url: Column) -> Column:
    text = F.trim(F.coalesce(url, F.lit("")))
    return F.when((text == "") | (F.lower(text) == "nan"), "").when(text.rlike(r"(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text))


def absolute_url(base: Column, href: Column) -> Column:
    """``href`` resolved against ``base``; ``./`` and ``../`` at the beginning of a relative path are removed."""
    scheme, origin = F.regexp_extract(base, r"^([^:]+:)", 1), F.regexp_extract(base, r"^([^:]+://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_replace(path, r"[^/]*$", ""), F.lit("")), F.lit("/"))
    up = F.when(href.startswith("../"), F.coalesce(F.nullif(F.regexp_replace(folder, r"[^/]+/$", ""), F.lit("")), F.lit("/"))).otherwise(folder)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(origin, up, F.regexp_replace(href, r"^\.\.?/", "")))
    )


def unsafe_host(host: Column) -> Column:
    """True for the names of cloud metadata services, however they are spelt: case and a last dot don't count."""
    name = F.regexp_replace(F.lower(F.regexp_replace(host, r"(?U)^\s+|\s+$", "")), r"\.$", "")
    return name.isin("metadata.google.internal", "169.254.169.254", "metadata.azure.com", "instance-data")


def canonical_variants(url: Column) -> Column:
    """Up to three addresses to try for a page: itself, the host with and without www, plain http (https for an http one)."""
    bare, www = F.regexp_replace(url, r"^(https?)://www\.", "$1://"), F.regexp_replace(url, r"^(https?)://(?!www\.)", "$1://www.")
    toggled = F.when(url.rlike(r"^https?://www\."), bare).otherwise(www)
    http, https = F.regexp_replace(url, "^https:", "http:"), F.regexp_replace(url, "^http:", "https:")
    return F.slice(F.array_distinct(F.when(url.startswith("https:"), F.array(url, toggled, http)).otherwise(F.array(url, https))), 1, 3)


class _Columns:
    """Fields of the steps as columns of a DataFrame."""

    @staticmethod
    def name(field: str) -> str:
        return f"__site_{field}"

    def __getattr__(self, field: str) -> Column:
        return F.col(self.name(field))


def with_site(
    df: DataFrame, url_col: str = "url", multitenant: Sequence[str] = MULTITENANT, extra_blocks: Iterable[str] = (), suffixes: Sequence[str] | None = None
) -> DataFrame:
    """``df`` with reason (null: accepted), the parts of ``normalize_url``, and canonical_key. Blocked hosts keep their parts."""
    x = _Columns()
    d = df.select(*[F.col(f"`{c}`") for c in df.columns])
    kept = d.columns
    for step in (_raw(F.col(url_col)), _host(x), _suffix(x, suffixes), _site(x, x, x), F.struct(_built(x, x, x).alias("built"))):
        fields = d.select(step.alias("s")).schema["s"].dataType.names
        d = d.select("*", F.inline(F.array(step)).alias(*[_Columns.name(f) for f in fields]))
    n = x.built
    blocked = F.when(n.reason.isNull(), block_reason(F.concat_ws(".", n.subdomain, n.registered_domain), extra_blocks))
    parts = [n.getField(c).alias(c) for c in ("normalized_url", "homepage_url", "registered_domain", "subdomain")]
    return d.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(n.reason, blocked).alias("reason"), *parts, canonical_key(n.registered_domain, n.subdomain, multitenant).alias("canonical_key"))
