"""Signals of pages by an element stack, for markup that regular expressions cannot settle.

``page_signals`` reads HTML by regular expressions in the JVM. They are right where tags are properly nested and no tag
stands in a comment, a script or a quoted value; ``settled`` tells such pages by their tags alone. All others go through
one vectorised step: a tokenizer feeds a stack of open elements, as tolerant parsers keep it. A start tag opens an
element inside the innermost open one, void elements close at once, an end tag closes the innermost element of its name
with all inside it, and one that closes nothing is passed over. What is still open at the end is closed there.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pages as P

#: Elements without content.
VOID = ("area", "base", "br", "col", "command", "embed", "frame", "hr", "img", "input", "keygen", "link", "meta", "param", "source", "track", "wbr")
#: Elements whose text or links are signals, in the order in which regular expressions look for them.
_READ = ("a", "button", "footer", "h1", "h2", "h3", "nav", "p", "span", "time", "title")
#: Nesting that ``settled`` follows; deeper pages are parsed.
_LEVELS = 16
_LD_BLOCK = r"(?is)<script\s+type\s*=\s*[\"']application/ld\+json[\"']\s*>[^<]*</script>"

_STRINGS = T.ArrayType(T.StringType())
_TEXTS = ("page_title", "meta_description", "og_title", "og_description", "og_site_name", "html_language", "canonical_url")
_LISTS = ("headings", "navigation_labels", "footer_text", "article_links", "author_links", "json_ld_types", "detected_publication_dates")
SIGNALS = T.StructType([*[T.StructField(n, T.StringType()) for n in _TEXTS], *[T.StructField(n, _STRINGS) for n in _LISTS]])


def settled(html: Column) -> Column:
    """True where regular expressions read the page as a parser would: no comments, scripts or styles (JSON-LD without tags aside), no
    unusual entities, no angle brackets in quoted values, all elements closed in order, none that is read inside one of its own name."""
    h = F.regexp_replace(html, _LD_BLOCK, "")
    odd = r"(?i)<!--|<!\[|<\?|</?(?:script|style|textarea|xmp|iframe|noembed|noframes|plaintext|template)\b|=\s*\"[^\"]*[<>]|=\s*'[^']*[<>]|<(?![a-zA-Z/!])|</(?![a-zA-Z])"
    entity = r"(?i)&(?!(?:lt|gt|quot|#39|nbsp|copy|middot|amp);)[a-z#]"
    names = F.filter(F.transform(F.regexp_extract_all(h, F.lit(r"<(/?[a-zA-Z][^\s/>]*)"), 1), F.lower), lambda n: ~n.isin(*VOID, *[f"/{v}" for v in VOID]))
    every = F.concat(F.array_join(names, ";"), F.lit(";"))
    left = F.when(F.size(names) == 0, "").otherwise(every)
    for _ in range(_LEVELS):
        left = F.regexp_replace(left, r"([^;/]+);/\1;", "")

    def one_by_one(name: str) -> Column:
        own = F.filter(names, lambda n: n.isin(name, f"/{name}"))
        return F.replace(F.array_join(own, ""), F.lit(f"{name}/{name}"), F.lit("")) == ""

    alone = F.lit(True)
    for name in _READ:
        alone = alone & one_by_one(name)
    return F.coalesce(~h.rlike(odd) & ~h.rlike(entity) & (left == "") & alone, F.lit(True))


def _clean(text: str | None, most: int = 500) -> str | None:
    return " ".join((text or "").split())[:most] or None


def _reader():
    """A parser class that collects a page's signals; made inside a task."""
    import re
    from html.parser import HTMLParser

    read, void = frozenset(_READ) | {"script", "style"}, frozenset(VOID)
    article, author = re.compile(P.ARTICLE), re.compile(P.AUTHOR)

    class Reader(HTMLParser):
        def __init__(self, limits: dict):
            super().__init__(convert_charrefs=True)
            self.limits = limits
            self.open: list[tuple[str, dict | None]] = []  # (name, record if it is read)
            self.depth: dict[str, int] = {}  # how many elements of a name are open
            self.texts: list[str] = []
            self.found: dict[str, list[dict]] = {}
            self.meta: list[dict] = []
            self.language = self.canonical = None
            self.count = 0

        def handle_starttag(self, tag, attrs):
            own = {k: v or "" for k, v in attrs}
            if tag == "html" and self.language is None:
                self.language = own.get("lang", "")
            elif tag == "link" and self.canonical is None and "canonical" in own.get("rel", "").split():
                self.canonical = own.get("href", "")
            elif tag == "meta":
                self.meta.append(own)
            if tag in void:
                return
            record = None
            if tag in read:
                self.count += 1
                record = {"order": self.count, "attrs": own, "at": len(self.texts), "to": None, "in": {n: len(self.found.get(n, ())) for n in ("a", "button", "p", "span")} if tag in ("nav", "footer") else None}
                self.found.setdefault(tag, []).append(record)
            self.open.append((tag, record))
            self.depth[tag] = self.depth.get(tag, 0) + 1

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            if tag not in void:
                self.handle_endtag(tag)

        def handle_endtag(self, tag):
            while self.depth.get(tag, 0):
                name, record = self.open.pop()
                self.depth[name] -= 1
                self._shut(record)
                if name == tag:
                    return

        def _shut(self, record):
            if record is not None:
                record["to"] = len(self.texts)
                if record["in"] is not None:
                    record["in"] = {n: (a, len(self.found.get(n, ()))) for n, a in record["in"].items()}

        def handle_data(self, data):
            inside, record = self.open[-1] if self.open else ("", None)
            if inside == "script":
                if record["attrs"].get("type", "").strip().lower() == "application/ld+json":
                    record.setdefault("data", []).append(data)
            elif inside != "style" and not (data.isspace() and self.texts and self.texts[-1].isspace()):
                self.texts.append(data)

        def finish(self):
            while self.open:
                self._shut(self.open.pop()[1])

        def text(self, record) -> str | None:
            """Clean text of an element, read until there is enough of it; of two pieces next to each other one is not blank."""
            size, upto = 0, record["at"]
            while upto < record["to"] and size < self.limits["text"]:
                size += len("".join(self.texts[upto].split()))
                upto += 1
            return _clean("".join(self.texts[record["at"] : upto]), self.limits["text"])

        def labels(self, around: str, names: tuple[str, ...], most: int | None) -> list[str]:
            """Distinct texts of the elements ``names`` inside elements ``around``, in their order."""
            out: dict[str, None] = {}
            for box in self.found.get(around, ()):
                inner = sorted((r for n in names for r in self.found.get(n, ())[slice(*box["in"][n])]), key=lambda r: r["order"])
                for r in inner[:most]:
                    if t := self.text(r):
                        out[t] = None
                if most is not None and len(out) >= most:
                    break
            return list(out)[:most]

        def signals(self) -> dict:
            limits, first = self.limits, {}
            for own in self.meta:
                for key in ((("name", "description"),) if own.get("name", "").lower() == "description" else ()) + ((("property", own["property"]),) if "property" in own else ()):
                    first.setdefault(key, own.get("content", ""))
            heads = sorted((r for n in ("h1", "h2", "h3") for r in self.found.get(n, ())), key=lambda r: r["order"])
            links = [r["attrs"] for r in self.found.get("a", ()) if "href" in r["attrs"]][: limits["anchors"]]
            times = [r["attrs"].get("datetime") or self.text(r) for r in self.found.get("time", ())[: limits["times"]]]
            times += [own["content"] for own in self.meta if own.get("property") in ("article:published_time", "article:modified_time") and own.get("content")]
            blocks = ["".join(r["data"]) for r in self.found.get("script", ()) if "data" in r]
            ld = P.read_jsonld([b for b in blocks[: limits["blocks"]] if b.strip() and (limits["block"] is None or len(b) <= limits["block"])])
            titles = self.found.get("title", ())
            return {
                "page_title": self.text(titles[0]) if titles else None,
                "meta_description": _clean(first.get(("name", "description"))),
                **{f"og_{k}": _clean(first.get(("property", f"og:{k}"))) for k in ("title", "description", "site_name")},
                "html_language": _clean(self.language),
                "canonical_url": _clean(self.canonical),
                "headings": list(dict.fromkeys(t for t in map(self.text, heads[: limits["headings"]]) if t)),
                "navigation_labels": self.labels("nav", ("a", "button"), limits["nav"]),
                "footer_text": self.labels("footer", ("a", "p", "span"), limits["footer"]),
                "article_links": sorted({a["href"] for a in links if article.search(a["href"])}),
                "author_links": sorted({a["href"] for a in links if author.search(a["href"]) or a.get("rel", "").split() == ["author"]}),
                "json_ld_types": ld["types"],
                "detected_publication_dates": sorted({*[t for t in times if t], *ld["dates"]}),
            }

    return Reader


def parse_pages(pages: DataFrame, html_col: str = "html", limits: P.Limits = P.LIMITS) -> DataFrame:
    """Signals of every page by the element stack, in the columns of ``page_signals``.

    Null and empty html give null and empty signals. Other columns are carried along. A page is read whole, or up to ``limits.chars`` characters; its memory follows its size.
    """
    kept = [c for c in pages.columns if c != html_col]
    html = F.coalesce(F.col(html_col), F.lit(""))
    src = pages.select(*kept, (html if limits.chars is None else F.substring(html, 1, limits.chars)).alias("__html"))
    schema = T.StructType([*src.drop("__html").schema.fields, *SIGNALS.fields])
    bounds = {"text": 500, "headings": limits.headings, "nav": limits.nav, "footer": limits.footer, "anchors": limits.anchors, "times": limits.times, "blocks": limits.jsonld_blocks, "block": limits.jsonld_chars}

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        make, kinds = _reader(), {f.name: to_arrow_type(f.dataType) for f in SIGNALS.fields}
        for batch in batches:
            rows = []
            for text in batch.column(len(kept)):
                reader = make(bounds)
                try:
                    reader.feed(text.as_py())
                    reader.close()
                except AssertionError:  # the tokenizer's way to give up; what stands before counts
                    pass
                reader.finish()
                rows.append(reader.signals())
            made = [pa.array([r[n] for r in rows], k) for n, k in kinds.items()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], *made], names=[*kept, *kinds])

    return P.with_flags(src.mapInArrow(run, schema))


def page_signals_exact(pages: DataFrame, html_col: str = "html", limits: P.Limits = P.LIMITS) -> DataFrame:
    """As ``page_signals``, right for any markup: settled pages stay in the JVM, the others are parsed. ``parsed`` tells which."""
    marked = pages.withColumn("parsed", ~settled(F.col(html_col)))
    return P.page_signals(marked.where(~F.col("parsed")), html_col, limits).unionByName(parse_pages(marked.where("parsed"), html_col, limits))
