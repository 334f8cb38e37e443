"""RSS and Atom feeds: entries of feed documents that stand in a text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import clean_text

_ITEM = "array<struct<title:string,link:string,guid:string,pubDate:string,`dc:date`:string,description:string>>"
_ENTRY = "array<struct<title:string,link:array<struct<_href:string,_rel:string>>,published:string,updated:string,summary:string>>"
#: RSS has its items in the channel, RSS 1.0 beside it; Atom has entries.
_FEED = f"channel struct<item:{_ITEM}>, item {_ITEM}, entry {_ENTRY}"
#: Patterns of dates, once the day's name is gone and the zone is an offset.
_DATES = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd")


def feed_date(text: Column) -> Column:
    """A feed's date as a timestamp; null if it is none."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    bare = F.regexp_replace(bare, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(p)) for p in _DATES])


def feed_entries(feeds: DataFrame, body_col: str = "body", keep: Sequence[str] = ("site",)) -> DataFrame:
    """(``keep``..., entry_seq, title, link, published, summary): a row an entry, in the feed's order.

    RSS 0.9x, 1.0 and 2.0 and Atom are read in the JVM. An Atom entry's link is its first without a relation or with
    ``alternate``; an RSS item's is its link, else its guid if that is an address. Titles and summaries are cleaned, blank
    ones null. Null bodies, other documents and broken XML have no entries; entities that a document defines itself
    aren't followed. Feeds are read whole.
    """
    f = F.from_xml(F.col(body_col), _FEED, {"mode": "PERMISSIVE"})
    words = lambda c: clean_text(F.regexp_replace(c, r"<[^>]*>", ""))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))

    def item(x: Column) -> Column:
        guid = F.when(x["guid"].rlike(r"^\s*https?://"), x["guid"])
        return F.struct(words(x["title"]).alias("title"), F.coalesce(blank(x["link"]), blank(guid)).alias("link"), feed_date(F.coalesce(x["pubDate"], x["dc:date"])).alias("published"), words(x["description"]).alias("summary"))

    def entry(x: Column) -> Column:
        first = F.get(F.filter(x["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))
        return F.struct(words(x["title"]).alias("title"), blank(first["_href"]).alias("link"), feed_date(F.coalesce(x["published"], x["updated"])).alias("published"), words(x["summary"]).alias("summary"))

    none = F.array().cast("array<struct<title:string,link:string,published:timestamp,summary:string>>")
    d = feeds.select(*keep, f.alias("f"))
    lists = F.coalesce(F.transform("f.channel.item", item), none), F.coalesce(F.transform("f.item", item), none), F.coalesce(F.transform("f.entry", entry), none)
    each = d.select(*keep, F.posexplode(F.concat(*lists)).alias("entry_seq", "e"))
    return each.select(*keep, "entry_seq", "e.*")


def is_valid_entry() -> Column:
    """An entry counts as evidence if it has a title and a link."""
    return F.col("title").isNotNull() & F.col("link").isNotNull()
