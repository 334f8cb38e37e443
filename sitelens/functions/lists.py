"""Fixed values and small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "gclid", "dclid", "fbclid", "msclkid", "mc_cid", "mc_eid",
)

#: Blocked hosts by reason, in order of priority at the same suffix.
BLOCKLIST = (
    ("blocked_social", ("facebook.com", "x.com", "twitter.com", "instagram.com", "linkedin.com", "tiktok.com")),
    ("blocked_video", ("youtube.com", "youtu.be", "twitch.tv", "vimeo.com")),
    ("blocked_forum", ("reddit.com", "discord.com", "discord.gg", "resetera.com")),
    ("blocked_search_engine", ("google.com", "bing.com", "yahoo.com", "search.brave.com")),
    ("blocked_marketplace", ("amazon.com", "ebay.com", "store.steampowered.com", "epicgames.com", "gog.com")),
    ("blocked_shortener", ("bit.ly", "t.co", "tinyurl.com")),
    ("blocked_domain", ("medium.com",)),
)

#: Public suffixes by a compact rule: one of these labels below a two-letter country, but for flat ones, is a suffix of two labels.
REGISTRY_LABELS = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "go", "mil", "ne", "net", "nom", "or", "org")
FLAT_COUNTRIES = ("be", "ch", "cz", "de", "dk", "eu", "fi", "li", "lu", "nl", "sk")
#: Names reserved for other use; no site is registered below them.
RESERVED = ("example", "internal", "invalid", "local", "localhost", "test")
#: Rules beside them, as public suffix lists write them: a suffix, ``*.`` for any label below one, ``!`` for what is none after all.
SUFFIXES = (
    "ad.jp", "ed.jp", "gr.jp", "lg.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.kobe.jp", "!city.kobe.jp", "*.nagoya.jp", "!city.nagoya.jp",
    "*.sapporo.jp", "!city.sapporo.jp", "*.yokohama.jp", "!city.yokohama.jp", "ltd.uk", "me.uk", "nhs.uk", "plc.uk", "police.uk", "*.sch.uk",
    "asn.au", "id.au", "gen.nz", "geek.nz", "govt.nz", "iwi.nz", "school.nz", "firm.in", "gen.in", "ind.in", "re.kr", "pe.kr", "idv.tw", "idv.hk",
    "law.za", "web.za", "web.id", "my.id", "sch.id", "blog.br", "art.br", "*.ck", "!www.ck", "*.bd", "*.np", "*.mm", "*.er", "*.fk", "*.kh", "*.pg",
)

MULTITENANT = ("substack.com", "wordpress.com", "blogspot.com")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def present(*items: Column) -> Column:
    """The non-null ``items`` as an array."""
    return F.array_compact(F.array(*items))


def clean_text(c: Column, most: int = 500) -> Column:
    """Whitespace runs as one space, trimmed, cut to ``most`` characters; empty becomes null."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), 1, most), F.lit(""))
