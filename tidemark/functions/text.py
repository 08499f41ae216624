"""URLs, titles and headline lexicons, as column expressions; lexicons are parameters with defaults."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Parameters that only track visits, known hosts, and the words that name events, tones and impacts.
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "vero_conv", "vero_id", "oly_anon_id", "oly_enc_id", "ref_src")
TIERS = ("primary", "financial", "discovery", "unknown")
HOSTS = {
    "primary": ("idx.co.id", "bi.go.id"),
    "financial": ("reuters.com", "bloomberg.com", "cnbc.com", "ft.com", "wsj.com", "nikkei.com"),
    "discovery": ("news.google.com", "google.com"),
}
EVENTS = (
    ("earnings", ("earnings", "profit", "revenue", "net income", "quarterly result", "financial result", "laba", "pendapatan")),
    ("dividend", ("dividend", "dividen")),
    ("corporate_action", ("rights issue", "stock split", "share buyback", "buyback", "merger", "acquisition", "akuisisi", "ipo")),
    ("management", ("chief executive", " ceo ", "director", "direktur", "management", "manajemen")),
    ("regulatory", ("regulator", "regulation", "regulatory", "sanction", "probe", "investigation", "ojk", "peraturan")),
    ("monetary_policy", ("interest rate", "rate cut", "rate hike", "bank indonesia", "central bank", "suku bunga")),
    ("macro", ("inflation", "gdp", "trade balance", "unemployment", "inflasi", "rupiah")),
    ("analyst", ("upgrade", "downgrade", "price target", "rating")),
    ("operations", ("production", "shipment", "contract", "project", "operasi", "produksi")),
)
POSITIVE = ("beat", "beats", "growth", "grew", "rise", "rises", "surge", "record", "profit", "upgrade", "gain", "wins", "dividend", "buyback", "strong", "naik", "tumbuh", "laba")
NEGATIVE = ("miss", "falls", "fall", "drop", "decline", "loss", "downgrade", "default", "fraud", "probe", "sanction", "weak", "cut", "layoff", "turun", "rugi")
HIGH_IMPACT = ("bankruptcy", "default", "fraud", "merger", "acquisition", "rights issue", "earnings", "financial result", "rate cut", "rate hike", "sanction")
MEDIUM_IMPACT = ("dividend", "buyback", "contract", "project", "production", "management", "director", "upgrade", "downgrade", "inflation", "gdp")
HEADLINE_POSITIVE = r"(?i)\b(gain|growth|rise|rally|record|profit|upgrade|surge|strong|optimis|naik|untung)\b"
HEADLINE_NEGATIVE = r"(?i)\b(loss|fall|drop|risk|cut|weak|decline|slump|probe|lawsuit|turun|rugi)\b"

_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _normal(title: str | None) -> str | None:
    return None if title is None else " ".join(re.sub(r"\W+", " ", unicodedata.normalize("NFKC", title).casefold()).split()) or None


def normal_title(title: Column | str) -> Column:
    """NFKC, case-folded, everything but letters, digits and _ as single spaces; null where nothing is left.

    Spark has no NFKC and no case folding: this is the one Python function of these columns, in Arrow batches.
    """

    def whole(titles: pd.Series) -> pd.Series:
        return pd.Series([_normal(t) if isinstance(t, str) else None for t in titles], dtype="object")

    return F.pandas_udf(whole, StringType())(title)


def one_spaced(text: Column) -> Column:
    """Runs of white space as one space, ends trimmed; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column, tracking: Sequence[str] = TRACKING) -> Column:
    """An http(s) address without fragment, default port and tracking parameters, its other parameters sorted.

    Scheme and host are lower case; an empty path is '/'. Anything that is no such address is null.
    """
    u = F.trim(url)
    scheme, authority = F.lower(F.regexp_extract(u, _URL, 1)), F.regexp_extract(u, _URL, 2)
    user = F.regexp_extract(authority, r"^(.*@)", 1)
    place = F.regexp_replace(authority, r"^.*@", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(place, r":[^:\]]*$", ""), r"\.+$", ""))
    port = F.regexp_extract(place, r":([^:\]]*)$", 1)
    usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    decoded = lambda part: F.coalesce(F.try_url_decode(part), part)
    items = F.filter(F.split(F.regexp_extract(u, _URL, 4), "&"), lambda x: x != "")
    pairs = F.transform(items, lambda x: F.struct(decoded(F.regexp_extract(x, "(?s)^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(*tracking)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    path = F.regexp_extract(u, _URL, 3)
    whole = F.concat(
        scheme, F.lit("://"), user, host, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)),
        F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(scheme.isin("http", "https") & (host != "") & port.rlike(r"^\d{0,5}$"), whole)


def host_of(canonical: Column) -> Column:
    """The host of a canonical address, without user and port."""
    return F.nullif(F.lower(F.regexp_extract(canonical, r"^[a-z]+://(?:[^/?#]*@)?([^/?#:]*)", 1)), F.lit(""))


def in_domain(host: Column, domain: str) -> Column:
    d = domain.strip().lower().lstrip(".")
    return F.coalesce((host == d) | host.endswith("." + d), F.lit(False)) if d else F.lit(False)


def source_tier(explicit: Column, host: Column, issuer_domains: Sequence[str] = ()) -> Column:
    """The stated tier if it is one of ``TIERS``, else the first whose hosts hold ``host``, else unknown."""
    stated = F.lower(F.trim(explicit))
    out = F.when(stated.isin(*TIERS), stated)
    for tier, hosts in HOSTS.items():
        for domain in (*hosts, *(issuer_domains if tier == "primary" else ())):
            out = out.when(in_domain(host, domain), tier)
    return out.otherwise("unknown")


def folded(text: Column) -> Column:
    """Lower case, with the letters whose case folding is another: sharp s as ss, final sigma as sigma."""
    return F.replace(F.replace(F.lower(text), F.lit("\u00df"), F.lit("ss")), F.lit("\u03c2"), F.lit("\u03c3"))


def haystack(*texts: Column) -> Column:
    """Case-folded texts, padded by spaces, that keywords are looked for in."""
    return F.concat(F.lit(" "), folded(F.concat_ws(" ", *texts)), F.lit(" "))


def any_of(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur anywhere in the text, each counted once."""
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)))


def event_type(explicit: Column, text: Column, events=EVENTS) -> Column:
    """The stated type as a slug, else the first group with a keyword in the text, else other."""
    slug = F.regexp_replace(F.regexp_replace(folded(F.trim(explicit)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    out = F.when(F.trim(explicit) != "", F.when(slug == "", "other").otherwise(slug))
    for name, words in events:
        out = out.when(any_of(text, words), name)
    return out.otherwise("other")


def tone(text: Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    score = hits(text, positive) - hits(text, negative)
    return F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral")


def impact(text: Column, high: Sequence[str] = HIGH_IMPACT, medium: Sequence[str] = MEDIUM_IMPACT) -> Column:
    return F.when(any_of(text, high), "high").when(any_of(text, medium), "medium").otherwise("low")


def novelty(age_seconds: Column) -> Column:
    return F.when(age_seconds <= 24 * 3600, "high").when(age_seconds <= 72 * 3600, "medium").otherwise("low")


#: A symbol, in upper case, with or without the exchange's suffix.
TICKER = r"^[A-Z0-9]{1,6}(\.JK)?$"


def ticker(raw: Column) -> Column:
    """A symbol in upper case without the exchange suffix, or null."""
    u = F.upper(F.trim(raw))
    return F.when(u.rlike(TICKER), F.regexp_replace(u, r"\.JK$", ""))
