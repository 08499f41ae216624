"""News feeds and web pages as tables: items out of RSS text, titles out of HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The entities of XML that feeds use.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def decoded(xml: Column) -> Column:
    """Text of an element: CDATA opened, entities decoded, ends trimmed."""
    out = F.regexp_replace(xml, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for entity, letter in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(letter))
    return F.trim(out)


def tag(xml: Column, name: str) -> Column:
    """The decoded text of the first element of a name, or null."""
    return F.nullif(decoded(F.regexp_extract(xml, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)), F.lit(""))


def rss_items(feeds: DataFrame, first: int = 8) -> DataFrame:
    """The first items of each feed (feed, xml) that have a title and an https link: a top-k of what a feed lists."""
    items = feeds.select("feed", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?is)<item(?:\s[^>]*)?>(.*?)</item>"), 1)).alias("_ord", "item")).where(F.col("_ord") < first)
    x = F.col("item")
    out = items.select("feed", F.col("_ord").cast("bigint").alias("_ord"), tag(x, "title").alias("title"), tag(x, "link").alias("url"), tag(x, "source").alias("publisher"), tag(x, "pubDate").alias("published"))
    return out.where(F.col("title").isNotNull() & F.col("url").startswith("https://"))


#: The column of broken records must be the last: Spark's reader misplaces the ones after it.
_FEED = "channel struct<title: string, item: array<struct<title: string, link: string, pubDate: string, source: struct<_VALUE: string, _url: string>>>>, broken string"
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "attributePrefix": "_", "valueTag": "_VALUE"}


def parsed_feeds(feeds: DataFrame) -> DataFrame:
    """feed, status, items: each feed (feed, xml) read by Spark's XML reader; status is available, empty, broken or missing.

    CDATA and entities are the reader's business; elements of other namespaces have other names. A feed that is no well-formed XML is broken as a whole: what
    could be read before its fault is not taken.
    """
    found = feeds.select("feed", F.col("xml").isNull().alias("gone"), F.from_xml("xml", _FEED, _OPTIONS).alias("x"))
    items = F.when(F.col("x.broken").isNull(), F.col("x.channel.item"))
    status = F.when(F.col("gone"), "missing").when(F.col("x").isNull() | F.col("x.broken").isNotNull() | F.col("x.channel").isNull(), "broken").when(F.coalesce(F.size("x.channel.item"), F.lit(0)) <= 0, "empty").otherwise("available")
    return found.select("feed", status.alias("status"), items.alias("items"))


def feed_items(feeds: DataFrame, first: int = 8) -> DataFrame:
    """The first items of each feed that have a title and an https link, with publisher and time; broken feeds have none.

    Times are those of mail, such as Mon, 01 Jan 2024 09:00:00 GMT or +0700; null where they can't be read.
    """
    each = parsed_feeds(feeds).where("status = 'available'").select("feed", F.posexplode(F.slice("items", 1, first)).alias("_ord", "i"))
    plain = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    said = F.regexp_replace(F.trim("i.pubDate"), r"^[A-Za-z]+,\s*", "")
    at = F.coalesce(*[F.try_to_timestamp(said, F.lit(f"d MMM yyyy HH:mm:ss {zone}")) for zone in ("z", "xx")])
    out = each.select("feed", F.col("_ord").cast("bigint").alias("_ord"), plain("i.title").alias("title"), plain("i.link").alias("url"), plain("i.source._VALUE").alias("publisher"), at.alias("published_at"))
    return out.where(F.col("title").isNotNull() & F.col("url").startswith("https://"))


def newest(items: DataFrame, most: int = 6) -> DataFrame:
    """The ``most`` newest items of all feeds, ties by feed and order; each task keeps so many of its own at most."""
    return items.where("published_at is not null").orderBy(F.desc("published_at"), "feed", "_ord").limit(most)


def page_titles(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", tag(F.col("html"), "title").alias("title"))
