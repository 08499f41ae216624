"""Queries on articles: addresses, tiers, events, deduplication and roll-ups by layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import sentiment
from ..sources.feeds import feed_items, newest, page_titles, parsed_feeds, rss_items
from . import tables as T

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_URLS = """u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query FROM pages),
cu AS (SELECT page_id, host, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN qs = '' THEN '' ELSE '?' || qs END AS url
 FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda i: i <> '' AND NOT starts_with(lower(i), 'utm_') AND NOT list_contains([{names}], lower(split_part(i, '=', 1))))), '&') AS qs FROM u))""".replace("{names}", ", ".join(f"'{t}'" for t in X.TRACKING))


@query(f"WITH {_URLS} SELECT page_id, url AS canonical, host FROM cu")
def url_canonical(spark, d):
    c = X.canonical_url(F.col("url"))
    return T.table(spark, d, "pages").select("page_id", c.alias("canonical")).withColumn("host", X.host_of(F.col("canonical")))


_ENT = "trim(" + "replace(" * 6 + "regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1)" + "".join(f", '{e.replace(chr(39), chr(39) * 2)}', '{c.replace(chr(39), chr(39) * 2)}')" for e, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))) + ")"


@query(f"SELECT page_id, url, nullif({_ENT}, '') AS title FROM pages")
def page_title(spark, d):
    return page_titles(T.table(spark, d, "pages"))


@query(f"WITH {_URLS} SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'primary' WHEN host = 'example.com' OR host LIKE '%.example.com' THEN 'primary' ELSE 'unknown' END AS source_tier FROM cu")
def source_tier(spark, d):
    rows = T.articles(spark, d).withColumn("host", X.host_of(X.canonical_url(F.col("url"))))
    return rows.select(F.col("_ord").alias("page_id"), X.source_tier(F.col("source_tier"), F.col("host"), ["example.com"]).alias("source_tier"))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_SUM = "CASE WHEN page_id % 5 = 0 THEN 'record growth and profit' WHEN page_id % 5 = 1 THEN 'fraud probe' WHEN page_id % 5 = 2 THEN 'trade balance' END"
_HAY = f"hy AS (SELECT page_id, ' ' || replace(replace(lower(concat_ws(' ', nullif({_ENT}, ''), {_SUM})), '\u00df', 'ss'), '\u03c2', '\u03c3') || ' ' AS h FROM pages)"
_HIT = lambda words: f"len(list_filter({_list(words)}, lambda w: contains(h, w)))"
_TONE = f"CASE WHEN {_HIT(X.POSITIVE)} > {_HIT(X.NEGATIVE)} THEN 'positive' WHEN {_HIT(X.POSITIVE)} < {_HIT(X.NEGATIVE)} THEN 'negative' ELSE 'neutral' END"
_IMP = f"CASE WHEN {_HIT(X.HIGH_IMPACT)} > 0 THEN 'high' WHEN {_HIT(X.MEDIUM_IMPACT)} > 0 THEN 'medium' ELSE 'low' END"
_EVT = "CASE WHEN page_id % 20 = 1 THEN 'rate_hike_now' " + " ".join(f"WHEN {_HIT(w)} > 0 THEN '{n}'" for n, w in X.EVENTS) + " ELSE 'other' END"


@query(f"WITH {_HAY} SELECT page_id, {_EVT} AS event_type, {_TONE} AS tone, {_IMP} AS impact FROM hy")
def event_tone_impact(spark, d):
    h = X.haystack(F.col("title"), F.col("summary"), F.col("description"))
    return T.articles(spark, d).select(F.col("_ord").alias("page_id"), X.event_type(F.col("event_type"), h).alias("event_type"), X.tone(h).alias("tone"), X.impact(h).alias("impact"))


def _normal(spark, d):
    return sentiment.normalised(T.articles(spark, d), F.timestamp_seconds(F.lit(1704067200 + 200 * 3600)))


@query(f"WITH {_HAY}, {_URLS}, n AS (SELECT page_id, CASE WHEN 200 - page_id <= 24 THEN 'high' WHEN 200 - page_id <= 72 THEN 'medium' ELSE 'low' END AS novelty, {_TONE} AS tone, CASE WHEN page_id % 3 = 0 THEN 'Paper ' || (page_id % 9) ELSE host END AS publisher, url FROM hy JOIN cu USING (page_id) JOIN (SELECT page_id, {_ENT} AS title FROM pages) USING (page_id) WHERE page_id <= 200 AND regexp_matches(title, '[\\pL\\pN_]')) SELECT * FROM n")
def articles_eligible(spark, d):
    return _normal(spark, d).select(F.col("_ord").alias("page_id"), "novelty", "tone", "publisher", "url")


#: Titles as keys: other characters than letters, digits and _ as one space, in small letters (as good as folded, for these pages).
_KEYED = f"""{_HAY}, {_URLS}, ar AS (SELECT page_id, 'L' || (page_id % 4) AS layer, title, nullif(trim(lower(regexp_replace(title, '[^\\pL\\pN_]+', ' ', 'g'))), '') AS tk,
  CASE WHEN page_id % 3 = 0 THEN 'Paper ' || (page_id % 9) ELSE host END AS publisher, url, {_TONE} AS tone, {_IMP} AS impact, CASE WHEN 200 - page_id <= 24 THEN 'high' WHEN 200 - page_id <= 72 THEN 'medium' ELSE 'low' END AS novelty
  FROM hy JOIN cu USING (page_id) JOIN (SELECT page_id, {_ENT} AS title FROM pages) USING (page_id))"""


def walk_sql(rows: str) -> str:
    """CTE ``wk``: the walk over a table (layer, page_id, url, tk, publisher) of each layer in order, one article a step."""
    return f"""od AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY page_id) AS rn, tk || '|' || lower(publisher) AS tp FROM {rows} WHERE tk IS NOT NULL),
wk AS (
 SELECT DISTINCT layer, 0::BIGINT AS rn, false AS stays, []::VARCHAR[] AS urls, []::VARCHAR[] AS titles FROM od
 UNION ALL
 SELECT layer, rn, stays, CASE WHEN stays THEN list_append(urls, url) ELSE urls END, CASE WHEN stays THEN list_append(titles, tp) ELSE titles END
 FROM (SELECT od.layer, od.rn, od.url, od.tp, wk.urls, wk.titles, NOT list_contains(wk.urls, od.url) AND NOT list_contains(wk.titles, od.tp) AS stays FROM wk JOIN od ON od.layer = wk.layer AND od.rn = wk.rn + 1)),
kp AS (SELECT od.* FROM od JOIN wk USING (layer, rn) WHERE stays)"""


_GREEDY = f"""WITH RECURSIVE {_KEYED}, gr AS (SELECT * REPLACE (regexp_replace(url, '/\\d+', '', 'g') AS url) FROM ar), {walk_sql('gr')}"""


@query(f"{_GREEDY} SELECT layer, page_id AS _ord, url, title FROM kp")
def article_dedup_greedy(spark, d):
    """Whether a row stays depends on those kept before it."""
    return _greedy(spark, d).select("layer", "_ord", "url", "title")


def _greedy(spark, d):
    return sentiment.first_wins(sentiment.normalised(T.articles(spark, d).withColumn("url", F.regexp_replace("url", r"/\d+", "")), F.lit("2100-01-01").cast("timestamp")))


@query(f"{_GREEDY} SELECT layer, page_id AS _ord, row_number() OVER (PARTITION BY layer ORDER BY page_id DESC, tk DESC, publisher DESC) AS place FROM kp")
def articles_ranked(spark, d):
    """What is kept, in each layer the newest first."""
    return sentiment.ranked(_greedy(spark, d)).select("layer", "_ord", "place")


_TOP = lambda c: f"CASE max(CASE {c} WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"


def layers_sql(rows: str, names: str) -> str:
    """The roll-up of a table (layer, tone, impact, novelty) for each of ``names``, as ``sentiment.layers`` gives it."""
    n = lambda t: f"count(*) FILTER (tone = '{t}')"
    return f"""SELECT layer, coalesce(article_count, 0) AS article_count, positive, negative, neutral, tone, impact, novelty, CASE WHEN article_count IS NULL THEN 'unavailable' ELSE 'available' END AS status
FROM (VALUES {names}) v(layer) LEFT JOIN (SELECT layer, count(*) AS article_count, {n('positive')} AS positive, {n('negative')} AS negative, {n('neutral')} AS neutral,
 CASE WHEN {n('positive')} > {n('negative')} THEN 'positive' WHEN {n('positive')} < {n('negative')} THEN 'negative' ELSE 'neutral' END AS tone, {_TOP('impact')} AS impact, {_TOP('novelty')} AS novelty FROM {rows} GROUP BY layer) USING (layer)"""


@query(f"WITH RECURSIVE {_KEYED}, el AS (SELECT * FROM ar WHERE page_id <= 200), {walk_sql('el')} {layers_sql('kp', "('L0'), ('L1'), ('L2'), ('L3'), ('L4')")}")
def sentiment_layers(spark, d):
    kept = sentiment.first_wins(_normal(spark, d))
    return sentiment.layers(kept, ["L0", "L1", "L2", "L3", "L4"])


@query(f"""WITH {_HAY}, hd AS (SELECT page_id % 4 AS layer, sum(CASE WHEN regexp_matches(h, '{X.HEADLINE_POSITIVE}') THEN 1 WHEN regexp_matches(h, '{X.HEADLINE_NEGATIVE}') THEN -1 ELSE 0 END)::BIGINT AS score, count(*) AS observations FROM hy GROUP BY 1)
SELECT *, CASE WHEN score > 0 THEN 'positive' WHEN score < 0 THEN 'negative' ELSE 'neutral' END AS tone, CASE WHEN abs(score) >= 3 THEN 'directional' ELSE 'mixed' END AS regime, CASE WHEN observations >= 6 AND abs(score) >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM hd""")
def headline_tone(spark, d):
    rows = T.articles(spark, d).select((F.col("_ord") % 4).alias("layer"), X.haystack(F.col("title"), F.col("summary")).alias("title"))
    return sentiment.headline_layer(rows, ["layer"])


@query("SELECT page_id % 7 AS feed, 'Item ' || page_id || ' & more' AS title, 'https://news.example.org/' || page_id AS url FROM pages WHERE page_id % 3 <> 0")
def rss_feed_items(spark, d):
    """Feeds made of the pages' numbers, one feed for each page: the parser of items."""
    n = F.col("page_id").cast("string")
    link = F.concat(F.when(F.col("page_id") % 3 == 0, "http").otherwise("https"), F.lit("://news.example.org/"), n)
    xml = F.concat(F.lit("<rss><channel><title>x</title><item><title><![CDATA[Item "), n, F.lit(" &amp; more]]></title><link>"), link, F.lit("</link></item></channel></rss>"))
    return rss_items(T.table(spark, d, "pages").select((F.col("page_id") % 7).alias("feed"), xml.alias("xml"))).select("feed", "title", "url")


def _feeds(spark, d):
    """A feed of ten items for each ten pages, by their numbers: CDATA, entities, namespaces, links that don't count, and feeds that break off."""
    n = F.col("page_id")
    text = lambda v: v.cast("string")
    title = F.when(n % 2 == 0, F.concat(F.lit("<![CDATA[<b>Item "), text(n), F.lit(" & more]]>"))).otherwise(F.concat(F.lit("  Item&#32;"), text(n), F.lit(" &amp;\n more ")))
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + (n * 7919 % 5000) * 60), "dd MMM yyyy HH:mm:ss")
    item = F.concat(
        F.lit("<item><media:title>no</media:title><title>"), title, F.lit("</title><link>"), F.when(n % 7 == 0, "http").otherwise("https"), F.lit("://news.example.org/"), text(n), F.lit("</link>"),
        F.when(n % 3 == 0, F.concat(F.lit("<source url='x'>Paper "), text(n % 4), F.lit("</source>"))).otherwise(F.lit("")), F.lit("<pubDate>Mon, "), at, F.lit(" GMT</pubDate></item>"),
    )
    feeds = T.table(spark, d, "pages").select(F.floor(n / 10).alias("feed"), n.alias("n"), item.alias("item")).groupBy("feed").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("items"))
    head = F.lit("<rss xmlns:media='http://x/media' version='2.0'><channel><title>f</title>")
    body = F.array_join(F.transform("items", lambda i: i["item"]), "")
    tail = F.when(F.col("feed") % 4 == 3, "</channel>").otherwise("</channel></rss>")
    xml = F.when(F.col("feed") % 5 == 4, None).when(F.col("feed") % 9 == 8, F.concat(head, F.lit("</channel></rss>"))).otherwise(F.concat(head, body, tail))
    return feeds.select("feed", xml.alias("xml"))


_FEEDS = """pg AS (SELECT page_id AS n, page_id // 10 AS feed, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1 AS o FROM pages),
st AS (SELECT DISTINCT feed, CASE WHEN feed % 5 = 4 THEN 'missing' WHEN feed % 9 = 8 THEN 'empty' WHEN feed % 4 = 3 THEN 'broken' ELSE 'available' END AS status FROM pg),
fi AS (SELECT feed, o AS _ord, CASE WHEN n % 2 = 0 THEN '<b>Item ' ELSE 'Item ' END || n || ' & more' AS title, 'https://news.example.org/' || n AS url, CASE WHEN n % 3 = 0 THEN 'Paper ' || (n % 4) END AS publisher,
 to_timestamp(1704067200 + (n * 7919 % 5000) * 60)::TIMESTAMP AS published_at FROM pg JOIN st USING (feed) WHERE status = 'available' AND o < 8 AND n % 7 <> 0)"""


@query(f"WITH {_FEEDS} SELECT feed, status, CASE WHEN status = 'available' THEN (SELECT count(*) FROM pg WHERE pg.feed = st.feed) ELSE 0 END AS n FROM st")
def feed_status(spark, d):
    return parsed_feeds(_feeds(spark, d)).select("feed", "status", F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0)).cast("bigint").alias("n"))


@query(f"WITH {_FEEDS} SELECT feed, _ord, title, url, publisher, published_at FROM fi")
def feed_items_parsed(spark, d):
    """Feeds by the XML reader: the first eight items of each."""
    return feed_items(_feeds(spark, d)).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query(f"WITH {_FEEDS} SELECT feed, title, published_at FROM fi ORDER BY published_at DESC, feed, _ord LIMIT 6")
def feed_newest(spark, d):
    """The six newest items of all feeds."""
    return newest(feed_items(_feeds(spark, d))).select("feed", "title", F.col("published_at").cast("timestamp_ntz").alias("published_at"))
