"""Articles: eligibility, canonical form, first-wins deduplication and roll-ups by layer."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import text as T
from ..functions.values import age_seconds
from ..sources.shared import checkpointed, written
from .components import components


def normalised(articles: DataFrame, as_of, issuer_domains: Sequence[str] = ()) -> DataFrame:
    """Eligible articles in canonical form.

    Takes layer, _ord, title, url, publisher, published_at, fetched_at (timestamps), summary, description, source_tier,
    event_type. An article counts if it has a title, a publisher (or a host in its place) and both times, and was not
    published after ``as_of``.
    """
    rows = articles.withColumns({"url": T.canonical_url(F.col("url")), "normalized_title": T.normal_title("title")})
    host = T.host_of(F.col("url"))
    words = T.haystack(F.col("title"), F.col("summary"), F.col("description"))
    rows = rows.withColumns({"publisher": F.coalesce(T.one_spaced(F.col("publisher")), host), "title": T.one_spaced(F.col("title"))})
    rows = rows.where(F.col("normalized_title").isNotNull() & F.col("publisher").isNotNull() & F.col("fetched_at").isNotNull() & (F.col("published_at") <= as_of))
    return rows.select(
        "layer", "_ord", "title", "normalized_title", "publisher", T.normal_title("publisher").alias("normalized_publisher"), "url", "published_at", "fetched_at",
        T.source_tier(F.col("source_tier"), host, issuer_domains).alias("source_tier"), T.event_type(F.col("event_type"), words).alias("event_type"),
        T.tone(words).alias("tone"), T.impact(words).alias("impact"), T.novelty(age_seconds(F.col("published_at"), as_of)).alias("novelty"),
    )


def keys(articles: DataFrame) -> DataFrame:
    """layer, _ord and the two keys by which an article repeats another: its address, and its title with publisher."""
    return articles.select("layer", "_ord", F.xxhash64("url").alias("u"), F.col("url").isNotNull().alias("has_url"), F.xxhash64("normalized_title", F.coalesce("normalized_publisher", F.lit(""))).alias("t"))


#: Articles of a component that one task walks through.
WALKED = 50_000


def first_wins(articles: DataFrame, walked: int = WALKED, rounds: int = 1000, at_once: int = WALKED) -> DataFrame:
    """Articles of each layer that repeat neither key of one kept before them, in order of ``_ord``.

    A dropped article's keys do not count, so the outcome depends on the order, but only among articles that keys tie
    together, directly or through others. Equal pairs of keys are one row; rows whose keys nobody shares are kept at once.
    The rest falls into components, whose rows meet in one task: it walks through all of its components in order, row by row,
    with the keys of kept rows in two sets. Components of more than ``walked`` rows are settled by ``_in_rounds`` instead. Up
    to ``at_once`` tied rows in all are walked through as if they were one component.
    """
    k = keys(articles)
    firsts = k.groupBy("layer", "u", "has_url", "t").agg(F.min("_ord").alias("_ord"))
    url, title = F.xxhash64("layer", F.lit("u"), "u"), F.xxhash64("layer", F.lit("t"), "t")
    rows = checkpointed(firsts.select("layer", "_ord", F.when(F.col("has_url"), url).alias("u"), title.alias("t")))
    counted = rows.select(F.explode(F.array_compact(F.array("u", "t"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = checkpointed(counted.select("key", F.lit(True).alias("shared")))
    with_url = rows.join(shared.withColumnRenamed("key", "u").withColumnRenamed("shared", "u_shared"), "u", "left")
    told = checkpointed(with_url.join(shared.withColumnRenamed("key", "t").withColumnRenamed("shared", "t_shared"), "t", "left"))
    tied = F.coalesce("u_shared", "t_shared", F.lit(False))
    kept, rest = told.where(~tied).select("layer", "_ord"), told.where(tied).select("layer", "_ord", "u", "t")
    if rest.count() <= at_once:
        kept = kept.unionByName(_walked(rest.withColumn("root", F.lit(0))))
        return articles.join(checkpointed(kept), ["layer", "_ord"], "left_semi")
    of_key = components(rest.select(F.coalesce("u", "t").alias("a"), F.col("t").alias("b")))
    placed = rest.join(of_key.withColumnRenamed("key", "t"), "t")
    sizes = checkpointed(placed.groupBy("root").agg(F.count(F.lit(1)).alias("n")))
    placed = checkpointed(placed.join(sizes, "root"))
    kept = kept.unionByName(_walked(placed.where(F.col("n") <= walked)))
    large = placed.where(F.col("n") > walked)
    if not sizes.where(F.col("n") > walked).isEmpty():
        kept = kept.unionByName(_in_rounds(large, rounds))
    return articles.join(checkpointed(kept), ["layer", "_ord"], "left_semi")


def _walked(rows: DataFrame) -> DataFrame:
    """Of (layer, _ord, u, t, root) what is kept when each task walks through its components in order."""

    def walk(batches):
        urls, titles = set(), set()
        for batch in batches:
            u, t = batch.column("u").to_pylist(), batch.column("t").to_pylist()
            stays = []
            for a, b in zip(u, t, strict=True):
                stays.append(b not in titles and (a is None or a not in urls))
                if stays[-1]:
                    titles.add(b)
                    urls.add(a)
            yield batch.select(["layer", "_ord"]).filter(pa.array(stays, pa.bool_()))

    schema = T_.StructType([rows.schema["layer"], rows.schema["_ord"]])
    return rows.repartition("root").sortWithinPartitions("_ord").select("layer", "_ord", "u", "t").mapInArrow(walk, schema)


def _in_rounds(rows: DataFrame, rounds: int) -> DataFrame:
    """The same of components that are too large for one task: in each round whoever is first by both keys stays.

    An article that is the first of all that still hold its address, and of all that hold its title, is kept; those that
    share a key with a kept one go; the rest is looked at again. A round is a grouped minimum and joins by key, written to the
    shared folder; there are as many as the longest chain of articles that drop each other in turn.
    """
    left, kept = written(rows.select("layer", "_ord", F.explode(F.array_compact(F.array("u", "t"))).alias("k")), "articles"), None
    for _ in range(rounds):
        least = written(left.groupBy("k").agg(F.min("_ord").alias("least")), "articles")
        each = left.join(least, "k").groupBy("layer", "_ord").agg(F.bool_and(F.col("_ord") == F.col("least")).alias("wins"))
        now = written(each.where("wins").select("layer", "_ord"), "articles")
        kept = now if kept is None else kept.union(now)
        taken = written(left.join(now, ["layer", "_ord"], "left_semi").select("k").distinct(), "articles")
        gone = written(left.join(taken, "k", "left_semi").select("layer", "_ord").distinct(), "articles")
        left = written(left.join(gone, ["layer", "_ord"], "left_anti"), "articles")
        if left.isEmpty():
            return kept
    raise RuntimeError(f"articles are not settled after {rounds} rounds")


def ranked(articles: DataFrame) -> DataFrame:
    """``articles`` with ``place``: from 1 in each layer, the newest first, then by title and publisher, descending.

    Articles are sorted by ranges of that order, numbered within each range, and ranges carry on from the ones before, so a
    layer of any size is numbered without meeting in one task.
    """
    order = [F.col("layer"), F.desc("published_at"), F.desc("normalized_title"), F.desc("publisher"), F.col("_ord")]
    held = checkpointed(articles.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy("layer").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy("layer", "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("layer", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("layer", "_range").orderBy(*order[1:]))
    return held.withColumn("_in", inside).join(starts, ["layer", "_range"]).withColumn("place", F.col("_start") + F.col("_in")).drop("_in", "_start", "_range")


def _highest(column: str):
    rank = F.max(F.when(F.col(column) == "high", 2).when(F.col(column) == "medium", 1).otherwise(0))
    return F.when(rank == 2, "high").when(rank == 1, "medium").otherwise("low")


def _histogram(rows: DataFrame, column: str) -> DataFrame:
    counted = rows.groupBy("layer", column).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("layer").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias(f"{column}s"))


def layers(articles: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row for each layer named: counts by tone, the net tone, the highest impact and novelty; nulls for an empty layer."""
    n = lambda t: F.count_if(F.col("tone") == t)
    score = n("positive") - n("negative")
    found = articles.groupBy("layer").agg(
        F.count(F.lit(1)).alias("article_count"), n("positive").alias("positive"), n("negative").alias("negative"), n("neutral").alias("neutral"),
        F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral").alias("tone"), _highest("impact").alias("impact"), _highest("novelty").alias("novelty"),
    )
    every = articles.sparkSession.createDataFrame([(x,) for x in names], "layer string")
    out = every.join(found, "layer", "left")
    return out.withColumns({"status": F.when(F.col("article_count").isNull(), "unavailable").otherwise("available"), "article_count": F.coalesce("article_count", F.lit(0))})


def histograms(articles: DataFrame) -> DataFrame:
    """Each layer's events and source tiers as maps from name to count."""
    return _histogram(articles, "event_type").join(_histogram(articles, "source_tier"), "layer")


def headline_layer(titles: DataFrame, keys_: list[str]) -> DataFrame:
    """Tone of headlines: +1 or -1 for each by word lists, positive first; directional from 3, medium confidence from 6 headlines and 2."""
    score = F.sum(F.when(F.col("title").rlike(T.HEADLINE_POSITIVE), 1).when(F.col("title").rlike(T.HEADLINE_NEGATIVE), -1).otherwise(0))
    found = titles.groupBy(*keys_).agg(score.alias("score"), F.count(F.lit(1)).alias("observations"))
    s = F.col("score")
    return found.withColumns({
        "tone": F.when(s > 0, "positive").when(s < 0, "negative").otherwise("neutral"), "regime": F.when(F.abs(s) >= 3, "directional").otherwise("mixed"),
        "confidence": F.when((F.col("observations") >= 6) & (F.abs(s) >= 2), "medium").otherwise("low"),
    })


REPORT_LAYERS = ("company", "sector", "indonesia_market", "global")


def report(arrays: dict[str, DataFrame], as_of, issuer_domains: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(four layers with counts, tone, impact, novelty and histograms; the articles that count) of articles by source.

    ``arrays`` may hold company, sector, peer, indonesia_market and global, each with ``_ord``. Peers' articles follow
    the sector's in its layer. A layer without articles is unavailable.
    """
    if unknown := set(arrays) - {*REPORT_LAYERS, "peer"}:
        raise ValueError(f"unknown layers: {sorted(unknown)}")
    whole = None
    for name, rows in arrays.items():
        layer = "sector" if name == "peer" else name
        order = F.struct(F.lit(1 if name == "peer" else 0).alias("part"), F.col("_ord").alias("place"))
        part = rows.withColumns({"layer": F.lit(layer), "_ord": order})
        whole = part if whole is None else whole.unionByName(part)
    counted = first_wins(normalised(whole, as_of, issuer_domains))
    counted = checkpointed(counted)
    return layers(counted, REPORT_LAYERS).join(histograms(counted), "layer", "left"), counted
