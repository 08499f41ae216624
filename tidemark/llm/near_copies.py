"""Links between texts whose sets of word shingles are alike, beyond the reach of a few SimHash bits.

1. Each distinct set of shingles is one node. ``BANDS`` hashes of ``ROWS`` MinHash values each name the buckets it is in.
   Two sets at a Jaccard similarity of 0.8 share a bucket with a probability of 0.998, at 0.85 of 0.9999.
2. Each bucket ties its nodes to the one that meets most others. What is tied together is a coarse group; its nodes are
   compared in one task by their whole sets, all with all, so no pair leaves the task but the links that join classes.
3. A coarse group too large for a task is first compared with its buckets' leaders. Then each of its buckets by itself
   compares what is in different classes by then; a bucket too large for a task is cut to tiles, of which only pairs
   with a text outside the bucket's largest class are compared.

No pair that shares a bucket is left out, and no link is decided by an estimate.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, rows_of
from .components import connected_components
from .wordhash import BY_SPACE, LOWERED, Words, mix, rolling

#: MinHash values are dealt to so many buckets, by so many values each.
BANDS, ROWS = 20, 6
_DRAW = np.random.default_rng(5)
_FLIP = _DRAW.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64)
_TIMES = _DRAW.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts hashed at once; texts, and shingles in all, that one comparison in a task takes.
SLICE, TILE, TILE_SHINGLES = 100, 1024, 1 << 19


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of lower-cased word shingles, ascending in each text; where each text with words ends; which these are."""
    words = Words(texts, BY_SPACE, LOWERED)
    at, h, _ = words.windows(shingle)
    n = np.diff(words.first_word)
    short = np.flatnonzero((n > 0) & (n < shingle))
    a, b = words.first_word[:-1][short], words.first_word[1:][short]
    text = np.concatenate([np.searchsorted(words.first_word, at, side="right") - 1, short])
    values = np.concatenate([h, mix(rolling(words.hash, a, b))])
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (values[1:] != values[:-1])
    full, sizes = np.unique(text[new], return_counts=True)
    return values[new], np.cumsum(sizes), full


def _buckets(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, BANDS) names of the buckets of each set of ``values`` from its start."""
    out = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        name = np.full(len(starts), band + 1, np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat(((values ^ _FLIP[i]) * _TIMES[i]) >> np.uint64(32), starts)
            name = mix(name * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, band] = name
    return out


def _by_slice(rows: DataFrame, make, schema: str, shingle: int) -> DataFrame:
    """``make(rows with words, hashes, ends)`` of each slice of ``rows``, whose columns hold ``text``."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                values, ends, full = shingle_sets(part.column("text"), shingle)
                yield make(part.take(pa.array(full)), values, ends)

    return rows.mapInArrow(run, schema)


def _digests(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set."""
    sets = np.split(values, ends[:-1]) if len(ends) else []
    return np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=8).digest() for s in sets), np.int64)


def _sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """(id, node, n, buckets): a 64-bit digest of each text's set, its size and its buckets. Texts without words have none."""

    def make(part, values, ends):
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.empty(0, np.int64)
        buckets = _buckets(values, starts).ravel().view(np.int64) if len(ends) else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1, dtype=np.int32) * BANDS), pa.array(buckets))
        node, n = pa.array(_digests(values, ends)), pa.array((ends - starts).astype(np.int64))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), node, n, lists], names=["id", "node", "n", "buckets"])

    return _by_slice(rows.select("doc_id", "text"), make, "id bigint, node bigint, n bigint, buckets array<bigint>", shingle)


def _with_sets(texts: DataFrame, asked: DataFrame, shingle: int) -> DataFrame:
    """``asked`` (doc_id, node and more bigint columns) with ``held``, the bytes of the node's shingle hashes."""
    names = [c for c in asked.columns if c != "doc_id"]

    def make(part, values, ends):
        sets = pa.array([s.tobytes() for s in np.split(values, ends[:-1])] if len(ends) else [], pa.binary())
        out = pa.RecordBatch.from_arrays([*(part.column(c) for c in names), sets], names=[*names, "held"])
        return out.filter(pa.array(_digests(values, ends) == part.column("node").to_numpy()))  # an id may have other texts

    schema = "".join(f"{c} bigint, " for c in names) + "held binary"
    return _by_slice(rows_of(texts, asked, "doc_id").select("text", *names), make, schema, shingle)


def joined_classes(sets: list[np.ndarray], classes: np.ndarray, probes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of places in ``sets`` at ``similarity`` or more that join all ``classes`` which such pairs with ``probes`` join.

    A probe's shingles meet the others' in an inverted index, which counts what each other set shares with it.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(value, kind="stable")
    posting = owner[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(value))])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, of = np.unique(classes, return_inverse=True)
    found = []
    for x in probes.tolist():
        if (of == of[x]).all():
            continue
        own = value[starts[x] : starts[x + 1]]
        low, count = first[own], first[own + 1] - first[own]
        places = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        both = np.bincount(posting[places], minlength=len(sets))
        alike = np.flatnonzero((both >= similarity * (sizes + sizes[x] - both)) & (of != of[x]))
        for y in alike.tolist():
            if of[y] != of[x]:
                found.append((x, y))
                of[of == of[y]] = of[x]
    return found


def _compared(held: DataFrame, key: str, similarity: float) -> DataFrame:
    """Links (a, b) within each ``team`` of ``held`` (key, team, node, root, probe, held), one group of ``key`` at a time."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("team", "ascending"), ("node", "ascending")])
        team, node, root, probe = (table[c].to_numpy() for c in ("team", "node", "root", "probe"))
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in table["held"]]
        cuts = [0, *(np.flatnonzero(team[1:] != team[:-1]) + 1), len(team)]
        links = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            found = joined_classes(sets[a:b], root[a:b], np.flatnonzero(probe[a:b]), similarity)
            links += [(node[a + x], node[a + y]) for x, y in found]
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return held.groupBy(key).applyInArrow(run, "a bigint, b bigint")


def _chunk(team, shingles: int):
    """A chunk of teams of about ``TILE_SHINGLES`` in all, of ``shingles`` altogether."""
    return F.pmod(F.xxhash64(team), F.lit(1 + shingles // TILE_SHINGLES))


def _total(df: DataFrame) -> int:
    return int(df.agg(F.sum("n")).first()[0] or 0)


def _large_groups(texts: DataFrame, met: DataFrame, similarity: float, shingle: int, tile: int) -> DataFrame:
    """Links of nodes of ``met`` (token, leader, doc_id, node, n), bucket by bucket; buckets may have any size."""
    one, many = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    salts = met.groupBy("leader").agg((1 + F.sum("n") / TILE_SHINGLES).cast("bigint").alias("salts"))
    led = met.where("node <> leader").select("leader", "doc_id", "node", "n").distinct().join(salts, "leader")
    led = led.select("doc_id", "node", "n", F.col("leader").alias("team"), F.pmod("node", "salts").alias("salt"), many.alias("probe"))
    heads = met.select("doc_id", "node", "n").distinct().join(led.select(F.col("team").alias("node"), "team", "salt").distinct(), "node")
    stars = led.unionByName(heads.withColumn("probe", one)).withColumn("root", F.col("node"))
    stars = checkpointed(stars.select("doc_id", "node", "n", "root", "probe", F.xxhash64("team", "salt").alias("team")))
    sets = _with_sets(texts, stars.withColumn("chunk", _chunk("team", _total(stars))).drop("n"), shingle)
    links = checkpointed(_compared(sets, "chunk", similarity))

    roots = checkpointed(connected_components(links))
    rooted = met.join(roots, met["node"] == roots["key"], "left").select("token", "doc_id", "node", "n", F.coalesce("root", "node").alias("root"))
    each = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    main = F.max_by(F.struct("c", "s", "root"), F.struct("c", "root"))
    mixed = each.groupBy("token").agg(main.alias("main"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    cut = lambda c, s: F.greatest(F.ceil(c / tile), F.ceil(s / TILE_SHINGLES)).cast("bigint")
    mixed = mixed.where("c > main.c").select(
        "token",
        F.col("main.root").alias("main"),
        cut(F.col("c"), F.col("s")).alias("ys"),
        F.greatest(cut(F.col("c") - F.col("main.c"), F.col("s") - F.col("main.s")), one).alias("xs"),
    )
    rooted = checkpointed(rooted.join(mixed, "token"))
    whole = rooted.where("ys = 1").select("doc_id", "node", "n", "root", one.alias("probe"), F.col("token").alias("team"))
    cells = lambda x, y, probe: ["doc_id", "node", "n", "root", probe.alias("probe"), F.xxhash64("token", x, y).alias("team")]
    other = F.explode(F.sequence(many, F.col("ys") - 1)).alias("y")
    probes = rooted.where("ys > 1 and root <> main").select("*", F.pmod(F.xxhash64("node"), "xs").alias("x"), other).select(*cells("x", "y", one))
    across = F.explode(F.sequence(many, F.col("xs") - 1)).alias("x")
    facing = rooted.where("ys > 1").select("*", F.pmod(F.xxhash64("node", F.lit(1)), "ys").alias("y"), across).select(*cells("x", "y", many))
    tiles = whole.unionByName(probes).unionByName(facing)
    tiles = checkpointed(tiles.groupBy("team", "doc_id", "node", "n", "root").agg(F.max("probe").alias("probe")))
    sets = _with_sets(texts, tiles.withColumn("chunk", _chunk("team", _total(tiles))).drop("n"), shingle)
    return links.union(checkpointed(_compared(sets, "chunk", similarity)))


def near_copy_links(rows: DataFrame, similarity: float = 0.8, shingle: int = 5, proposed: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Links (a, b) between ids of ``rows`` (doc_id, text) that join what all pairs at ``similarity`` in a bucket join.

    Every link has that Jaccard similarity of its texts' sets of shingles, or equal sets, told by 64-bit hashes. Pairs
    (a, b) of ids in ``proposed`` are compared too. Groups of up to ``tile`` texts are compared in one task. Repeated
    rows are one; null ids, null texts and texts without words have no links; an empty table gives none. An id with
    several texts is one node for each, and its links are those of all.
    """
    rows = rows.where("doc_id is not null")
    sketches = checkpointed(_sketches(rows, shingle))
    nodes = checkpointed(sketches.groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("buckets").alias("buckets")))
    same = sketches.select("id", "node").join(nodes.select("node", "least"), "node").where("id <> least")
    tokens = nodes.select("node", F.explode("buckets").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    met = checkpointed(tokens.join(often, "token"))
    score = met.groupBy("node").agg(F.sum("held").alias("score"))
    leaders = met.join(score, "node").groupBy("token").agg(F.max_by("node", F.struct("score", "node")).alias("leader"))
    met = checkpointed(met.join(leaders, "token").select("token", "node", "leader"))
    tied = met.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    if proposed is not None:
        a, b = (sketches.select(F.col("id").alias(c), F.col("node").alias(f"n{c}")) for c in "ab")
        met_so = checkpointed(proposed.join(a, "a").join(b, "b").where("na <> nb").select("na", "nb").distinct())
        tied = tied.union(met_so.select("na", "nb"))
        pair = F.xxhash64("na", "nb")
        met = met.union(met_so.select(pair, "na", "na")).union(met_so.select(pair, "nb", "na"))
    roots = connected_components(tied)
    grouped = checkpointed(nodes.select("node", "n", F.col("least").alias("doc_id")).join(roots, nodes["node"] == roots["key"]).drop("key"))
    sizes = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    large = checkpointed(sizes.where((F.col("c") > tile) | (F.col("s") > TILE_SHINGLES)).select("root"))
    one = F.lit(1).cast("bigint").alias("probe")
    small = grouped.join(large, "root", "left_anti").select("doc_id", "node", "n", F.col("root").alias("team"), F.col("node").alias("root"), one)
    sets = _with_sets(rows, small.withColumn("chunk", _chunk("team", _total(small))).drop("n"), shingle)
    links = checkpointed(_compared(sets, "chunk", similarity))
    if not large.isEmpty():
        inside = checkpointed(met.join(grouped.join(large, "root", "left_semi").drop("root"), "node").select("token", "leader", "doc_id", "node", "n"))
        links = links.union(_large_groups(rows, inside, similarity, shingle, tile))
    a, b = (nodes.select(F.col("node").alias(c), F.col("least").alias(f"i{c}")) for c in "ab")
    named = links.join(a, "a").join(b, "b").where("ia <> ib").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    return named.union(same.select(F.col("least").alias("a"), F.col("id").alias("b"))).distinct()
