"""Connected components of links between 64-bit keys, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, written


def _round(edges: DataFrame) -> DataFrame:
    """One round over (u, v) with u > v; ``changed`` says whether an edge was moved. No edge becomes more than one.

    First each edge's smaller end gives way to that one's own smallest neighbour, if it has a smaller one. Then of a key's
    smaller neighbours the smallest takes the others, so both together halve the paths to the smallest key.
    """
    least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    large = edges.join(least, edges["v"] == least["w"], "left")
    large = large.select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("changed"))
    beside = large.repartition("u")
    beside = beside.groupBy("u", "v").agg(F.max("changed").alias("changed"))
    near = beside.groupBy("u").agg(F.min("v").alias("m"))
    other = F.col("v") != F.col("m")
    return beside.join(near, "u").select(F.when(other, F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"), (F.col("changed") | other).alias("changed"))


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(key, root) for every key of ``links`` (a, b); root is the smallest key that can be reached.

    Rounds are written to the shared folder, and end when one moves no edge. Self-links only name a key; links with a null
    end are left out; without links there are no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null")
    edges = checkpointed(edges.distinct())
    loops = edges.where("u = v").select(F.col("u").alias("key"))
    edges = edges.where("u <> v")
    for _ in range(rounds):
        moved = written(_round(edges), "links")  # a checkpoint would hand on what is known of columns, which grows by the round
        edges = moved.select("u", "v")
        if moved.where("changed").isEmpty():
            break
    else:
        raise RuntimeError(f"links are not settled after {rounds} rounds")
    named = edges.select(F.col("u").alias("key"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("key"), F.col("v").alias("root"))
    return named.union(roots).union(loops.select("key", F.col("key").alias("root"))).groupBy("key").agg(F.min("root").alias("root"))
