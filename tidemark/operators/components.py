"""Connected components of links between 64-bit keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(key, root) for every key of ``links`` (a, b); root is the smallest key that can be reached.

    Links point from their larger end u to the smaller one, v. In each round v gives way to v's own smallest neighbour, and
    then the smallest neighbour of each u takes the others over; both halve the paths to the root, so a chain of n links
    takes about log2(n) rounds. Smallest neighbours are written before they are joined: both sides of a join are plain
    exchanges then, and adaptive execution splits a key that very many links share. Links that have no smaller way to go
    leave the first join, as all links to a large component's root do. Links with a null end are left out.
    """
    ends = links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = written(ends.distinct(), "links")
    alone = edges.where("u = v").select(F.col("u").alias("key"), F.col("u").alias("root"))
    edges = edges.where("u <> v")
    for _ in range(rounds):
        least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "nearest")
        moves = edges.join(least.select(F.col("u").alias("v"), F.col("m").alias("to")), "v", "left")
        moves = moves.select("u", F.coalesce("to", "v").alias("v"), F.col("to").isNotNull().alias("changed"))
        moved = written(moves.groupBy("u", "v").agg(F.max("changed").alias("changed")), "links")
        near = written(moved.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "nearest")
        single = near.where("n = 1").select("u", F.col("m").alias("v"))
        several = moved.join(near.where("n > 1"), "u")
        if moved.where("changed").isEmpty() and near.where("n > 1").isEmpty():
            edges = single
            break
        taken = several.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        edges = written(single.unionByName(taken).distinct(), "links")
    else:
        raise RuntimeError(f"links are not settled after {rounds} rounds")
    named = edges.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("key"), F.col("v").alias("root"))).unionByName(alone)
    return named.groupBy("key").agg(F.min("root").alias("root"))
