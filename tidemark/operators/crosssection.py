"""Strength across symbols between two checkpoints, against a benchmark, sectors and peers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import ratio


def aligned(observations: DataFrame) -> DataFrame:
    """Price and volume count only where they were observed exactly at the checkpoint's time."""
    exact = F.col("observed_at") == F.col("as_of")
    return observations.withColumns({"price": F.when(exact, F.col("price")), "volume": F.when(exact, F.col("volume"))})


def paired_returns(start: DataFrame, end: DataFrame) -> DataFrame:
    """symbol, ret and volume (of the end) for every symbol of either checkpoint (symbol, price, volume).

    The join is full: a symbol of one side only, or a start price that is not positive, has a null return.
    """
    a = start.select("symbol", F.col("price").alias("p0"))
    b = end.select("symbol", F.col("price").alias("p1"), "volume")
    return a.join(b, "symbol", "full_outer").select("symbol", (ratio(F.col("p1"), F.when(F.col("p0") > 0, F.col("p0"))) - 1).alias("ret"), "volume")


def with_sector(rows: DataFrame, sectors: DataFrame) -> DataFrame:
    """``rows`` with the symbol's sector; blank or missing sectors are null. The join is left to the optimiser's sizes."""
    mapped = sectors.select("symbol", F.nullif(F.trim("sector"), F.lit("")).alias("sector"))
    return rows.join(mapped, "symbol", "left")


def _breadth(ret: Column) -> list[Column]:
    up, down = F.count_if(ret > 0), F.count_if(ret < 0)
    return [up.alias("advancing"), down.alias("declining"), F.count_if(ret == 0).alias("unchanged"), F.count(ret).alias("available"), ratio(up - down, F.count(ret)).alias("breadth")]


def breadth(rows: DataFrame) -> DataFrame:
    """How many symbols rose, fell and stood, and the net share."""
    return rows.agg(*_breadth(F.col("ret")))


def sector_breadth(rows: DataFrame) -> DataFrame:
    """Breadth of each sector; sectors without any return stay, with nothing available."""
    return rows.where("sector is not null").groupBy("sector").agg(*_breadth(F.col("ret")))


def sector_returns(rows: DataFrame) -> DataFrame:
    """Mean return of each sector over its symbols that have one; sectors without any are left out."""
    return rows.where("sector is not null and ret is not null").groupBy("sector").agg(F.avg("ret").alias("sector_return"))


def volume_breadth(rows: DataFrame) -> DataFrame:
    """Volume under rising and falling symbols and its net share; null volume is 0, negative volume is left out."""
    v = F.greatest(F.coalesce("volume", F.lit(0.0)), F.lit(0.0))
    up, down = F.coalesce(F.sum(F.when(F.col("ret") > 0, v)), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("ret") < 0, v)), F.lit(0.0))
    return rows.agg(up.alias("advancing_volume"), down.alias("declining_volume")).withColumn("volume_breadth", ratio(F.col("advancing_volume") - F.col("declining_volume"), F.col("advancing_volume") + F.col("declining_volume")))


def benchmark_relative(rows: DataFrame, benchmark: str) -> DataFrame:
    """Each return less the benchmark's, which reaches every row as one scalar; null without a benchmark return."""
    one = rows.where(F.col("symbol") == benchmark).agg(F.max("ret").alias("benchmark_return"))
    return rows.crossJoin(F.broadcast(one)).withColumn("benchmark_relative", F.col("ret") - F.col("benchmark_return"))


def peer_relative(rows: DataFrame) -> DataFrame:
    """Each return less the mean of its sector's other symbols.

    The mean without oneself is the sector's sum and count without one's own: two numbers for each sector, joined back,
    instead of pairs of symbols, and no window that would hold a large sector in one task.
    """
    sums = rows.where("sector is not null").groupBy("sector").agg(F.sum("ret").alias("s"), F.count("ret").alias("n"))
    peers = ratio(F.col("s") - F.col("ret"), F.col("n") - 1)
    return rows.join(sums, "sector", "left").withColumn("peer_relative", F.col("ret") - peers).drop("s", "n")


def strength(start: DataFrame, end: DataFrame, benchmark: str, sectors: DataFrame, start_at: datetime | None = None, end_at: datetime | None = None) -> DataFrame:
    """One row per symbol: return, sector, and strength against benchmark, sector peers and sector mean.

    Where the checkpoints' times are given, the end must be later than the start.
    """
    if start_at is not None and end_at is not None and not end_at > start_at:
        raise ValueError("the end must be later than the start")
    rows = with_sector(paired_returns(start, end), sectors)
    both = peer_relative(benchmark_relative(rows, benchmark))
    return both.join(sector_returns(rows), "sector", "left")
