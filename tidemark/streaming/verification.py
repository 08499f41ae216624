"""Forecasts verified as data arrives: each waits in state for the checkpoint that settles it, or for its deadline.

A key is a pair and a symbol. What comes first waits: a forecast until its outcome is there or the watermark has passed its
deadline, an outcome as long, as one may overtake its forecast. It is one outer join of two streams, in the engine: no key
costs a call of Python. State holds what may still be met, as many rows as come in ``wait_seconds``, and loses them when the
watermark has passed them. A pair has a symbol once on either side. ``rocksdb`` sets what a session needs for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluation import settled

#: The state store, and that the newest row of either stream moves the watermark of both.
NEEDED = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.multipleWatermarkPolicy": "max",
}


def waiting(forecasts: DataFrame, outcomes: DataFrame, wait_seconds: int, late: str = "1 hour") -> DataFrame:
    """Forecasts (pair, symbol, forecast, baseline, target_return_pct, threshold_pct, at) beside their outcome's price.

    ``outcomes`` (pair, symbol, baseline, at) name the pair they settle. A forecast without one that was made within
    ``wait_seconds`` of it comes out when the watermark, ``late`` behind the newest ``at``, is that far past it. Both are
    streams; ``at`` is when a row was made.
    """
    times = lambda rows: rows.withColumns({c: F.col(c).cast("timestamp") for c in ("pair", "at")}).withWatermark("at", late)
    left, right = times(forecasts).alias("f"), times(outcomes).alias("o")
    wait = F.expr(f"interval {int(wait_seconds)} seconds")
    same = (F.col("f.pair") == F.col("o.pair")) & (F.col("f.symbol") == F.col("o.symbol"))
    near = (F.col("o.at") >= F.col("f.at") - wait) & (F.col("o.at") <= F.col("f.at") + wait)
    given = [F.col(f"f.{c}").alias(c) for c in ("pair", "symbol", "forecast", "baseline", "target_return_pct", "threshold_pct")]
    return left.join(right, same & near, "left").select(*given, F.col("o.baseline").alias("realized_price"), F.col("o.at").isNotNull().alias("found"))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[SparkSession]:
    """The session with what this needs, and as it was afterwards."""
    before = {name: spark.conf.get(name) for name in NEEDED}
    try:
        for name, value in NEEDED.items():
            spark.conf.set(name, value)
        yield spark
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def verdicts(joined: DataFrame) -> DataFrame:
    """What ``evaluation.settled`` says of forecasts beside their outcomes, as ``waiting`` has written them."""
    pair = F.col("pair").cast("timestamp_ntz").alias("pair")
    outcomes = joined.where("found").select(pair, "symbol", F.col("realized_price").alias("baseline"))
    return settled(joined.select(pair, "symbol", "forecast", "baseline", "target_return_pct", "threshold_pct"), outcomes)
