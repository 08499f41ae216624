"""Train sets of all folds as mergeable states, without a row of a row for each fold that trains on it.

Boundaries are evenly spaced, so the folds that train on a row are a range: from the first boundary that lies behind both its
time (with the purge) and the end of its horizon, up to the last whose train span still reaches back to it. A row adds its
counts and sums to the state of the first fold of its range, and takes them away at the fold after its last; a fold's state is
the sum of all steps up to it. What isn't finite is counted beside a sum, not added to it, so that it can leave again. So each row is summed twice at most, whatever the number of folds, in one grouped aggregate
whose result has a row for each step; states of parts of the rows, or of later rows, merge by adding them up.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import CLASSES, finite, likeliest, ratio
from . import models
from .folds import FoldPlan, horizon_end


_UP, _DOWN = "_up", "_down"


def _whole(name: str, columns: list[str]) -> Column:
    """A sum with what isn't finite in it: infinite, or NaN."""
    if name + _UP not in columns:
        return F.col(name)
    up, down = F.col(name + _UP) > 0, F.col(name + _DOWN) > 0
    return F.when(up & down, float("nan")).when(up, float("inf")).when(down, float("-inf")).otherwise(F.col(name))


def _ranges(rows: DataFrame, plan: FoldPlan, count: int) -> DataFrame:
    """``rows`` with _candidate (the first fold with the row before its boundary), _enter (and settled), and _leave."""
    step = int((plan.step_seconds or plan.test_seconds) * 1e6)
    start = F.unix_micros(F.lit(plan.train_end).cast("timestamp_ntz").cast("timestamp"))
    since = lambda c: F.unix_micros(c.cast("timestamp")) - start
    first = lambda c: F.greatest(c, F.lit(0).cast("bigint"))
    out = rows.where("as_of is not null").withColumns({"_at": since(F.col("as_of")), "_end": since(horizon_end(rows))})
    candidate = first(F.floor((F.col("_at") + int(plan.purge_seconds * 1e6)) / step) + 1)
    leave = F.lit(count) if plan.train_seconds is None else F.floor((F.col("_at") + int(plan.train_seconds * 1e6)) / step) + 1
    out = out.withColumns({"_candidate": candidate, "_leave": F.least(leave, F.lit(count)), "_settled": first(F.ceil(F.col("_end") / step))})
    return out.withColumn("_enter", F.greatest("_candidate", "_settled")).where("_candidate < _leave").drop("_at", "_end", "_settled")


def steps(rows: DataFrame, plan: FoldPlan, latest: datetime | None, names: list[str] | None = None, target: str | None = None, known: models.Known = finite) -> DataFrame:
    """What changes from each fold's train set to the next one's: fold, counts, sums and the last row that enters."""
    names, count = names or [], len(plan.boundaries(latest))
    held = _ranges(rows, plan, count)
    inside = F.col("_enter") < F.col("_leave")
    event = lambda when, fold, kept, purged: F.when(when, F.struct(fold.cast("int").alias("fold"), F.lit(kept).alias("kept"), F.lit(purged).alias("purged")))
    late = F.col("_enter") > F.col("_candidate")
    settled = F.least("_enter", "_leave")
    events = F.array_compact(F.array(
        event(inside, F.col("_enter"), 1, 0), event(inside & (F.col("_leave") < count), F.col("_leave"), -1, 0),
        event(late, F.col("_candidate"), 0, 1), event(late & (settled < count), settled, 0, -1),
    ))
    fits = models.vector(names, known).isNotNull() if names else F.lit(True)
    known, fits = fits, fits & known(F.col(target)).isNotNull() if target else F.lit(False)
    kept = [F.col(n).alias(f"_x{i}") for i, n in enumerate(names)] + [F.col(target).alias("_y") if target else F.lit(None).cast("double").alias("_y")]
    e = held.select("as_of", F.col("id").cast("string").alias("_id"), "actual", known.alias("_known"), fits.alias("_fits"), *kept, F.inline(events))
    total = lambda v, when=None: F.coalesce(F.sum(F.col("kept") * (v if when is None else F.when(when, v))), F.lit(0))
    infinite = float("inf")

    def spread(name: str, v: Column, when: Column) -> dict[str, Column]:
        """The finite values' total, and how many are not finite: NaN counts as both infinities."""
        counts = {f"{name}{_UP}": v >= infinite, f"{name}{_DOWN}": (v == -infinite) | F.isnan(v)}
        return {name: total(finite(v), when)} | {c: total(one, when & odd) for c, odd in counts.items()}

    one, x, y = F.lit(1), [F.col(f"_x{i}") for i in range(len(names))], F.col("_y")
    sums = {"row_count": total(one), "purged_count": F.sum("purged"), "known_count": total(one, F.col("_known"))}
    sums |= {f"{c.lower()}_count": total(one, F.col("actual") == c) for c in CLASSES}
    values = [(f"k_{i}", v, F.col("_known")) for i, v in enumerate(x)] + [(f"kk_{i}", v * v, F.col("_known")) for i, v in enumerate(x)]
    if target:
        sums |= {"n": total(one, F.col("_fits"))}
        values += [("y", y, F.col("_fits"))] + [(f"x_{i}", v, F.col("_fits")) for i, v in enumerate(x)] + [(f"xy_{i}", v * y, F.col("_fits")) for i, v in enumerate(x)]
        values += [(f"xx_{i}_{j}", x[i] * x[j], F.col("_fits")) for i in range(len(x)) for j in range(i, len(x))]
    for value in values:
        sums |= spread(*value)
    newest = F.max(F.when(F.col("kept") == 1, F.struct("as_of", "_id", "actual"))).alias("newest")
    return e.groupBy("fold").agg(*[v.alias(n) for n, v in sums.items()], newest)


def merged(parts: DataFrame) -> DataFrame:
    """The ``steps`` of all rows from those of parts of them, laid one below the other."""
    sums = [c for c in parts.columns if c not in ("fold", "newest")]
    return parts.groupBy("fold").agg(*[F.sum(c).alias(c) for c in sums], F.max("newest").alias("newest"))


def train_states(changes: DataFrame, plan: FoldPlan, latest: datetime | None) -> DataFrame:
    """Each fold's state: the sums of all ``steps`` up to it, and ``last_direction``, the class of its last row.

    There is one row for each step of the plan's span; the sums run over these alone.
    """
    folds = changes.sparkSession.createDataFrame([(i,) for i in range(len(plan.boundaries(latest)))], "fold int")
    so_far = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    sums = [c for c in changes.columns if c not in ("fold", "newest")]
    out = folds.join(changes, "fold", "left")
    running = [F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in sums]
    # The newest row so far is in every train set that isn't empty, as older ones leave first.
    out = out.select("fold", *running, F.max("newest").over(so_far).alias("newest"))
    out = out.select("fold", *[_whole(c, sums).alias(c) for c in sums if not c.endswith((_UP, _DOWN))], "newest")
    return out.withColumn("last_direction", F.when(F.col("row_count") > 0, F.col("newest.actual"))).drop("newest")


def class_shares(states: DataFrame) -> DataFrame:
    """As ``models.class_shares`` of the train rows, for folds that have any."""
    n = [F.col(f"{c.lower()}_count") for c in CLASSES]
    shares = {f"p_{c.lower()}": ratio(n[k], sum(n[1:], n[0])) for k, c in enumerate(CLASSES)}
    return states.where("row_count > 0").select("fold", *[f"{c.lower()}_count" for c in CLASSES]).withColumns(shares | {"direction": likeliest(*n)})


def _spread(squares: Column, plain: Column, n: Column) -> Column:
    """Population deviation from sums; what rounding leaves of a deviation of 0 is none."""
    variance = squares / n - (plain / n) * (plain / n)
    return F.when(F.isnan(variance) | (variance > F.lit(1e-12) * (squares / n)), F.sqrt(variance)).otherwise(1.0)


def standardiser(states: DataFrame, names: list[str]) -> DataFrame:
    """As ``models.standardiser`` of the train rows, for folds with rows whose features are all known."""
    n = F.col("known_count")
    means = [(F.col(f"k_{i}") / n).alias(f"mean_{c}") for i, c in enumerate(names)]
    scales = [_spread(F.col(f"kk_{i}"), F.col(f"k_{i}"), n).alias(f"scale_{c}") for i, c in enumerate(names)]
    return states.where("known_count > 0").select("fold", *means, *scales, n.alias("row_count"))


def ridge(states: DataFrame, names: list[str], penalty: float = 0.01) -> DataFrame:
    """As ``models.ridge`` of the train rows, for folds with rows whose features and target are all known."""
    return models.solved(states.where("n > 0"), len(names), ["fold"], penalty)
