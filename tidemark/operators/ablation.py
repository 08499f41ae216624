"""Experiments on the same folds: each feature group's worth against a baseline, its stability, and a winner."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import finite, round6
from .folds import feature_votes, fold_metrics


def check_groups(experiments: list[dict]) -> None:
    """Experiments have different names, and the groups of one have no feature in common."""
    names = [e["name"] for e in experiments]
    if len(set(names)) != len(names):
        raise ValueError("experiments must have different names")
    for e in experiments:
        features = [f for group in e["groups"].values() for f in group]
        if not features or len(set(features)) != len(features):
            raise ValueError(f"{e['name']}: feature groups must not be empty or overlap")


def run(members: DataFrame, experiments: list[dict], splits=("validation", "test"), known: Callable[[Column], Column] = finite) -> DataFrame:
    """Rows of the splits once for each experiment (position, experiment, predicted).

    An experiment is a name, groups of features, and optional thresholds and decision; all are evaluated in one pass
    over the rows, as an array of answers. A feature is missing where ``known`` is null.
    """
    check_groups(experiments)
    answers = [F.struct(F.lit(i).alias("position"), F.lit(e["name"]).alias("experiment"), feature_votes([f for g in e["groups"].values() for f in g], e.get("thresholds"), e.get("decision", 0.0), known).alias("predicted")) for i, e in enumerate(experiments)]
    return members.where(F.col("split").isin(*splits) & F.col("kept")).select("fold", "actual", F.inline(F.array(*answers)))


METRICS = ("accuracy_pct", "balanced_accuracy_pct", "macro_f1_pct", "coverage_pct")


def deltas(rows: DataFrame, baseline: str) -> DataFrame:
    """Each experiment's metrics and their difference from the baseline's, to 6 places; null if either is null."""
    found = fold_metrics(rows, ["position", "experiment"])
    base = found.where(F.col("experiment") == baseline).select(*[F.col(m).alias(f"base_{m}") for m in METRICS])
    return found.crossJoin(F.broadcast(base)).select("position", "experiment", "eligible", "evaluated", *METRICS, *[round6(F.col(m) - F.col(f"base_{m}")).alias(f"{m}_delta") for m in METRICS])


def stability(rows: DataFrame, baseline: str, metric: str = "accuracy_pct") -> DataFrame:
    """Over folds: mean, least, most and range of the metric, and in how many folds it beats the baseline's."""
    found = fold_metrics(rows, ["experiment", "fold"]).select("experiment", "fold", F.col(metric).alias("value"))
    base = found.where(F.col("experiment") == baseline).select("fold", F.col("value").alias("base"))
    both = found.join(F.broadcast(base), "fold", "left")
    return both.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("fold_count"), F.count_if(F.col("value") > F.col("base")).alias("folds_improved"), round6(F.avg("value")).alias("mean"),
        round6(F.min("value")).alias("minimum"), round6(F.max("value")).alias("maximum"), round6(F.max("value") - F.min("value")).alias("range"),
    )


def contributions(changes: DataFrame, experiments: list[dict], metric: str = "accuracy_pct") -> DataFrame:
    """For each feature group: experiments that have it, and the mean and best change of the metric."""
    pairs = [(e["name"], g) for e in experiments for g in e["groups"]]
    groups = changes.sparkSession.createDataFrame(pairs, "experiment string, feature_group string")
    held = changes.join(F.broadcast(groups), "experiment").where(F.col(f"{metric}_delta").isNotNull())
    return held.groupBy("feature_group").agg(F.count(F.lit(1)).alias("experiment_count"), round6(F.avg(f"{metric}_delta")).alias("mean_delta"), round6(F.max(f"{metric}_delta")).alias("best_delta"))


def winner(changes: DataFrame, metric: str = "accuracy_pct") -> DataFrame:
    """The experiment of the highest metric, the first of equals, if strictly above the baseline; else no row."""
    return changes.where(F.col(f"{metric}_delta") > 0).orderBy(F.desc(metric), "position").limit(1)
