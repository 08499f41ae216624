"""Models beside each other: each fitted once on every distinct train set, judged on the same test rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import finite
from . import folds, models

KINDS = ("always_flat", "majority", "ridge", "logistic")
# Other names of the kinds.
ALIASES = {
    "majority_train": "majority",
    "ridge_regression": "ridge", "ridge_linear_regression": "ridge",
    "logistic_regression": "logistic", "multinomial_logistic": "logistic", "multinomial_logistic_regression": "logistic",
}


def train_sets(members: DataFrame) -> DataFrame:
    """(fold, fit_fold): the first fold that has the same train rows, told by their number and a sum of hashes of their ids.

    One row per fold, whatever the number of rows.
    """
    train = members.where("split = 'train' and kept")
    each = train.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"))
    first = each.groupBy("n", "h").agg(F.min("fold").alias("fit_fold"))
    return each.join(first, ["n", "h"]).select("fold", "fit_fold")


def fitted(members: DataFrame, spec: dict, sets: DataFrame, known: Callable[[Column], Column] = finite) -> DataFrame:
    """The models of a spec, one for each distinct train set, given to every fold that has it."""
    kind, names = spec["kind"], spec.get("features", [])
    once = sets.where("fold = fit_fold").select("fold")
    train = members.where("split = 'train' and kept").join(once, "fold", "left_semi")
    if kind == "majority":
        found = models.class_shares(train, ["fold"])
    elif kind == "ridge":
        found = models.ridge(train, names, ["fold"], spec.get("target", "target"), spec.get("penalty", 0.01), known)
    else:
        found = models.logistic(train, names, iterations=spec.get("iterations", 500), known=known)
    return sets.join(found.withColumnRenamed("fold", "fit_fold"), "fit_fold").drop("fit_fold")


def _said(members: DataFrame, spec: dict, sets: DataFrame, splits: Sequence[str], known: Callable[[Column], Column]) -> DataFrame:
    rows = members.where(F.col("split").isin(*splits) & F.col("kept"))
    kind = spec["kind"]
    if callable(kind):
        return folds.predicted(members, kind, tuple(splits))
    if kind == "always_flat":
        return rows.withColumn("predicted", F.lit("FLAT"))
    found = fitted(members, spec, sets, known)
    if kind == "majority":
        return rows.join(found.select("fold", F.col("direction").alias("predicted")), "fold", "left")
    if kind == "ridge":
        return models.score_ridge(rows, found, spec["features"], ["fold"], spec.get("decision", 0.0), known)
    return models.score_logistic(rows, found, spec["features"], known=known)


def predictions(members: DataFrame, specs: Sequence[dict], splits: Sequence[str] = ("test",), known: Callable[[Column], Column] = finite) -> DataFrame:
    """Rows (position, model, fold, split, id, actual, predicted, regime) of every spec (label, kind, features, ...).

    A kind is one of ``KINDS``, by any of its names, or a function as ``folds.predicted`` takes it. Labels name the models; two specs with one
    label are an error. A feature is missing where ``known`` is null.
    """
    labels = [s.get("label", s["kind"] if isinstance(s["kind"], str) else s["kind"].__name__) for s in specs]
    if not specs or len(set(labels)) < len(labels):
        raise ValueError("models need labels, each another one")
    specs = [{**s, "kind": s["kind"] if callable(s["kind"]) else ALIASES.get(s["kind"], s["kind"])} for s in specs]
    if bad := [s["kind"] for s in specs if not (isinstance(s["kind"], Callable) or s["kind"] in KINDS)]:
        raise ValueError(f"unknown models: {bad}")
    sets, out = train_sets(members), None
    for i, (label, spec) in enumerate(zip(labels, specs, strict=True)):
        said = _said(members, spec, sets, splits, known)
        part = said.select(F.lit(i).alias("position"), F.lit(label).alias("model"), "fold", "split", "id", "actual", "predicted", "regime")
        out = part if out is None else out.unionByName(part)
    return out


def compare(members: DataFrame, specs: Sequence[dict], splits: Sequence[str] = ("test",), by_fold: bool = False, known: Callable[[Column], Column] = finite) -> DataFrame:
    """Metrics and coverage of every spec, of all folds together or by fold."""
    return folds.fold_metrics(predictions(members, specs, splits, known), ["position", "model", *(["fold"] if by_fold else [])])
