"""Hand-computed cases, invariance and brute force for the engine's operators."""

import json
import random
from datetime import datetime, timedelta
from functools import reduce

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import values as V
from tidemark.operators import ablation, bars, calibration, contract, evaluation, features, folds, health, models, policy, quality, regimes, sentiment, series, states, views
from tidemark.operators.components import components
from tidemark.sources import archive, feeds, quotes, snapshots

T0 = datetime(2026, 1, 5)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_numbers_and_times(spark):
    texts = ["1.5", " -2e3 ", "1_000", "12d", "nan", "inf", "true", "", None, ".5"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(V.lenient_number(F.col("t"))).collect()]
    assert got == [1.5, -2000.0, 1000.0, None, None, None, None, None, None, 0.5]
    times = ["2026-01-05T00:00:00Z", "2026-01-05T07:00:00+07:00", "1767571200", "1767571200000", "2026-01-05T00:00:00", "soon", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t string").select(V.iso_second(V.parse_time(F.col("t")))).collect()]
    assert got == ["2026-01-05T00:00:00+00:00"] * 4 + [None] * 3
    v = spark.createDataFrame([('{"a": 1, "b": "1", "c": true, "d": 2.5}',)], "j string").select(F.parse_json("j").alias("v"))
    assert [v.select(V.strict_number(F.variant_get("v", f"$.{k}", "variant"))).first()[0] for k in "abcd"] == [1.0, None, None, 2.5]


def test_an_alias_that_cannot_be_parsed_does_not_fall_through(spark):
    raw = spark.createDataFrame([("A", "bad", "7"), ("B", None, "7")], "symbol string, price string, last string")
    assert {r.symbol: r.price for r in bars.canonical_quotes(raw).collect()} == {"A": None, "B": 7.0}


def test_classes_are_strict_and_ties_are_ordered(spark):
    r = one(spark, a=V.classify(F.lit(1.0), 1.0), b=V.classify(F.lit(1.1), 1.0), c=V.classify(F.lit(-1.1), 1.0), d=V.classify(F.lit(None).cast("double"), 1.0), e=V.likeliest(F.lit(0.3), F.lit(0.4), F.lit(0.4)))
    assert tuple(r) == ("FLAT", "UP", "DOWN", None, "FLAT")


def test_bars_are_rejected_or_clamped(spark):
    raw = [("A", "2026-01-05T00:00:00Z", 10.0, 8.0, 9.0, 9.5, None), ("A", "2026-01-05T01:00:00Z", 10.0, 12.0, 9.0, 11.0, 5.0)]
    df = spark.createDataFrame(raw, "symbol string, observed_at string, open double, high double, low double, close double, volume double")
    assert [r.close for r in bars.canonical_bars(df).collect()] == [11.0]
    chart = bars.clamped_bars(df.withColumn("_ord", F.lit(1))).orderBy("observed_at").first()
    assert (chart.high, chart.low, chart.volume) == (10.0, 8.0, 0.0)


BARS = "symbol string, bar_time timestamp_ntz, open double, high double, low double, close double, volume double"


def made_bars(spark, closes, symbol="A"):
    return spark.createDataFrame([(symbol, T0 + timedelta(hours=i), c, c + 2, c - 2, float(c), 10.0 * (i + 1)) for i, c in enumerate(map(float, closes))], BARS)


def quote(spark, at, price, volume=100.0, symbol="A"):
    return spark.createDataFrame([(symbol, at, price, volume)], "symbol string, quote_time timestamp_ntz, price double, quote_volume double")


def test_features_by_hand_and_nothing_ahead_is_read(spark):
    closes = [100, 102, 101, 105, 110, 108]
    q = quote(spark, T0 + timedelta(hours=5, minutes=1), 120.0)
    r = features.features(made_bars(spark, closes), q, (1, 5), (5,), 5).first()
    steps = np.array(closes[1:]) / np.array(closes[:-1]) - 1
    assert r.bar_count == 6 and r.return_1 == pytest.approx(120 / 108 - 1) and r.return_5 == pytest.approx(120 / 102 - 1) and r.momentum == r.return_5
    assert r.volatility_5 == pytest.approx(steps.std()) and r.distance_to_high_5 == pytest.approx(120 / 112 - 1) and r.gap == pytest.approx(108 / 110 - 1)
    assert r.average_true_range_5 == pytest.approx(np.mean([4, 4, 6, 7, 4]) / 108) and r.volume_ratio == pytest.approx(100 / 35) and r.turnover == 12000
    later = made_bars(spark, [*closes, 5000, 1])
    assert features.features(later, q, (1, 5), (5,), 5).first() == r
    assert features.features(later.orderBy(F.rand(3)), q, (1, 5), (5,), 5).first() == r
    early = features.features(made_bars(spark, closes), quote(spark, T0 - timedelta(hours=1), 120.0), (1,), (5,), 5).first()
    assert early.bar_count == 0 and early.return_1 is None and early.volatility_5 is None


def ticks_of_symbols(spark, counts, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(s, T0 + timedelta(minutes=int(m)), *sorted(rng.uniform(50, 150, 3).round(3).tolist()), float(rng.integers(-1, 50))) for s, n in counts.items() for m in rng.choice(60 * 24 * 40, n, replace=False)]
    b = spark.createDataFrame([(s, t, c, h, lo, c, v) for s, t, lo, c, h, v in rows], "symbol string, bar_time timestamp_ntz, open double, high double, low double, close double, volume double")
    asked = [(s, T0 + timedelta(minutes=int(m) - 2000), 100.0, 5.0) for s in [*counts, "none"] for m in rng.choice(60 * 24 * 44, 150, replace=False)]
    return b, spark.createDataFrame(asked, "symbol string, quote_time timestamp_ntz, price double, quote_volume double")


@pytest.mark.parametrize(("bucket", "block"), [(86_400, 64), (7200, 22), (10**7, 300), (600, 4096)])
def test_blocks_of_time_know_what_whole_symbols_do(spark, bucket, block):
    b, q = ticks_of_symbols(spark, {"A": 900, "B": 30, "C": 1, "D": 3})
    columns = [c for c in features.trailing(b).columns if c not in ("symbol", "bar_time")]
    nan = float("nan")
    at = lambda df, *keys: {tuple(r[k] for k in keys): [nan if r[c] is None else r[c] for c in df.columns if c not in keys] for r in df.collect()}
    whole, split = at(features.trailing(b), "symbol", "bar_time"), at(features.trailing_in_blocks(b, bucket_seconds=bucket, block_bars=block).select("symbol", "bar_time", *columns), "symbol", "bar_time")
    assert whole.keys() == split.keys()
    for k in whole:
        assert split[k] == pytest.approx(whole[k], rel=1e-9, nan_ok=True)
    whole, split = at(features.features(b, q), "symbol", "quote_time"), at(features.features(b, q, bucket_seconds=bucket), "symbol", "quote_time")
    assert whole.keys() == split.keys() and len(split) == 5 * 150
    for k in whole:
        assert split[k] == pytest.approx(whole[k], rel=1e-9, nan_ok=True)


def test_no_task_needs_a_whole_symbol(spark):
    b, q = ticks_of_symbols(spark, {"hot": 8000, **{f"s{i}": 160 for i in range(100)}})
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "97")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows_here = lambda frames: [pd.DataFrame({"n": [sum(len(f) for f in frames)]})]
        largest = lambda df, read: df.select(read).mapInPandas(rows_here, "n bigint").agg(F.max("n")).first()[0]
        assert largest(features.trailing(b), "volatility_20") >= 8000
        assert largest(features.trailing_in_blocks(b, block_bars=256), "volatility_20") < 1600
        asked = q.union(b.where("symbol = 'hot'").select("symbol", "bar_time", "close", "volume"))
        assert largest(features.as_of(b, asked, ["close"]), "close") >= 8000
        assert largest(features.as_of_in_blocks(b, asked, ["close"]), "close") < 1600
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_series_need_one_more_value_than_the_horizon(spark):
    rows = [("x", T0 + timedelta(days=i), float(v), 0) for i, v in enumerate([100, 110, 121])] + [("x", T0 + timedelta(days=9), 999.0, 0), ("x", None, 5.0, 0), ("x", T0, -1.0, 0)]
    p = spark.createDataFrame(rows, "series string, observed_at timestamp_ntz, value double, _ord int")
    as_of = F.lit(T0 + timedelta(days=3)).cast("timestamp_ntz")
    r = series.changes(series.eligible(p, as_of, True), (1, 2, 3)).first()
    assert r.change_1 == pytest.approx(0.1) and r.change_2 == pytest.approx(0.21) and r.change_3 is None
    a = series.availability(p, as_of, True).first()
    assert (a.eligible_count, a.excluded_future_count, a.invalid_count) == (3, 1, 2)


def test_votes(spark):
    rows = [("a", s) for s in (1, 1, 0)] + [("b", s) for s in (-1, -1, None, -1)] + [("c", s) for s in (1, 1, None)] + [("d", s) for s in (1, -1, 1)]
    got = {r.k: (r.regime, r.score) for r in regimes.vote(spark.createDataFrame(rows, "k string, signal int"), ["k"]).collect()}
    assert got == {"a": ("risk_on", 2), "b": ("risk_off", -3), "c": (None, 2), "d": ("neutral", 1)}


def test_metrics_of_snapshots_by_hand(spark):
    f = [("p1", s, d, 100.0, t, 1.0) for s, d, t in (("A", "UP", 2.0), ("B", "FLAT", 0.0), ("C", "DOWN", -2.0), ("D", "ABSTAIN", 0.0), ("E", "UP", 1.0))]
    o = [("p1", "A", 103.0), ("p1", "B", 100.5), ("p1", "C", 97.0), ("p1", "D", 100.0)]
    rows = evaluation.settled(spark.createDataFrame(f, "pair string, symbol string, forecast string, baseline double, target_return_pct double, threshold_pct double"), spark.createDataFrame(o, "pair string, symbol string, baseline double"))
    r = evaluation.pair_reports(rows).first()
    assert (r.evaluated, r.missing_symbols, r.invalid_symbols, r.status, r.coverage_pct) == (3, ["E"], ["D"], "pending", 60.0)
    m = evaluation.classification_metrics(evaluation.confusion(rows.where("state = 'evaluated'"), [], "actual", "forecast"), []).first()
    assert (m.accuracy_pct, m.balanced_accuracy_pct, m.macro_f1_pct) == (100.0, 100.0, 100.0) and r.target_mae_pct == pytest.approx(0.833333)
    pairs = spark.createDataFrame([("a", "open", "break", 1.0), ("b", "open", "close", 1.0), ("c", "close", "open", None), ("d", None, "open", 1.0)], "pair string, slot string, checkpoint_slot string, threshold_pct double")
    assert {r.pair: r.reason for r in evaluation.check_pairs(pairs).collect()} == {"b": "wrong_checkpoint", "c": "missing_threshold", "d": "unknown_slot"}


ROWS = "id string, as_of timestamp_ntz, horizon_seconds double, actual string, x double, target double"


def wf_rows(spark, n=12, horizons=None):
    cycle = ("UP", "FLAT", "DOWN")
    return spark.createDataFrame([(f"r{i}", T0 + timedelta(hours=i), float((horizons or {}).get(i, 3600)), cycle[i % 3], float(i - 5), (i - 5) / 10) for i in range(n)], ROWS)


def test_folds_purge_and_embargo(spark):
    plan = folds.FoldPlan(T0 + timedelta(hours=4), 2 * 3600, 2 * 3600, embargo_seconds=3600, fold_count=1)
    m = folds.membership(wf_rows(spark, horizons={3: 7200}), plan, T0 + timedelta(hours=11))
    got = {s: sorted(r.id for r in m.where(F.col("split") == s).where("kept").collect()) for s in ("train", "validation", "test")}
    assert got == {"train": ["r0", "r1", "r2"], "validation": ["r4", "r5"], "test": ["r7", "r8"]}
    c = folds.fold_counts(m).first()
    assert (c.purged_train_count, c.purged_validation_count) == (1, 0)
    with pytest.raises(ValueError):
        folds.FoldPlan(T0, 1, 1, mode="rolling")


def test_splits_of_a_fold_never_meet(spark):
    rng = random.Random(5)
    for _ in range(4):
        plan = folds.FoldPlan(T0 + timedelta(hours=rng.randrange(3, 9)), rng.randrange(1, 5) * 1800, rng.randrange(1, 5) * 1800, purge_seconds=rng.randrange(3) * 1800, embargo_seconds=rng.randrange(3) * 1800)
        m = folds.membership(wf_rows(spark, 24), plan, T0 + timedelta(hours=23)).where("kept")
        assert m.groupBy("fold", "id").count().where("count > 1").count() == 0
        order = m.groupBy("fold").pivot("split", ["train", "test"]).agg(F.max("as_of").alias("hi"), F.min("as_of").alias("lo"))
        assert order.where("train_hi >= test_lo").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_train_states_are_those_of_the_members(spark, seed):
    rng = random.Random(seed)
    late = {i: rng.choice((0, 1800, 7200, 40_000)) for i in range(60)}
    rows = wf_rows(spark, 60, late).withColumn("x", F.when(F.col("id") != "r7", F.col("x"))).withColumn("z", F.col("x") * F.col("x") + F.hash("id") % 5)
    limit = rng.choice((None, 9 * 3600, 5400))
    mode = "expanding" if limit is None else rng.choice(("expanding", "rolling"))
    plan = folds.FoldPlan(T0 + timedelta(hours=rng.randrange(-3, 9)), 5400, 7200, step_seconds=rng.choice((1800, 5400, 7200)), mode=mode, train_seconds=limit, purge_seconds=rng.randrange(3) * 1800, embargo_seconds=1800)
    latest = T0 + timedelta(hours=59)
    parts = [states.steps(rows.where(F.hash("id") % 3 == k), plan, latest, ["x", "z"], "target") for k in (-2, -1, 0, 1, 2)]
    s = states.train_states(states.merged(reduce(lambda a, b: a.unionByName(b), parts)), plan, latest).cache()
    m = folds.membership(rows, plan, latest)
    counts = {r.fold: (r.train_count, r.purged_train_count) for r in folds.fold_counts(m).collect()}
    got = {r.fold: r for r in s.collect()}
    assert len(got) == len(plan.boundaries(latest)) and all((got[f].row_count, got[f].purged_count) == counts.get(f, (0, 0)) for f in got)
    train = m.where("split = 'train' and kept")
    for r in folds.train_state(m).collect():
        assert got[r.fold].last_direction == r.last_direction
    shares = {r.fold: r for r in states.class_shares(s).collect()}
    assert {f: (r.direction, r.p_up) for f, r in shares.items()} == {r.fold: (r.direction, r.p_up) for r in models.class_shares(train, ["fold"]).collect()}
    scales = {r.fold: r for r in states.standardiser(s, ["x", "z"]).collect()}
    for r in models.standardiser(train, ["x", "z"], ["fold"]).collect():
        assert tuple(scales[r.fold]) == pytest.approx(tuple(r), abs=1e-7)
    lines = {r.fold: r for r in states.ridge(s, ["x", "z"]).collect()}
    for r in models.ridge(train, ["x", "z"], ["fold"]).collect():
        assert lines[r.fold].coefficients == pytest.approx(r.coefficients, abs=1e-6) and lines[r.fold].intercept == pytest.approx(r.intercept)


def test_states_copy_no_row_into_the_folds(spark):
    rows = wf_rows(spark, 200)
    plan = folds.FoldPlan(T0, 3600, 3600, step_seconds=3600)
    latest = T0 + timedelta(hours=199)
    assert len(plan.boundaries(latest)) > 150
    changes = states.steps(rows, plan, latest, ["x"], "target")
    assert changes.groupBy().agg(F.sum("row_count")).first()[0] == 198  # each row enters once, but the last two, which no boundary follows
    assert folds.membership(rows, plan, latest).where("split = 'train'").count() > 10_000


def test_predictors_and_missing_features(spark):
    m = wf_rows(spark).withColumns({"fold": F.lit(0), "split": F.when(F.col("as_of") < T0 + timedelta(hours=5), "train").otherwise("test"), "kept": F.lit(True)})
    m = m.withColumn("x", F.when(F.col("id") != "r7", F.col("x")))
    assert {r.predicted for r in folds.predicted(m, "majority_train").collect()} == {"UP"}
    assert {r.predicted for r in folds.predicted(m, "previous_direction").collect()} == {"FLAT"}
    r = folds.fold_metrics(folds.predicted(m, "feature_sign", features=["x"], thresholds={"x": 2.0}), ["fold"]).first()
    assert (r.eligible, r.evaluated) == (7, 6) and r.coverage_pct == pytest.approx(85.714286)
    with pytest.raises(ValueError):
        folds.feature_votes(["x"], {"y": 1.0})
    with pytest.raises(ValueError):
        folds.predicted(m, "always_flat", ("train",))


def test_ridge_and_logistic_are_the_plain_algorithms(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2)) * [1, 5] + [0, 3]
    y = np.digitize(x[:, 0], [-0.5, 0.5])
    rows = [(0, f"i{k}", T0, float(a), float(b), float(a - b), ("UP", "FLAT", "DOWN")[c]) for k, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "fold int, id string, as_of timestamp_ntz, a double, b double, target double, actual string")
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 0.01 * 60 * np.eye(2), z.T @ (x[:, 0] - x[:, 1]))
    r = models.ridge(df, ["a", "b"], ["fold"])
    assert np.allclose(r.first().coefficients, want)
    scored = models.score_ridge(df, r, ["a", "b"], ["fold"]).orderBy("id").collect()
    assert scored[0].predicted_target == pytest.approx((x[:, 0] - x[:, 1]).mean() + z[0] @ want)
    m = models.logistic(df, ["a", "b"], iterations=50)
    w, b = np.zeros((3, 2)), np.zeros(3)
    for _ in range(50):
        gw, gb = np.zeros((3, 2)), np.zeros(3)
        for row, c in zip(z, y):
            p = np.exp(w @ row + b)
            p /= p.sum()
            e = p - np.eye(3)[c]
            gw, gb = gw + np.outer(e, row), gb + e
        w, b = w - 0.1 * (gw / 60 + 0.01 * w), b - 0.1 * gb / 60
    assert np.allclose(m.first().coefficients, w) and np.allclose(m.first().intercepts, b)
    back = models.from_documents(models.to_documents(m, "logistic"), "logistic", "fold int, intercepts array<double>").first()
    assert np.allclose(back.intercepts, b) and models.from_documents(models.to_documents(m, "other"), "logistic", "fold int").count() == 0
    probs = models.score_logistic(df, m, ["a", "b"]).first()
    assert probs.p_up + probs.p_flat + probs.p_down == pytest.approx(1)


def test_calibration(spark):
    cycle = ("UP", "FLAT", "DOWN")
    rows = [(i, "day", *[0.8 if k == i % 3 else 0.1 for k in range(3)], cycle[i % 3 if i % 5 else (i + 1) % 3]) for i in range(30)] + [(99, "day", 0.9, 0.9, 0.9, "UP")]
    df = spark.createDataFrame(rows, "id int, horizon string, p_up double, p_flat double, p_down double, actual string")
    c = calibration.fit(df, ["horizon"], iterations=50)
    assert c.first().fitted_rows == 30
    out = {r.id: r for r in calibration.apply(df.unionByName(df.limit(1).withColumns({"id": F.lit(100), "horizon": F.lit("week")})), c, ["horizon"]).collect()}
    assert out[99].reason == "invalid_probabilities" and out[100].reason == "calibrator_unavailable_for_horizon" and out[100].decision == "ABSTAIN"
    assert out[1].c_up + out[1].c_flat + out[1].c_down == pytest.approx(1) and out[1].decision == "FLAT"
    s = calibration.scores(df, []).first()
    assert (s.eligible, s.evaluated, s.rejected) == (31, 30, 1) and s.brier_score == pytest.approx((24 * 0.06 + 6 * 1.46) / 30)
    bins = calibration.reliability(df)
    assert bins.count() == 10 and bins.where("n > 0").first().accuracy == pytest.approx(0.8) and bins.where("n > 0").first()["bin"] == 8
    assert calibration.calibration_error(bins).first()[0] == pytest.approx(0, abs=1e-9)


def curve_by_hand(x, y, iterations, rate, penalty=0.0):
    slope, intercept = 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    for _ in range(iterations):
        error = 1 / (1 + np.exp(-(intercept + slope * x))) - y
        slope, intercept = slope - rate * ((error * x).mean() + penalty * slope), intercept - rate * error.mean()
    return slope, intercept


def temperature_by_hand(p, y, iterations, rate):
    z, at = np.log(np.clip(p, 1e-12, 1 - 1e-12)), 0.0
    for _ in range(iterations):
        w = np.exp(z / np.exp(at))
        w /= w.sum(1, keepdims=True)
        gradient = (z[np.arange(len(y)), y] - (w * z).sum(1)).mean() / np.exp(at)
        at = float(np.clip(at - rate * gradient, np.log(0.01), np.log(100)))
    return np.exp(at)


@pytest.mark.parametrize("tasks", [1, 3, 4])
def test_fits_in_barrier_tasks_are_of_all_rows(spark, tasks):
    """Whatever tasks hold which rows, the steps are those over all rows, in one job and without a sample."""
    rng = np.random.default_rng(8)
    cycle = ("UP", "FLAT", "DOWN")
    few = [[0.7, 0.2, 0.1], [0.2, 0.5, 0.3], [0.1, 0.3, 0.6]]
    rows = [(i, "day", *few[rng.integers(3)], cycle[rng.integers(3)]) for i in range(300)] + [(i, "week", *rng.dirichlet([2, 2, 2]).tolist(), cycle[rng.integers(3)]) for i in range(300)]
    rows += [(i, None, *few[0], cycle[i % 2]) for i in range(9)] + [(1, "bad", 0.9, 0.9, 0.9, "UP"), (2, "day", 0.5, 0.5, 0.0, "up?")]
    df = spark.createDataFrame(rows, "id int, horizon string, p_up double, p_flat double, p_down double, actual string")
    found = {r.horizon: r for r in calibration.fit(df, ["horizon"], iterations=30, penalty=0.01, tasks=tasks).collect()}
    again = {r.horizon: r for r in calibration.coefficients(df, ["horizon"], iterations=40, tasks=tasks).collect()}
    assert set(found) == {"day", "week", None} and set(again) == {"day", "week", None, "bad"} and again["bad"].up_slope is None
    for key in found:
        own = [(p, cycle.index(a)) for _, k, *p, a in rows if k == key and a in cycle]
        p, y = np.array([o[0] for o in own]), np.array([o[1] for o in own])
        x = np.log(p / (1 - p))
        curves = [curve_by_hand(x[:, k], (y == k).astype(float), 30, 0.05, 0.01) for k in range(3)]
        raw = np.stack([1 / (1 + np.exp(-(b + a * x[:, k]))) for k, (a, b) in enumerate(curves)], 1)
        r = found[key]
        assert r.fitted_rows == len(own) and np.allclose(r.slopes, [a for a, _ in curves], atol=1e-9) and np.allclose(r.shifts, [b for _, b in curves], atol=1e-9)
        assert r.temperature == pytest.approx(temperature_by_hand(raw / raw.sum(1, keepdims=True), y, 30, 0.05))
        for k, c in enumerate(("up", "flat", "down")):
            if 0 < (y == k).sum() < len(y):
                assert np.allclose([again[key][f"{c}_slope"], again[key][f"{c}_intercept"]], curve_by_hand(x[:, k], (y == k).astype(float), 40, 0.03), atol=1e-9)
            else:
                assert again[key][f"{c}_slope"] is None and again[key][f"{c}_intercept"] is None
    x = rng.normal(size=(400, 2)) * [1, 5]
    train = spark.createDataFrame([(k % 2, f"i{k}", T0, float(a), float(b), cycle[k % 3]) for k, (a, b) in enumerate(x)] + [(7, "i", T0, 1.0, 2.0, "UP"), (8, "i", T0, None, 2.0, "UP")], "fold int, id string, as_of timestamp_ntz, a double, b double, actual string")
    m = {r.fold: r for r in models.logistic(train, ["a", "b"], iterations=5, tasks=tasks).collect()}
    assert set(m) == {0, 1, 7} and m[7].scales == [1.0, 1.0] and m[0].row_count == 200
    assert np.allclose(m[1].means, x[1::2].mean(0)) and np.allclose(m[1].scales, x[1::2].std(0))
    assert models.logistic(train.limit(0), ["a"], iterations=5).count() == 0


def test_a_fit_is_one_job(spark):
    train = spark.createDataFrame([(k % 2, float(k), ("UP", "FLAT")[k % 2]) for k in range(40)], "fold int, a double, actual string")
    spark.sparkContext.setJobGroup("one-fit", "")
    try:
        assert models.logistic(train, ["a"], iterations=20, tasks=2).count() == 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("one-fit") for s in tracker.getJobInfo(j).stageIds}
    barriers = [s for s in stages if (info := tracker.getStageInfo(s)) and info.numTasks == 2]
    assert len(tracker.getJobIdsForGroup("one-fit")) <= 4 and barriers  # exchanges of the plan are jobs of their own; no job for each step


def test_ablation_rejects_bad_experiments():
    with pytest.raises(ValueError):
        ablation.check_groups([{"name": "a", "groups": {"g": ["x"], "h": ["x"]}}])
    with pytest.raises(ValueError):
        ablation.check_groups([{"name": "a", "groups": {"g": ["x"]}}, {"name": "a", "groups": {"g": ["y"]}}])


def test_policy_gates(spark):
    flags = {n: None for n, _ in policy.FLAGS}
    base = {"forecast_direction": "UP", "confidence": 0.7, "p_up": 0.6, "p_flat": 0.3, "p_down": 0.1, "data_quality": {"status": "ok", **flags}, "required_context": {"a": True}, "liquidity": 2.0, "suspension": False, "limit_move": False, "corporate_action": False, "history_count": 20, "signal_conflict": 0.5}
    schema = "forecast_direction string, confidence double, p_up double, p_flat double, p_down double, data_quality struct<status string, " + ", ".join(f"{n} boolean" for n in flags) + ">, required_context map<string,boolean>, liquidity double, suspension boolean, limit_move boolean, corporate_action boolean, history_count int, signal_conflict double"
    schema = schema.replace("status string", "status: string").replace(" boolean,", ": boolean,", len(flags) - 1).replace("corporate_action_warning boolean>", "corporate_action_warning: boolean>")
    cases = [({}, []), ({"signal_conflict": 0.51}, ["signal_conflict"]), ({"data_quality": {"status": "partial", **flags, "stale": True}}, ["partial_data", "stale_data"]), ({"p_up": 0.9}, ["invalid_probabilities"]), ({"p_up": None, "p_flat": None, "p_down": None}, []),
             ({"required_context": {"a": True, "b": False}}, ["required_context_unavailable"]), ({"liquidity": 0.5, "history_count": 3, "suspension": True}, ["inadequate_liquidity", "inadequate_history", "suspension"]), ({"confidence": None, "data_quality": None}, ["missing_confidence", "missing_data_quality"])]
    names = list(base)
    for change, codes in cases:
        r = policy.decide(spark.createDataFrame([tuple({**base, **change}[n] for n in names)], schema)).first()
        assert r.reason_codes == codes and r.decision == ("ABSTAIN" if codes else "UP")


def snapshot(**change):
    stock = {"symbol": "AAA", "forecast": "UP", "baseline": 10, "sentiment_context": dict.fromkeys(contract.LAYERS, "x"), "sentiment_conflict": False, "forecast_modifier": "neutral", "sentiment_summary": "s", "data_quality": {"status": "ok", "issues": [], "observed_at": "2026-01-05T09:00:00+07:00"}}
    doc = {"archive_metadata": {"schema_version": "1.0", "snapshot_id": "i", "created_at": "2026-01-05T09:00:00+07:00", "trading_date": "2026-01-05", "slot": "close", "horizon": "close_to_next_open", "timezone": "Asia/Jakarta", "source": "s", "immutable": True}, "market_context": {"indonesia_market": "a", "global": "b"}, "stocks": [{**stock, **change}]}
    return doc


def broken(spark, doc):
    text = doc if isinstance(doc, str) else json.dumps(doc)
    return sorted(r.violation for r in contract.violations(spark.createDataFrame([("p", text)], "path string, text string")).collect())


def test_contract_names_every_violation(spark):
    assert broken(spark, snapshot()) == []
    assert broken(spark, snapshot(forecast="BUY", probability_up=1.1)) == ["forecast is unknown", "probability_up must be a number from 0 to 1"]
    d = snapshot()
    d["archive_metadata"]["horizon"] = "open_to_break"
    del d["archive_metadata"]["source"]
    d["stocks"].append(d["stocks"][0])
    assert broken(spark, d) == ["archive_metadata.horizon does not fit the slot", "archive_metadata.source is required", "symbol is a duplicate"]
    assert broken(spark, "[") == ["root must be an object"] and "data_quality must be an object" in broken(spark, snapshot(data_quality=None))


def test_calendar(spark):
    days = spark.sql("select date'2026-08-14' as day")
    none, monday = spark.sql("select date'2026-08-17' as day where false"), spark.sql("select date'2026-08-17' as day")
    assert [str(contract.trading_days(days, h).first().next_trading_day) for h in (none, monday)] == ["2026-08-17", "2026-08-18"]


def test_urls_titles_and_tiers(spark):
    urls = ["HTTPS://User@Example.COM:443/a?utm_source=x&b=2&a=1&fbclid=9#top", "http://example.com:8080", "ftp://x/y", "not a url", "https://x.org/?q=a%20b&e="]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(X.canonical_url(F.col("u"))).collect()]
    assert got == ["https://User@example.com/a?a=1&b=2", "http://example.com:8080/", None, None, "https://x.org/?e=&q=a+b"]
    titles = spark.createDataFrame([("  Straße — ＦＵＬＬ ﬁne!! ",), ("!!!",), (None,)], "t string")
    assert [r[0] for r in titles.select(X.normal_title("t")).collect()] == ["strasse full fine", None, None]
    h = lambda s: X.source_tier(F.lit(None).cast("string"), F.lit(s), ["issuer.test"])
    assert tuple(one(spark, a=h("www.reuters.com"), b=h("ir.issuer.test"), c=h("notreuters.com"), d=h("google.com"))) == ("financial", "primary", "unknown", "discovery")


def greedy(rows):
    urls, titles, kept = set(), set(), []
    for layer, o, u, t in sorted(rows, key=lambda r: (r[0], r[1])):
        if (u and (layer, u) in urls) or (layer, t) in titles:
            continue
        kept.append((layer, o))
        titles.add((layer, t))
        if u:
            urls.add((layer, u))
    return kept


def test_first_wins_is_greedy(spark):
    rng = random.Random(7)
    fixed = [("x", 1, "u1", "t1"), ("x", 2, "u2", "t1"), ("x", 3, "u2", "t2")]
    rows = fixed + [(rng.choice("ab"), i, rng.choice([None, *[f"u{k}" for k in range(12)]]), f"t{rng.randrange(12)}") for i in range(10, 90)]
    df = spark.createDataFrame(rows, "layer string, _ord bigint, url string, normalized_title string").withColumn("normalized_publisher", F.lit("p"))
    got = sorted((r.layer, r._ord) for r in sentiment.first_wins(df).collect())
    assert got == sorted(greedy(rows)) and ("x", 3) in got and ("x", 2) not in got


@pytest.mark.parametrize("walked", [1, 5, 50_000])
def test_first_wins_of_components_and_in_rounds(spark, walked):
    rng = random.Random(walked)
    rows = [(rng.choice("abc"), i, rng.choice([None, *[f"u{k}" for k in range(150)]]), f"t{rng.randrange(150)}") for i in range(400)]
    rows += [("d", i, f"v{i}", f"s{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "layer string, _ord bigint, url string, normalized_title string").withColumn("normalized_publisher", F.lit("p")).repartition(3)
    assert sorted((r.layer, r._ord) for r in sentiment.first_wins(df, walked, at_once=0).collect()) == sorted(greedy(rows))
    assert sentiment.first_wins(df.limit(0), walked, at_once=0).count() == 0


def test_a_long_chain_settles_in_few_rounds(spark):
    rows = [("x", i, f"u{(i + 1) // 2}", f"t{i // 2}") for i in range(5000)]
    df = spark.createDataFrame(rows, "layer string, _ord bigint, url string, normalized_title string").withColumn("normalized_publisher", F.lit("p"))
    got = sorted((r.layer, r._ord) for r in sentiment.first_wins(df, at_once=0).collect())
    assert got == sorted(greedy(rows)) == [("x", i) for i in range(0, 5000, 2)]
    links = spark.range(5000).select(F.hash("id").cast("bigint").alias("a"), F.hash(F.col("id") + 1).cast("bigint").alias("b"))
    found = components(links, rounds=20)
    assert found.count() == 5001 and found.select("root").distinct().count() == 1


def test_components_by_hand(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000, i) for i in range(1001, 1400)] + [(5000, i) for i in range(4000, 4300)] + [(7, 7), (9999, 9999), (None, 3), (4, None)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        if a is not None and b is not None and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.key: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: find(k) for k in root}


def test_articles_are_ranked_by_time_title_and_publisher(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, T0 + timedelta(days=rng.randrange(4)), rng.choice("xyz"), rng.choice("pq")) for i in range(200)]
    df = spark.createDataFrame(rows, "layer string, _ord bigint, published_at timestamp_ntz, normalized_title string, publisher string").repartition(3)
    got = {r._ord: r.place for r in sentiment.ranked(df).collect()}
    for layer in "ab":
        own = sorted((r for r in rows if r[0] == layer), key=lambda r: r[2:5], reverse=True)
        assert {r[1]: i + 1 for i, r in enumerate(own)} == {r[1]: got[r[1]] for r in own}  # ties keep the order of their feed


def test_quality_statuses(spark):
    b = made_bars(spark, [100, 101, 102])
    at = T0 + timedelta(hours=2, minutes=2)
    q = lambda price, prev, seen, missing=False: spark.createDataFrame([("A", price, prev, seen, missing, False, False, 3)], "symbol string, price double, previous_close double, observed_at timestamp_ntz, missing boolean, corporate_action boolean, suspended boolean, raw_bar_count int")
    r = quality.assess(q(102.0, 100.0, T0 + timedelta(hours=2)), b, F.lit(at).cast("timestamp_ntz")).first()
    assert (r.status, r.issues, r.age_seconds, r.volume_ratio, r.turnover) == ("ok", [], 120.0, 2.0, 3060.0)
    assert quality.assess(q(130.0, 100.0, T0), b, F.lit(at).cast("timestamp_ntz")).first().issues == ["stale_quote", "limit_move"]
    assert quality.assess(q(None, None, None, True), b, F.lit(at).cast("timestamp_ntz")).first().status == "unavailable"
    assert quality.assess(q(102.0, 100.0, at + timedelta(hours=1)), b.limit(0), F.lit(at).cast("timestamp_ntz")).first().issues == ["missing_bars", "invalid_bars"]


def test_archive_round_trip_and_tampering(spark, tmp_path):
    root = tmp_path / "archive"
    archive.write_report(str(root / "2026" / "a.json"), {"b": 1, "a": [1.5, None]})
    archive.write_report(str(root / "b.json"), snapshot())
    assert (root / "2026" / "a.json").read_text().index('"a"') < (root / "2026" / "a.json").read_text().index('"b"')
    with pytest.raises(ValueError):
        archive.write_report(str(root / "c.json"), {"x": float("nan")})
    assert sorted(p.name for p in root.rglob("*") if p.is_file()) == ["a.json", "b.json"]
    before = archive.manifest(spark, str(root))
    before = spark.createDataFrame(before.collect(), before.schema)
    assert sorted(r.path for r in before.collect()) == ["2026/a.json", "b.json"]
    assert archive.mismatches(before, archive.manifest(spark, str(root))).count() == 0
    (root / "b.json").write_text("changed")
    (root / "d.json").write_text("{}")
    assert {r.path: r.reason for r in archive.mismatches(before, archive.manifest(spark, str(root))).collect()} == {"b.json": "differs", "d.json": "unlisted"}
    assert "—" in archive.markdown("T", spark.sql("select 1 as a, cast(null as double) as b"))


def test_snapshot_files(spark, tmp_path):
    old = {"as_of": "2026-01-05T09:01:00+07:00", "snapshot_slot": "open_0901_wib", "actual_threshold_pct": 0.5, "benchmark": {"symbol": " idx ", "displayed_price": 7000}, "universe_count": 3, "stocks": [{"symbol": " bbb ", "forecast": "UP", "baseline": 10, "target_return_pct": "1"}, {"symbol": "BBB"}]}
    (tmp_path / "old.json").write_text(json.dumps(old))
    (tmp_path / "bad.json").write_text("{")
    docs = snapshots.read_documents(spark, str(tmp_path))
    assert {r.state for r in snapshots.guarded(docs).collect()} == {"ok", "invalid"}
    h = snapshots.headers(docs).first()
    assert (h.slot, h.threshold_pct, h.benchmark, h.benchmark_price, h.declared_count, h.stock_count) == ("open", 0.5, "IDX", 7000.0, 3.0, 2)
    s = snapshots.stocks(docs)
    assert s.orderBy("place").first().symbol == "BBB" and s.orderBy("place").first().target_return_pct is None and snapshots.repeated_symbols(s).first().times == 2
    md = spark.createDataFrame([("m", "Overall accuracy: 0.875\nCoverage 88.9 %\nTarget MAE: 0.8125\n7 of 8 symbols")], "path string, text string")
    r = snapshots.verification_text(md).first()
    assert (r.accuracy_pct, r.coverage_pct, r.target_mae, r.correct, r.evaluated) == (87.5, 88.9, 0.8125, 7.0, 8.0)


def test_health_levels(spark):
    good = dict(forecast_state="ok", forecast_age_seconds=10.0, declared_count=1, stock_count=1, stale_quotes=0, missing_quote_ages=0, verification_state="ok", verification_age_seconds=1.0, evaluated=5, archive_state="ok", bad_json=0, bad_schema=0, found_slots=["open", "break", "close"], manifest_state="ok", unavailable_sources=0)
    schema = "forecast_state string, forecast_age_seconds double, declared_count int, stock_count int, stale_quotes int, missing_quote_ages int, verification_state string, verification_age_seconds double, evaluated int, archive_state string, bad_json int, bad_schema int, found_slots array<string>, manifest_state string, unavailable_sources int"
    run = lambda **c: health.issues(spark.createDataFrame([tuple({**good, **c}.values())], schema)).first()
    assert run().status == "healthy"
    assert run(forecast_age_seconds=1e6).status == "warning" and run(declared_count=2).status == "error"
    assert [i.code for i in run(found_slots=["open"], manifest_state="mismatch").issues] == ["CHECKPOINT_SLOTS_MISSING", "ARCHIVE_MANIFEST_INVALID"]


def test_feeds_and_http_retries(spark):
    xml = "<rss><item><title><![CDATA[A & B]]></title><link>https://x/1</link><source url='u'>Paper &amp; Co</source></item><item><title></title><link>https://x/2</link></item><item><title>C</title><link>http://x/3</link></item></rss>"
    r = feeds.rss_items(spark.createDataFrame([("f", xml)], "feed string, xml string")).collect()
    assert [(i.title, i.url, i.publisher) for i in r] == [("A & B", "https://x/1", "Paper & Co")]
    calls = []

    def flaky(url, timeout):
        calls.append(url)
        if len(calls) == 1:
            raise TimeoutError("slow")
        return "ok"

    assert quotes.with_retries(flaky, "u") == ("ok", None, 2)
    assert not quotes.retriable(type("E", (Exception,), {"code": 404})()) and quotes.retriable(type("E", (Exception,), {"code": 503})())
    spark.dataSource.register(quotes.HttpSource)
    got = spark.read.format("tidemark_http").option("urls", "a\nb").option("fetch", "posixpath:join").load().orderBy("url").collect()
    assert [r.url for r in got] == ["a", "b"] and all(r.error for r in got)


def test_portfolio_with_a_missing_price_has_no_total(spark):
    p = spark.createDataFrame([("A", 2, 10.0), ("B", 1, 5.0)], "symbol string, lots int, average_cost double")
    q = spark.createDataFrame([("A", 11.0)], "symbol string, price double")
    rows = {r.symbol: r for r in views.portfolio(p, q).collect()}
    assert rows["A"].value == 2200 and rows["A"].pnl_pct == pytest.approx(10) and rows["A"].weight_pct is None and rows["B"].value is None
    assert views.whole(views.portfolio(p, q), []).first().value is None


def test_rounding_as_in_sql(spark):
    import duckdb

    values = [8.0046875, -8.0046875, 1.0000005, 0.0078125, 2.5e-7, -5e-7, 1e300, 1.7e308, 0.0, 123456789.1234565, float("inf"), float("-inf"), float("nan"), None]
    values += [round(i / 128 + i % 7, 7) for i in range(200)] + [a / b - 1 for a in (57.63, 12.34, 0.01) for b in (6.4, 12.8, 0.64, 3.2)]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", V.round6(F.col("v")).alias("six"), V.rounded_to("v", 5).alias("five")).orderBy("i").collect()
    want = duckdb.connect().execute("SELECT list_transform(?::DOUBLE[], lambda v: round(v, 6)), list_transform(?::DOUBLE[], lambda v: round(v, 5))", [values, values]).fetchone()
    shown = lambda v: None if v is None else repr(v + 0.0)
    assert [[shown(r.six) for r in rows], [shown(r.five) for r in rows]] == [[shown(v) for v in w] for w in want]
