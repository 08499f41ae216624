"""Model comparison, callbacks, charts, health from documents, reports and the command line, by hand and by brute force."""

import inspect
import io
import json
import os
import random
import time
import uuid
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark import __main__ as command
from tidemark.functions import values as V
from tidemark.operators import calibration, charts, comparison, contract, crosssection, evaluation, folds, health, nested, regime_reports, sentiment
from tidemark.sources import feeds, published, quotes, shared, snapshots
from tidemark.streaming import ticks, verification

T0 = datetime(2026, 1, 5)


def rows_of(spark, n=60, seed=3):
    rng = random.Random(seed)
    rows = [(f"r{i}", T0 + timedelta(hours=i), 3600.0, rng.choice(["UP", "FLAT", "DOWN"]), rng.uniform(-1, 1), rng.uniform(-1, 1), "calm") for i in range(n)]
    return spark.createDataFrame(rows, "id string, as_of timestamp_ntz, horizon_seconds double, actual string, x double, target double, regime string")


@pytest.mark.parametrize("mode", ["rolling", "expanding"])
def test_membership_is_that_of_the_boundaries(spark, mode):
    rng = random.Random(1)
    for _ in range(3):
        hours = lambda a, b: rng.randrange(a, b) * 1800
        plan = folds.FoldPlan(T0 + timedelta(hours=9), hours(1, 9), hours(1, 9), step_seconds=hours(1, 9), mode=mode, train_seconds=hours(4, 20) if mode == "rolling" else None, purge_seconds=hours(0, 3), embargo_seconds=hours(0, 3))
        rows = [(f"r{i}", T0 + timedelta(minutes=17 * i), float(rng.randrange(1, 9) * 900)) for i in range(150)]
        latest = rows[-1][1]
        expect = set()
        for fold, start, cutoff, end, validation_end, test_start, test_end in plan.boundaries(latest):
            for i, at, horizon in rows:
                done = at + timedelta(seconds=horizon)
                if (start is None or at >= start) and at < cutoff:
                    expect.add((fold, "train", i, done <= end))
                elif end <= at < validation_end:
                    expect.add((fold, "validation", i, done <= test_start))
                elif test_start <= at < test_end:
                    expect.add((fold, "test", i, True))
        found = folds.membership(spark.createDataFrame(rows, "id string, as_of timestamp_ntz, horizon_seconds double"), plan, latest)
        assert {(r.fold, r.split, r.id, r.kept) for r in found.collect()} == expect and expect


def members(spark):
    plan = folds.FoldPlan(T0 + timedelta(hours=20), 8 * 3600, 8 * 3600, step_seconds=8 * 3600)
    rows = rows_of(spark)
    return folds.membership(rows, plan, T0 + timedelta(hours=59))


def test_models_are_compared_on_the_same_rows(spark):
    m = members(spark)

    def contrary(train, rows):
        assert "actual" not in rows.columns and "target" not in rows.columns
        return rows.withColumn("class", V.classify(-F.col("x"), 0.1))

    specs = [{"kind": "always_flat"}, {"kind": "logistic", "features": ["x"], "iterations": 50}, {"kind": "ridge", "features": ["x"]}, {"kind": contrary}]
    out = {r.model: r for r in comparison.compare(m, specs).collect()}
    tests = m.where("split = 'test' and kept").count()
    assert set(out) == {"always_flat", "logistic", "ridge", "contrary"} and all(r.eligible == r.evaluated == tests for r in out.values())
    with pytest.raises(ValueError):
        comparison.compare(m, [{"kind": "oracle"}])
    with pytest.raises(ValueError):
        comparison.compare(m, [{"kind": "ridge", "features": ["x"]}, {"kind": "ridge", "features": ["x"]}])


def test_a_train_set_is_fitted_once(spark):
    rows = [(f, "train", f"i{i}") for f in (0, 1, 2) for i in range(4 if f < 2 else 5)] + [(f, "test", f"t{f}") for f in (0, 1, 2)]
    m = spark.createDataFrame(rows, "fold int, split string, id string").withColumns({"kept": F.lit(True), "actual": F.lit("UP"), "regime": F.lit("r")})
    assert {r.fold: r.fit_fold for r in comparison.train_sets(m).collect()} == {0: 0, 1: 0, 2: 2}
    assert {r.fold: r.predicted for r in comparison.predictions(m, [{"kind": "majority"}]).collect()} == {0: "UP", 1: "UP", 2: "UP"}


def test_a_source_of_probabilities_must_give_all(spark):
    m = members(spark)
    with pytest.raises(ValueError):
        calibration.sourced(m, lambda train, rows: rows)
    third = lambda train, rows: rows.withColumns({c: F.lit(1 / 3) for c in ("p_up", "p_flat", "p_down")})
    r = calibration.scores(calibration.sourced(m, third, ("test",)), []).first()
    assert r.evaluated == r.eligible and abs(r.brier_score - 2 / 3) < 1e-9


def test_calibrators_and_their_report(spark):
    rows = spark.createDataFrame([("h", 0.5, 0.3, 0.2, "UP"), ("h", 0.5, 0.3, 0.2, "DOWN"), ("h", 0.9, 0.3, 0.2, "UP"), ("h", 0.2, 0.3, 0.5, "SIDE")], "horizon string, p_up double, p_flat double, p_down double, actual string")
    c = calibration.fit_counts(rows, ["horizon"]).first()
    assert (c.eligible_rows, c.fitted_rows, c.rejected_rows) == (4, 2, 2)
    r = calibration.report(rows, ["horizon"]).first()
    assert r.evaluated == 2 and r.flat_slope is None and None not in (r.up_slope, r.up_intercept, r.down_slope)


def test_charts(spark):
    good = {"chart": {"error": None, "result": [{"meta": {"regularMarketTime": 1704067200}, "timestamp": [10, 20, 20, 30, None, 40], "indicators": {"quote": [{"open": [1, 2, 2.5, None, 1, 0], "high": [1, 5, 2, 1, 1, 1], "low": [1, 3, 1, 1, 1, 1], "close": [1, 4, 3, 1, 1, 1], "volume": [None, -1, 7, 1, 1, 1]}]}}]}}
    rows = [("A", json.dumps(good), None), ("B", '{"chart": {"result": []}}', None), ("C", None, "HTTPError: 500"), ("D", "no json", None), ("E", '{"chart": {"result": [{"meta": {}}]}}', None)]
    p = spark.createDataFrame(rows, "symbol string, text string, error string")
    got = [tuple(r) for r in charts.bars(p).orderBy("observed_at").collect()]
    assert got == [("A", 10, 1.0, 1.0, 1.0, 1.0, 0.0), ("A", 20, 2.5, 3.0, 1.0, 3.0, 7.0)]
    q = {r.symbol: r for r in charts.quotes(p).collect()}
    assert q["A"].price == 1.0 and q["A"].error is None and [q[s].error for s in "BCDE"] == ["no chart data", "HTTPError: 500", "no chart data", "no latest price"]
    context = charts.market_context(charts.bars(p)).first()
    assert (context.tone, context.observations) == ("positive", 2) and context.change_pct == pytest.approx(200)
    many = ",".join(f"S{i}" for i in range(101))
    r = charts.quote_requests(spark.createDataFrame([(1, "bbca, BBCA.JK"), (2, many), (3, None), (4, "a!b")], "request int, symbols string")).orderBy("request").collect()
    assert [(x.symbols, x.error) for x in r] == [(["BBCA"], None), (None, "too many symbols"), (None, "no symbols"), (None, "symbol")]


def test_health_of_missing_and_odd_documents(spark):
    sites = spark.createDataFrame([("a",), ("b",)], "site string")
    none = spark.createDataFrame([], "site string, text string")
    now = F.lit("2026-01-05T00:00:00Z").cast("timestamp")
    odd = spark.createDataFrame([("a", '{"as_of": 7, "universe_count": "2", "stocks": 5}'), ("b", "[]")], "site string, text string")
    out = {r.site: [i.code for i in r.issues] for r in health.issues(health.facts(sites, now, odd, none, manifests=sites.withColumn("state", F.lit("ok")))).collect()}
    assert out["a"][-2:] == ["ARCHIVE_NOT_SUPPLIED", "ARCHIVE_DIR_REQUIRED"] and "UNIVERSE_COUNT_MISMATCH" in out["a"] and "VERIFICATION_MISSING" in out["b"]
    empty = {r.site: [i.code for i in r.issues] for r in health.issues(health.facts(sites, now, none, none, none)).collect()}
    assert empty["a"] == ["FORECAST_MISSING", "VERIFICATION_MISSING", "ARCHIVE_MISSING"]


def test_local_report_without_data_and_other_horizons(spark):
    points = spark.createDataFrame([("r", "market", T0 + timedelta(days=i), float(100 + i), i) for i in range(4)], "report string, series string, observed_at timestamp_ntz, value double, _ord int")
    breadth = spark.createDataFrame([], "report string, observed_at timestamp_ntz, advancing double, declining double, unchanged double, _ord int")
    events = spark.createDataFrame([], "report string, released_at timestamp_ntz")
    r = regime_reports.local_report(points, breadth, events, F.lit("2026-01-07").cast("timestamp_ntz"), horizons=(1, 2), windows=(2,)).first()
    assert r.market_latest == 102.0 and r.market_trend_2 == pytest.approx(0.02) and r.market_trend_signal == 1
    assert (r.score, r.available_signals, r.regime) == (1, 1, None)
    with pytest.raises(ValueError):
        regime_reports.local_report(points, breadth, events, F.lit(None), horizons=(1, 1))


def test_sentiment_report_joins_peers_to_the_sector(spark):
    schema = "_ord int, title string, url string, publisher string, published_at timestamp, fetched_at timestamp, summary string, description string, source_tier string, event_type string"
    at = datetime(2026, 1, 4)
    make = lambda *titles: spark.createDataFrame([(i, t, f"https://x.org/{t.replace(' ', '-')}", "Paper", at, at, None, None, None, None) for i, t in enumerate(titles)], schema)
    layers, kept = sentiment.report({"company": make("profit growth"), "sector": make("a", "b"), "peer": make("b", "c")}, F.lit("2026-01-05").cast("timestamp"))
    got = {r.layer: (r.status, r.article_count) for r in layers.collect()}
    assert got == {"company": ("available", 1), "sector": ("available", 3), "indonesia_market": ("unavailable", 0), "global": ("unavailable", 0)}
    assert kept.where("layer = 'sector' and title = 'b'").first()._ord.part == 0
    with pytest.raises(ValueError):
        sentiment.report({"other": make("a")}, F.lit(None))


def test_calendar_of_long_closures(spark):
    closed = [date(2026, 3, 2) + timedelta(days=i) for i in range(60)]
    days = [date(2026, 1, 1) + timedelta(days=i) for i in range(200)]
    is_open = lambda d: d.weekday() < 5 and d not in closed
    following = lambda d: next(x for x in (d + timedelta(days=i) for i in range(1, 99)) if is_open(x))
    frame = lambda ds: spark.createDataFrame([(d,) for d in ds], "day date")
    for holidays in (closed, []):
        closed = holidays
        got = {r.day: (r.is_trading_day, r.next_trading_day) for r in contract.trading_days(frame(days), frame(holidays)).collect()}
        assert got == {d: (is_open(d), following(d)) for d in days}


def test_first_of_several_places_and_the_command_line(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "one.json").write_text('{"archive_metadata": {"slot": "open"}}')
    found = snapshots.first_available(spark, [str(tmp_path / "a"), str(tmp_path / "b")], "*.json")
    assert found.count() == 1 and snapshots.first_available(spark, [str(tmp_path / "a")]) is None
    assert [tuple(r) for r in snapshots.slots(found).collect()] == [("open", 1, 0)]
    out = io.StringIO()
    assert command.validate(spark, str(tmp_path / "b"), out) == 1 and "stocks must be a non-empty array" in out.getvalue()
    assert command.validate(spark, str(tmp_path / "none"), io.StringIO()) == 2
    out = io.StringIO()
    assert command.validate(spark, "-", out, io.StringIO("[1")) == 1 and out.getvalue() == "-: root must be an object\n"


def test_missing_times_have_no_age(spark):
    row = spark.range(1).select(V.age_seconds(F.lit(None).cast("timestamp"), F.current_timestamp()).alias("a")).first()
    assert row.a is None


def test_shared_folder(spark):
    assert shared.shared_path(spark, "x") != shared.shared_path(spark, "x")


def test_nested_documents_by_hand(spark):
    texts = ['{"b": 1, "a": {"B": 2, "c": [3, {"A-b": null}]}, "ab": {"x": "[1]"}}', '[{"k": "v"}, 5]', "7", "no json", None, "{}", '{"z": {"z": {"z": {"Z": true}}}, "y": {}}']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    got = {(r.doc, tuple(r.place)): (r.key, r.value) for r in nested.scalars(docs).collect()}
    assert got == {(0, (0,)): ("b", "1"), (0, (1, 0)): ("B", "2"), (0, (1, 1, 0)): ("0", "3"), (0, (1, 1, 1, 0)): ("A-b", None), (0, (2, 0)): ("x", "[1]"), (1, (0, 0)): ("k", "v"), (1, (1,)): ("1", "5"), (6, (0, 0, 0, 0)): ("Z", "true")}
    flat = {(r.doc, r.name): r.value for r in nested.flattened(docs).collect()}
    assert flat == {(0, "b"): "2", (0, "0"): "3", (0, "ab"): None, (0, "x"): "[1]", (1, "k"): "v", (1, "1"): "5", (6, "z"): "true"}
    with pytest.raises(ValueError):
        nested.scalars(docs, most_levels=2)


def test_repeated_rows_stop_an_evaluation(spark):
    rows = [("p", "A", "UP", 1.0, 1.0, 1.0), ("p", "B", "UP", 1.0, 1.0, 1.0), ("q", "A", "DOWN", 1.0, 1.0, 1.0)]
    schema = "pair string, symbol string, forecast string, baseline double, target_return_pct double, threshold_pct double"
    forecasts, outcomes = spark.createDataFrame(rows, schema), spark.createDataFrame(rows, schema).select("pair", "symbol", "baseline")
    assert evaluation.settled(forecasts, outcomes).count() == 3
    for a, b in ((forecasts.union(forecasts.limit(1)), outcomes), (forecasts, outcomes.union(outcomes.limit(1)))):
        with pytest.raises(Exception, match="repeated pair, symbol: p, A"):
            evaluation.settled(a, b).collect()
    m = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-02"), (None, "2024-01-03")], "id string, t string").select("id", F.col("t").cast("timestamp_ntz").alias("as_of"))
    plan = folds.FoldPlan(datetime(2024, 1, 2), 3600, 3600, fold_count=1)
    assert folds.membership(m, plan, datetime(2024, 1, 9), unique=("as_of",)).count() == 2
    with pytest.raises(Exception, match="repeated id: a"):
        folds.membership(m, plan, datetime(2024, 1, 9), unique=("id",)).collect()


def test_counts_of_an_evaluation_cost_no_job(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("v"))
    seen = Observation("counts")
    spark.sparkContext.setJobGroup("counted", "")
    try:
        kept = evaluation.counted(rows, seen, F.col("v").isNull()).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(kept) == 85 and seen.get == {"eligible": 100, "rejected": 15, "evaluated": 85}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) == 1


def test_strength_needs_a_later_end(spark):
    none = spark.createDataFrame([], "symbol string, price double, volume double")
    with pytest.raises(ValueError):
        crosssection.strength(none, none, "A", none, datetime(2024, 1, 2), datetime(2024, 1, 2))


def fetched(url, timeout):
    """Answers with a chart, and keeps a file for each request that runs, so that tests see how many do at once."""
    folder = os.environ["TIDEMARK_TEST_FETCHED"]
    name = f"{folder}/{uuid.uuid4().hex}"
    with open(name, "w") as f:
        f.write(url)
    at_once = sum(n.endswith("-now") for n in os.listdir(folder)) + 1
    open(f"{name}-now", "w").close()
    time.sleep(0.2)
    os.rename(f"{name}-now", f"{name}-{at_once}")
    if "BAD" in url:
        raise OSError("gone")
    return '{"chart": {"result": [{"meta": {}, "timestamp": [10], "indicators": {"quote": [{"open": [1], "high": [2], "low": [1], "close": [2], "volume": [3]}]}}]}}'


@pytest.mark.parametrize("pool", [1, 4])
def test_charts_are_asked_for_by_filters_and_few_at_once(spark, tmp_path, monkeypatch, pool):
    folder = tmp_path / "asked"
    folder.mkdir()
    module = tmp_path / f"tidemark_test_fetch_{pool}.py"
    module.write_text("import os, time, uuid\n" + inspect.getsource(fetched).replace('os.environ["TIDEMARK_TEST_FETCHED"]', repr(str(folder))))
    spark.sparkContext.addPyFile(str(module))
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.dataSource.register(quotes.ChartSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    asked = [*(f"S{i}" for i in range(20)), "BAD", "lower"]
    loaded = lambda: spark.read.format("tidemark_charts").option("address", "http://x/{symbol}?r={range}&i={interval}").option("fetch", f"tidemark_test_fetch_{pool}:fetched").option("pool", pool).load()
    got = loaded().where(F.col("symbol").isin(*asked) & F.col("range").isin("5d", "7d") & (F.col("interval") == "1h"))
    rows = got.collect()
    told = {(r.symbol, r.range): r.error for r in rows}
    assert len(rows) == 2 * len(asked) and told["S3", "5d"] is None and told["S3", "7d"] == "range" and told["lower", "5d"] == "symbol" and "gone" in told["BAD", "5d"]
    files = [n for n in os.listdir(folder) if "-" in n]
    assert 21 <= len(files) <= 22 and max(int(n.split("-")[1]) for n in files) <= quotes.CONCURRENT  # the bad one is tried twice; none for a range it doesn't know
    assert charts.bars(loaded().where(F.col("symbol").isin("S1", "S2") & (F.col("range") == "5d"))).count() == 2
    assert loaded().count() == 0 and [r.error for r in loaded().where("symbol = 'no such'").collect()] == ["symbol"]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_versions_are_published_whole(spark, tmp_path):
    spark.dataSource.register(published.PublishedSource)
    path = str(tmp_path / "report")
    rows = spark.range(50).select("id", F.struct(F.lit("z").alias("b"), (F.col("id") / 4).alias("a")).alias("s"), F.array("id").alias("l"), F.when(F.col("id") > 3, F.lit("é")).alias("t")).repartition(3)
    save = lambda df: df.write.format("tidemark_archive").mode("append").save(path)
    load = lambda: spark.read.format("tidemark_archive").load(path)
    save(rows)
    first = published.manifest_of(path)
    assert first["rows"] == 50 and sorted(map(str, load().collect())) == sorted(map(str, rows.collect()))
    line = next(open(f"{path}/{p['name']}").readline() for p in first["parts"] if p["rows"])
    assert line.startswith('{"id":') and '"s":{"a":' in line
    for bad in (F.when(F.col("id") == 49, F.raise_error("stop").cast("double")).otherwise(0.0), F.when(F.col("id") == 49, float("nan")).otherwise(0.0)):
        with pytest.raises(Exception, match="stop|JSON"):
            save(spark.range(50).repartition(3).select("id", bad.alias("x")))
        assert published.manifest_of(path) == first and load().count() == 50
    save(spark.range(2).select(F.col("id").alias("n")))
    assert [r.n for r in load().orderBy("n").collect()] == [0, 1]
    save(spark.range(0).select(F.col("id").alias("n")))
    assert load().count() == 0 and load().columns == ["n"]
    save(rows)
    part = next(p for p in published.manifest_of(path)["parts"] if p["rows"])
    with open(f"{path}/{part['name']}", "a") as f:
        f.write("{}\n")
    with pytest.raises(Exception, match="not what was published"):
        load().collect()


def test_feeds_by_the_xml_reader(spark):
    item = lambda t, u="https://a/b", more="": f"<item><title>{t}</title><link>{u}</link>{more}</item>"
    whole = "<rss xmlns:m='http://m'><channel><title>f</title>{}</channel></rss>"
    texts = {
        "a": whole.format(item("<![CDATA[<i>x</i> & y]]>", more="<m:title>no</m:title><source url='u'> P  Q </source><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate>") + item("two &amp;&#32;\n three", more="<source>R</source><pubDate>soon</pubDate>") + item("no link", "http://a") + item(" ")),
        "b": whole.format("".join(item(f"t{i}", more=f"<pubDate>{i + 1} Jan 2024 00:00:00 +0100</pubDate>") for i in range(12))),
        "broken": whole.format(item("x"))[:-9], "none": None, "empty": whole.format(""), "other": "<html><body/></html>", "text": "plain",
    }
    df = spark.createDataFrame(list(texts.items()), "feed string, xml string")
    assert {r.feed: r.status for r in feeds.parsed_feeds(df).collect()} == {"a": "available", "b": "available", "broken": "broken", "none": "missing", "empty": "empty", "other": "broken", "text": "broken"}
    got = [(r.feed, r._ord, r.title, r.publisher, r.published_at) for r in feeds.feed_items(df).orderBy("feed", "_ord").collect()]
    assert got[:2] == [("a", 0, "<i>x</i> & y", "P Q", datetime(2024, 1, 2, 3, 4, 5)), ("a", 1, "two & three", "R", None)]
    assert [r[:3] for r in got[2:]] == [("b", i, f"t{i}") for i in range(8)] and got[2][4] == datetime(2023, 12, 31, 23)
    assert [(r.feed, r.title) for r in feeds.newest(feeds.feed_items(df), 3).collect()] == [("b", "t7"), ("b", "t6"), ("b", "t5")]


def test_forecasts_wait_for_their_checkpoints_over_a_restart(spark, tmp_path):
    day = lambda n: datetime(2024, 1, 1 + n)
    f_schema = "pair timestamp_ntz, symbol string, forecast string, baseline double, target_return_pct double, threshold_pct double, at timestamp_ntz"
    add = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    forecast = lambda n, s: (day(n), s, "UP", 10.0, 1.0, 1.0, day(n))
    outcome = lambda n, s: (day(n), s, 11.0, day(n + 1))
    stream = lambda name: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{name}").schema).parquet(f"{tmp_path}/{name}")

    def run():
        with verification.rocksdb(spark):
            ticks.run_to_table(verification.waiting(stream("f"), stream("o"), 2 * 86_400), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        return {(r.pair.day - 1, r.symbol): r.state for r in verification.verdicts(spark.read.parquet(f"{tmp_path}/out")).collect()}

    add("f", [forecast(0, "A"), forecast(0, "B"), forecast(1, "A")], f_schema)
    add("o", [outcome(0, "A"), outcome(1, "C")], "pair timestamp_ntz, symbol string, baseline double, at timestamp_ntz")
    assert run() == {(0, "A"): "evaluated"}  # B's time is not up; C's outcome came before its forecast
    add("f", [(*forecast(1, "C")[:6], day(2)), forecast(0, "D")], f_schema)  # D is behind the watermark
    add("o", [outcome(1, "A")], "pair timestamp_ntz, symbol string, baseline double, at timestamp_ntz")
    assert run() == {(0, "A"): "evaluated", (1, "A"): "evaluated", (1, "C"): "evaluated"}
    add("f", [forecast(9, "A")], f_schema)
    assert run() == {(0, "A"): "evaluated", (1, "A"): "evaluated", (1, "C"): "evaluated", (0, "B"): "missing"}
    add("f", [forecast(20, "Z")], f_schema)
    assert run()[9, "A"] == "missing"


def test_verification_calls_no_python_for_its_keys(spark, tmp_path):
    day = datetime(2024, 1, 1)
    spark.createDataFrame([(day, "A", "UP", 10.0, 1.0, 1.0, day)], "pair timestamp_ntz, symbol string, forecast string, baseline double, target_return_pct double, threshold_pct double, at timestamp_ntz").write.parquet(f"{tmp_path}/f")
    spark.createDataFrame([(day, "A", 11.0, day)], "pair timestamp_ntz, symbol string, baseline double, at timestamp_ntz").write.parquet(f"{tmp_path}/o")
    stream = lambda name: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{name}").schema).parquet(f"{tmp_path}/{name}")
    joined = verification.waiting(stream("f"), stream("o"), 2 * 86_400)
    plan = joined._jdf.queryExecution().analyzed().toString()
    assert "Join LeftOuter" in plan and not any(word in plan for word in ("TransformWithState", "Pandas", "Python", "PySpark"))
