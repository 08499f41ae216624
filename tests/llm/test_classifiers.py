"""Quality and toxicity: held-out accuracy, calibration, and odd tables."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm.common import documents, labels
from tidemark.llm.quality import DIMENSIONS, REACH, VOCABULARY, Network, held_out, index_vectors, pooled, quality_scores, sampled_labels, word_vectors
from tidemark.llm.toxicity import CumulativeLink, drop_toxic, learned, toxicity
from tidemark.llm.toxicity import _places as toxicity_places
from tidemark.llm.toxicity import features as toxicity_features
from tidemark.llm.wordhash import ALONE, BY_KIND, LETTERS, LOWERED, Words

from .fixtures import collected, empty, nasty, rows


def auc(score, truth):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(1, len(score) + 1)
    pos = truth == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def judged(spark, sf_dir, frame, score, label):
    known = {r.doc_id: r[label] for r in labels(spark, sf_dir).select("doc_id", label).collect() if r[label] is not None}
    found = [(r[score], known[r.doc_id], r) for r in frame.collect() if r.held_out and r.doc_id in known]
    return np.array([f[0] for f in found]), np.array([f[1] for f in found])


def test_quality_on_held_out_rows(spark, small):
    s, y = judged(spark, small, quality_scores(documents(spark, small), labels(spark, small)), "score", "quality")
    assert len(y) > 50 and auc(s, y) > 0.9
    assert ((s >= 0) & (s <= 1)).all() and abs(s.mean() - y.mean()) < 0.15


def test_toxicity_on_held_out_rows(spark, medium):
    s, y = judged(spark, medium, toxicity(documents(spark, medium), labels(spark, medium)), "p_mild", "toxic")
    assert len(y) > 500 and auc(s, y) > 0.9 and ((s >= 0.5) & (y == 0)).mean() < 0.01 and ((s >= 0.5) == (y == 1)).mean() > 0.9


def test_severity_is_consistent(spark, tiny):
    for r in toxicity(documents(spark, tiny), labels(spark, tiny)).collect():
        assert 0 <= r.p_severe <= r.p_mild <= 1 and abs(r.expected_severity - r.p_mild - r.p_severe) < 1e-9
        assert r.rejected == (r.p_mild >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_scores_do_not_depend_on_other_columns_or_order(spark, tiny):
    docs, marks = documents(spark, tiny), labels(spark, tiny)
    one = collected(quality_scores(docs, marks), "doc_id", "predicted")
    other = collected(quality_scores(docs.select("doc_id", "text").repartition(5), marks.repartition(3)), "doc_id", "predicted")
    assert one == other


def test_labels_of_held_out_rows_are_not_read(spark, small):
    held = {r.label_id for r in sampled_labels(labels(spark, small), "quality").collect()}
    assert held and not any(held_out(i) for i in held)


def test_odd_tables(spark):
    docs = nasty(spark)
    marks = spark.createDataFrame([(3, 1, 0, "t"), (3, 1, 0, "t"), (6, None, 1, "t"), (None, 1, 1, "t"), (9, 0, None, "t"), (999, 0, 1, "t"), (12, 0, 1, "t")], "doc_id bigint, quality int, toxic int, text string")
    for m in (marks, marks.limit(0)):
        q = quality_scores(docs, m).collect()
        t = toxicity(docs, m).collect()
        assert len(q) == len(t) == docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in q)
        assert not any(r.held_out for r in q if r.doc_id is None)
        kept = drop_toxic(docs, m)
        assert kept.schema == docs.schema and kept.count() == sum(not r.rejected for r in t)
    assert drop_toxic(docs, marks.limit(0)).count() == docs.count()
    assert quality_scores(empty(spark), marks).count() == toxicity(empty(spark), marks).count() == drop_toxic(empty(spark), marks).count() == 0


def test_network_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    net = Network().fit(x, y)
    assert ((net.score(x) >= 0.5) == y).mean() > 0.9 and 0.25 <= net.temperature <= 8


def test_cumulative_link_orders_its_thresholds_and_shares_weights():
    rng = np.random.default_rng(1)
    n = 3000
    on = rng.random((n, 3)) < 0.4
    latent = on @ np.array([2.0, 1.0, -1.0]) + rng.logistic(size=n) * 0.5
    grade = (latent > 1).astype(int) + (latent > 2.5).astype(int)
    row, column = np.nonzero(on)
    m = CumulativeLink().fit(row, column, 3, grade)
    assert m.thresholds[0] < m.thresholds[1] and m.weights[0] > m.weights[1] > 0 > m.weights[2]


def test_features_of_no_texts():
    from tidemark.llm.toxicity import features

    text, bucket, before, n = features(pa.array([], pa.string()))
    assert len(text) == len(bucket) == len(before) == len(n) == 0


def by_kind(text):
    """Words as runs of letters, runs of digits, and other characters one by one."""
    out, last = [], None
    for b in (text or "").encode():
        kind = int(BY_KIND[b])
        if kind and kind == last and kind != ALONE:
            out[-1] += bytes([b])
        elif kind:
            out.append(bytes([b]))
        last = kind
    return out


def bucket_of(word, classes=BY_KIND):
    words = Words(pa.array([word]), classes)
    assert len(words.hash) == 1
    return int(words.hash[0] >> np.uint64(49))


def test_word_vectors_and_pooling_by_brute_force(spark):
    """Random indexing word by word: every pair of places at most two apart adds one index vector."""
    known = [t for _, t in [(r[0], r[1]) for r in rows()] if len(t or "") < 3000]
    places, signs = index_vectors()
    table = np.zeros((VOCABULARY, DIMENSIONS))
    tokens = [[bucket_of(w) for w in by_kind(t)] for t in known]
    for own in tokens:
        for i, a in enumerate(own):
            for j in range(max(0, i - REACH), min(len(own), i + REACH + 1)):
                if i != j:
                    np.add.at(table[a], places[own[j]], signs[own[j]])
    expect = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    got = word_vectors(spark.createDataFrame([(t or "",) for t in known], "text string").repartition(3))
    assert np.abs(got - expect).max() < 1e-5
    features = pooled(pa.array([t or "" for t in known]), got)
    for f, own, text in zip(features, tokens, known, strict=True):
        held = got[own]
        assert abs(f[-3] - np.log1p(len(own)) / 10) < 1e-5
        if own:
            assert np.abs(f[:DIMENSIONS] - held.mean(0)).max() < 1e-4 and np.abs(f[DIMENSIONS : 2 * DIMENSIONS] - held.std(0)).max() < 1e-3
            assert abs(f[-2] - len(set(own)) / len(own)) < 1e-5 and abs(f[-1] - np.mean([len(w) for w in by_kind(text)]) / 10) < 1e-4


def test_scores_are_those_of_the_plain_network(spark, tiny):
    docs, marks = documents(spark, tiny), labels(spark, tiny)
    table = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    vectors = word_vectors(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    train = sorted((r.label_id, r.y) for r in sampled_labels(marks, "quality").collect() if r.label_id in table)
    x = pooled(pa.array([table[i] for i, _ in train]), vectors)
    net = Network().fit(x, np.array([y for _, y in train]))
    ids = sorted(table)
    z = (pooled(pa.array([table[i] for i in ids]), vectors).astype(float) - net.mean) / net.scale
    logit = np.tanh(z @ net.p[0] + net.p[1]) @ net.p[2] + net.p[3]
    expect = dict(zip(ids, 1 / (1 + np.exp(-logit / net.temperature)), strict=True))
    got = {r.doc_id: r.score for r in quality_scores(docs, marks).collect()}
    assert got.keys() == expect.keys() and max(abs(got[i] - expect[i]) for i in ids) < 1e-4


def test_feature_counts_by_brute_force(spark, tiny):
    """Each bucket's different words before it, in all texts and in toxic ones, text by text and word by word."""
    marks = {r.label_id: r.y for r in sampled_labels(labels(spark, tiny), "toxic").collect()}
    sample = [(r.doc_id, r.text or "", marks[r.doc_id]) for r in documents(spark, tiny).collect() if r.doc_id in marks][:60]
    all_, toxic = {}, {}
    for _, text, y in sample:
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        words, own = [], b""
        for b in [*low, 0]:
            if LETTERS[b]:
                own += bytes([b])
            elif own:
                words.append(own)
                own = b""
        last = None
        for w in words:
            hashes = Words(pa.array([w]), LETTERS, LOWERED).hash
            before = 0 if last is None else int(last >> np.uint64(32))
            last = hashes[0]
            buckets = {int(b) for b in features_of(w)}
            for b in buckets:
                all_.setdefault(b, set()).add((before, y))
                if y:
                    toxic.setdefault(b, set()).add(before)
    n, bad = toxicity_places(spark.createDataFrame(sample, "doc_id bigint, text string, y int").repartition(3))
    assert {b: int(n[b]) for b in np.flatnonzero(n)} == {b: len(v) for b, v in all_.items()}
    assert {b: int(bad[b]) for b in np.flatnonzero(bad)} == {b: len(v) for b, v in toxic.items()}


def features_of(word):
    """Buckets of a word and of its beginnings of 4 and 5 bytes, where it is longer."""
    _, bucket, _, _ = toxicity_features(pa.array([word], pa.binary()))
    assert len(bucket) == 1 + (len(word) > 4) + (len(word) > 5)
    return bucket


def test_severity_is_the_link_of_the_weights(spark, tiny):
    docs, marks = documents(spark, tiny), labels(spark, tiny)
    model = learned(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), marks)
    got = {r.doc_id: r for r in toxicity(docs, marks).collect()}
    for r in docs.select("doc_id", "text").collect():
        _, bucket, _, _ = toxicity_features(pa.array([r.text or ""]))
        s = model.weights[np.unique(bucket)].astype(float).sum()
        over = [1 / (1 + np.exp(t - s)) for t in model.thresholds]
        g = got[r.doc_id]
        assert abs(g.p_mild - over[0]) < 1e-5 and abs(g.p_severe - over[1]) < 1e-5 and abs(g.expected_severity - sum(over)) < 1e-5
        assert g.severity == int(np.argmax([1 - over[0], over[0] - over[1], over[1]]))


def test_cumulative_link_gradient_reaches_a_stationary_point():
    rng = np.random.default_rng(3)
    on = rng.random((400, 4)) < 0.5
    grade = np.clip((on @ np.array([2.0, 1.0, 0.5, -1.0]) + rng.logistic(size=400)).round().astype(int), 0, 2)
    row, column = np.nonzero(on)
    m = CumulativeLink(rounds=1500, rate=0.05, decay=0.0).fit(row, column, 4, grade)

    def loss(w, t):
        s = on @ w
        over = [np.ones(400), 1 / (1 + np.exp(t[0] - s)), 1 / (1 + np.exp(t[1] - s)), np.zeros(400)]
        return -np.log(np.choose(grade, over[:3]) - np.choose(grade, over[1:])).mean()

    best = loss(m.weights, m.thresholds)
    for k in range(4):
        for step in (-0.02, 0.02):
            w = m.weights.copy()
            w[k] += step
            assert loss(w, m.thresholds) > best
    for k in range(2):
        for step in (-0.02, 0.02):
            t = m.thresholds.copy()
            t[k] += step
            assert loss(m.weights, t) > best
