"""Text quality: random-indexing word vectors, pooled per document, scored by a two-layer network in numpy."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text
from .wordhash import BY_KIND, Words

#: Words are hashed to so many vectors of so many dimensions; each index vector has ``ONES`` entries of +1 or -1.
VOCABULARY, DIMENSIONS, ONES, REACH = 1 << 15, 32, 4, 2
#: At most so many labelled rows are learned from: those with the least hash of their id.
TRAIN_ROWS = 20_000
_BLOCK = 512


def index_vectors(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each word's index vector."""
    rng = np.random.default_rng(seed)
    places = rng.random((VOCABULARY, DIMENSIONS)).argsort(1)[:, :ONES]
    return places.astype(np.int64), rng.choice(np.array([-1.0, 1.0]), (VOCABULARY, ONES))


def _buckets(words: Words) -> np.ndarray:
    return (words.hash >> np.uint64(64 - 15)).astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Each word's vector: the sum of the index vectors of words within ``REACH`` places of it, over all documents.

    Each task adds up its part of the corpus in one table of fixed size; the tables are added block by block.
    """

    def gather(batches):
        places, signs = index_vectors()
        total = np.zeros(VOCABULARY * DIMENSIONS)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                words = Words(batch.column(0).slice(start, 1000), BY_KIND)
                word, text = _buckets(words), words.text_of_word()
                for k in range(1, REACH + 1):
                    near = text[k:] == text[:-k]
                    a, b = word[:-k][near], word[k:][near]
                    for one, other in ((a, b), (b, a)):
                        for j in range(ONES):
                            total += np.bincount(one * DIMENSIONS + places[other, j], signs[other, j], VOCABULARY * DIMENSIONS)
        parts = total.astype("<i8").reshape(-1, _BLOCK * DIMENSIONS)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), "<i8") for b in table["sums"])
        return pa.table({"block": table["block"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, sums binary"
    parts = docs.select("text").mapInArrow(gather, schema).groupBy("block").applyInArrow(add, schema).collect()
    table = np.zeros((VOCABULARY // _BLOCK, _BLOCK * DIMENSIONS))
    for block, sums in parts:
        table[block] = np.frombuffer(sums, "<i8")
    table = table.reshape(VOCABULARY, DIMENSIONS)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: mean and deviation of its word vectors, its length, and the share of distinct words."""
    words = Words(texts, BY_KIND)
    word, n = _buckets(words), np.diff(words.first_word)
    out = np.zeros((len(n), 2 * DIMENSIONS + 3), np.float32)
    full = np.flatnonzero(n)
    for t in full:
        own = vectors[word[words.first_word[t] : words.first_word[t + 1]]]
        mean = own.mean(0)
        out[t, :DIMENSIONS] = mean
        out[t, DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(np.einsum("ij,ij->j", own, own) / len(own) - mean * mean, 0))
    if len(full):
        pairs = np.sort(words.text_of_word() * VOCABULARY + word)
        distinct = pairs[np.append(True, pairs[1:] != pairs[:-1])] // VOCABULARY
        out[full, -2] = np.bincount(distinct, minlength=len(n))[full] / n[full]
        out[full, -1] = np.bincount(words.text_of_word(), words.ends - words.starts, minlength=len(n))[full] / n[full] / 10
    out[:, -3] = np.log1p(n) / 10
    return out


class Network:
    """Two layers, trained by Adam on logistic loss, and a temperature fitted on rows kept aside."""

    def fit(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        z = (x - self.mean) / self.scale
        aside = np.arange(len(z)) % 5 == 4
        own, target = z[~aside], y[~aside]
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for epoch in range(epochs if len(own) else 0):
            order = rng.permutation(len(own))
            for i in range(0, len(own), batch):
                a, b = own[order[i : i + batch]], target[order[i : i + batch]]
                h = np.tanh(a @ p[0] + p[1])
                d = (_sigmoid(h @ p[2] + p[3]) - b) / len(a)
                dh = np.outer(d, p[2]) * (1 - h * h)
                t += 1
                step = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
                for k, g in enumerate([a.T @ dh + decay * p[0], dh.sum(0), h.T @ d + decay * p[2], np.array([d.sum()])]):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if aside.any():
            logit, truth = self.logit(x[aside]), y[aside]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
            loss = [np.mean(np.logaddexp(0, logit / g) - truth * logit / g) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def held_out(doc_id: int | None) -> bool:
    """Whether labels of this row are kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def sampled_labels(labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids that may be learned from, those with the least hash: (label_id, y)."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("label_id"), F.col(label).cast("int").alias("y")).where("label_id is not null and y is not null")
    open_ = known.where(F.pmod(F.crc32(F.col("label_id").cast("string").cast("binary")), F.lit(4)) != 2)
    return open_.groupBy("label_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("label_id"), "label_id").limit(rows)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The calibrated probability that a text is of good quality, for every row of ``docs``.

    Word vectors come from all documents. The network learns from at most ``train_rows`` labelled documents (a bounded
    sample, broadcast by its bound), none of them held out. Only the text goes into a score.

    Returns doc_id, held_out, score, predicted. Null or empty text is scored from its empty features. Without labels
    every score comes from the untrained network. Repeated rows get equal scores. A null id is not held out. An empty
    table gives no rows; other columns are ignored.
    """
    rows = id_and_text(docs, id_col, text_col)
    vectors = word_vectors(rows)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(vectors)
    marked = F.broadcast(sampled_labels(labels, label, train_rows))
    sample = rows.join(marked, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y")

    def features(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.tobytes() for f in pooled(batch.column(1), shared.value)], pa.binary()), batch.column(2)], names=["doc_id", "x", "y"])

    train = sorted((r[0], r[1], r[2]) for r in sample.mapInArrow(features, "doc_id bigint, x binary, y int").collect())
    x = np.array([np.frombuffer(r[1], np.float32) for r in train]).reshape(len(train), 2 * DIMENSIONS + 3)
    network = Network().fit(x, np.array([r[2] for r in train]))

    def score(batches):
        TaskContext.get()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                s = network.score(pooled(part.column(1), shared.value))
                aside = [held_out(i) for i in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(aside, pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int")
