"""Toxicity: cumulative-link ordinal regression of severity grades on sparse text features.

Grades are 0 (clean), 1 (mild) and 2 (severe). Labels tell toxic from clean; a toxic training text is severe if it has
more different features that are a sign of toxicity than the median toxic text. Features are hashed lower-case
words and their beginnings of 4 and 5 bytes, present or not, so inflected forms share what they begin with. One weight
vector serves both thresholds: P(grade > k) is the logistic of (weights . features - threshold k).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_and_text
from .quality import TRAIN_ROWS, held_out, sampled_labels
from .wordhash import LETTERS, LOWERED, Words, byte_hashes, mix
from .wordhash import _LETTER as LETTER_HASH

BUCKETS = 1 << 20
GRADES = 3
#: Ranges of buckets by which features are counted.
RANGES = 64
#: Texts whose features are held at once.
SLICE = 200
#: Features that are learned from: those commoner in toxic texts by this likelihood ratio (G squared) at least.
ASSOCIATION = 30.0


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and bucket of all features, repeats included, 32 bits that tell the word before, and each text's words."""
    words = Words(texts, LETTERS, LOWERED)
    text, n = words.text_of_word(), words.ends - words.starts
    letters = LETTER_HASH[LOWERED]
    before = np.zeros(len(n), np.uint64)
    before[1:] = words.hash[:-1] >> np.uint64(32)
    before[words.first_word[:-1][words.first_word[:-1] < len(n)]] = 0
    found = [(text, words.hash, before)]
    for size in (4, 5):
        long = n >= size + 1
        start = words.starts[long]
        found.append((text[long], mix(byte_hashes(words.raw, letters, start, start + size) + np.uint64(size << 40)), before[long]))
    text, bucket, before = (np.concatenate(x) for x in zip(*found, strict=True))
    return text, (bucket >> np.uint64(44)).astype(np.int64), before.astype(np.int64), np.diff(words.first_word)


class CumulativeLink:
    """Ordinal regression with shared weights and ordered thresholds, fitted by Adam on the full likelihood."""

    def __init__(self, rounds: int = 300, rate: float = 0.1, decay: float = 1e-5):
        self.rounds, self.rate, self.decay = rounds, rate, decay

    def fit(self, row: np.ndarray, column: np.ndarray, width: int, grade: np.ndarray) -> CumulativeLink:
        rows = len(grade)
        p = [np.zeros(width), np.array([1.0]), np.zeros(1)]  # weights, first threshold, log of the step to the second
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for t in range(1, self.rounds + 1 if rows else 1):
            first, step = p[1][0], np.exp(p[2][0])
            s = np.bincount(row, p[0][column], rows)
            over = [np.ones(rows), _sigmoid(s - first), _sigmoid(s - first - step), np.zeros(rows)]
            upper, lower = np.choose(grade, over[:3]), np.choose(grade, over[1:])
            chance = np.maximum(upper - lower, 1e-12)
            ds = -(1 - upper - lower) / rows
            slope = [over[1] * (1 - over[1]), over[2] * (1 - over[2])]
            d1 = (np.where(grade == 1, slope[0], 0) - np.where(grade == 0, slope[0], 0)) / chance / rows
            d2 = (np.where(grade == 2, slope[1], 0) - np.where(grade == 1, slope[1], 0)) / chance / rows
            g = [np.bincount(column, ds[row], width) + self.decay * p[0], np.array([(d1 + d2).sum()]), np.array([d2.sum() * step])]
            for k in range(3):
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] * g[k]
                p[k] = p[k] - self.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)
        self.weights, self.thresholds = p[0], np.array([p[1][0], p[1][0] + np.exp(p[2][0])])
        return self


class Toxicity:
    """Weights by bucket, and thresholds."""

    def choose(self, texts: np.ndarray, with_toxic: np.ndarray) -> Toxicity:
        """The features to learn from, by how often each bucket stands after a different word, in all and in toxic texts.

        What a feature says is counted once for each different word before it, not once for each text: a text with
        many copies or near copies would else make all its words look toxic, or clean.
        """
        n, bad = max(int(texts.sum()), 1), int(with_toxic.sum())
        rate, share_toxic = bad / n, with_toxic / np.maximum(texts, 1)
        clean = texts - with_toxic
        ratio = with_toxic * np.log(np.maximum(share_toxic, 1e-12) / max(rate, 1e-12)) + clean * np.log(np.maximum(1 - share_toxic, 1e-12) / max(1 - rate, 1e-12))
        self.chosen = np.flatnonzero((2 * ratio >= ASSOCIATION) & (share_toxic > rate))
        self.sign = share_toxic[self.chosen] > 0.5
        return self

    def fit(self, samples: list[tuple[np.ndarray, int]]) -> Toxicity:
        """From (distinct chosen buckets, toxic) of each training text."""
        toxic = np.array([t for _, t in samples], np.int64)
        row = np.repeat(np.arange(len(samples)), [len(s[0]) for s in samples])
        column = np.searchsorted(self.chosen, np.concatenate([s[0] for s in samples])) if samples else np.empty(0, np.int64)
        signs = np.bincount(row, self.sign[column], len(samples))
        median = np.median(signs[toxic == 1]) if toxic.any() else 0.0
        grade = np.where(toxic == 1, np.where(signs > median, 2, 1), 0)
        model = CumulativeLink().fit(row, column, len(self.chosen), grade)
        self.weights = np.zeros(BUCKETS, np.float32)
        self.weights[self.chosen] = model.weights
        self.thresholds = model.thresholds
        return self

    def over(self, texts: pa.Array) -> np.ndarray:
        """P(grade > k) for each text and k."""
        text, bucket, _, _ = features(texts)
        used = self.weights[bucket] != 0
        pair = np.unique(text[used] * BUCKETS + bucket[used])
        s = np.bincount(pair // BUCKETS, self.weights[pair % BUCKETS], len(texts))
        return _sigmoid(s[:, None] - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _places(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket, the different words before it in all texts and those of them in toxic texts.

    Tasks send their distinct (bucket, word before, toxic) by ranges of buckets; what comes back is two counts for
    each bucket, a table of fixed size.
    """
    width = BUCKETS // RANGES

    def gather(batches):
        for batch in batches:
            text, bucket, before, _ = features(batch.column(1))
            places = np.unique(bucket << 33 | before << 1 | batch.column(2).to_numpy()[text])
            cuts = np.searchsorted(places >> 33, np.arange(1, RANGES) * width)
            parts = [(r, p.astype("<i8").tobytes()) for r, p in enumerate(np.split(places, cuts)) if len(p)]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["part", "places"])

    def count(table: pa.Table) -> pa.Table:
        places = np.unique(np.concatenate([np.frombuffer(p.as_py(), "<i8") for p in table["places"]]))
        bucket, toxic = (places >> 33) - table["part"][0].as_py() * width, places & 1
        counts = [np.bincount(bucket, w, width).astype("<i4").tobytes() for w in (None, toxic)]
        return pa.table({"part": table["part"].slice(0, 1), "texts": pa.array(counts[:1], pa.binary()), "with_toxic": pa.array(counts[1:], pa.binary())})

    found = sample.mapInArrow(gather, "part int, places binary").groupBy("part").applyInArrow(count, "part int, texts binary, with_toxic binary").collect()
    out = np.zeros((2, RANGES, width), np.int64)
    for part, *counts in found:
        for k in range(2):
            out[k, part] = np.frombuffer(counts[k], "<i4")
    return out[0].ravel(), out[1].ravel()


def learned(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = TRAIN_ROWS) -> Toxicity:
    """A model from at most ``train_rows`` labelled documents, none held out; a bounded sample, broadcast by its bound.

    The sample is read from the corpus once and kept in the shared folder. Features are counted there; the driver
    gets the chosen ones of each text alone.
    """
    marked = F.broadcast(sampled_labels(labels, label, train_rows))
    sample = checkpointed(docs.join(marked, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y"))
    model = Toxicity().choose(*_places(sample))
    chosen = model.chosen

    def pick(batches):
        for batch in batches:
            text, bucket, _, _ = features(batch.column(1))
            pair = np.unique((text * BUCKETS + bucket)[np.isin(bucket, chosen)])
            parts = np.split(pair % BUCKETS, np.searchsorted(pair // BUCKETS, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary()), batch.column(2)], names=["doc_id", "buckets", "y"])

    found = sorted(tuple(r) for r in sample.mapInArrow(pick, "doc_id bigint, buckets binary, y int").collect())
    return model.fit([(np.frombuffer(b, "<u4").astype(np.int64), y) for _, b, y in found])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label: str = "toxic", train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Severity of every whole text: doc_id, held_out, p_mild (grade 1 or 2), p_severe, expected_severity (0 to 2),
    severity (the likeliest grade) and rejected (p_mild at least ``threshold``).

    Null or empty text has no features and gets what the thresholds alone say. Without labels the thresholds are as
    they start and nothing is rejected. Repeated rows get equal scores. A null id is not held out. An empty table
    gives no rows; other columns are ignored.
    """
    rows = id_and_text(docs, id_col, text_col)
    model = learned(rows, labels, label, train_rows)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                over = shared.value.over(part.column(1))
                chance = np.stack([1 - over[:, 0], over[:, 0] - over[:, 1], over[:, 1]])
                aside = [held_out(i) for i in part.column(0).to_pylist()]
                columns = [part.column(0), pa.array(aside, pa.bool_()), pa.array(over[:, 0]), pa.array(over[:, 1]), pa.array(over.sum(1)), pa.array(chance.argmax(0).astype(np.int32)), pa.array(over[:, 0] >= threshold)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "p_mild", "p_severe", "expected_severity", "severity", "rejected"])

    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, p_mild double, p_severe double, expected_severity double, severity int, rejected boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows that ``toxicity`` rejects; rows pass one task, unshuffled.

    Null or empty text has no features and stays, and so does everything where no label says toxic. Rows that repeat stay
    or go together, null ids like any others. Very long texts are taken whole. An empty table gives no rows.
    """
    model = learned(id_and_text(docs, id_col, text_col), labels, label)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def keep(batches):
        for batch in batches:
            texts = batch.column(names.index(text_col)).cast(pa.string()).fill_null("")
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                yield part.filter(pa.array(shared.value.over(texts.slice(start, SLICE))[:, 0] < threshold))

    return docs.mapInArrow(keep, docs.schema)
