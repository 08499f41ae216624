"""Token counts: pieces are counted once per distinct pre-token and joined to per-document pre-token frequencies."""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, written
from .units import unit_ids

#: Pre-tokens whose counts every worker holds, and characters of the longest of them; and how many a task gathers at once.
HEAD, HEAD_CHARS, GATHERED = 1_000_000, 24, 400_000
#: Rows that are split at once.
SLICE = 500

_HEADS: dict[str, dict[str, int]] = {}


def _vocabulary(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(unit, times, pieces): each distinct pre-token of all texts, how often it occurs, and its number of pieces.

    Tasks send their distinct pre-tokens with sums, so a very frequent one arrives as one row for each ``GATHERED``.
    """

    def gather(batches):
        split, times = unit_ids(tokenizer).split, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                times.update(split(text))
                if len(times) >= GATHERED:
                    yield _columns(["unit", "times"], [list(times), list(times.values())], [pa.string(), pa.int64()])
                    times = Counter()
        yield _columns(["unit", "times"], [list(times), list(times.values())], [pa.string(), pa.int64()])

    def count(batches):
        encoder = unit_ids(tokenizer)
        for batch in batches:
            units = batch.column(0).to_pylist()
            pieces = {u: len(ids) for u, ids in encoder.encoded(set(units))}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pieces[u] for u in units], pa.int64())], names=["unit", "times", "pieces"])

    distinct = texts.mapInArrow(gather, "unit string, times bigint").groupBy("unit").agg(F.sum("times").alias("times"))
    return written(distinct.mapInArrow(count, "unit string, times bigint, pieces bigint"), "pre-tokens")


def _most_frequent(vocabulary: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, and no frequency left out that is above one taken: by classes of frequencies, not by sorting.

    Classes are a sixteenth of a power of two wide, so the table that says where to cut has at most about a thousand rows.
    """
    step = F.floor(F.log2("times") * 16)
    taken, least = 0, 1 << 20
    for n, count in sorted(((r[0], r[1]) for r in vocabulary.groupBy(step).agg(F.count(F.lit(1))).collect()), reverse=True):
        taken += count
        if taken > most:
            break
        least = n
    return vocabulary.where(step >= least)


def _columns(names: list[str], values: list, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, as the tokenizers library counts them without added tokens.

    1. The distinct pre-tokens of all texts are grouped, and each one's pieces are counted once; its ids exist only in
       that call, and are neither kept nor sent.
    2. Each document becomes its distinct pre-tokens and how often each occurs. The counts of the most frequent
       pre-tokens, at most ``head`` of at most ``HEAD_CHARS`` characters each, are broadcast and joined at once; what else occurs is
       joined by a shuffle of (document, pre-token, times). The products are summed by document.

    A pre-token here is a stretch of text that the library encodes independently of its surroundings (``units``).

    Null or empty text: 0 bytes, 0 tokens. Rows that repeat are each counted. A null id stays null. Empty table:
    no rows. Other columns are ignored.
    """
    rows = id_and_text(docs, id_col, text_col)
    vocabulary = _vocabulary(rows.select("text"), tokenizer)
    top = _most_frequent(vocabulary.where(F.length("unit") <= HEAD_CHARS), head).select("unit", "pieces").toArrow()
    name, known = uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast((top["unit"].combine_chunks(), top["pieces"].combine_chunks()))
    names = ["row", "doc_id", "n_bytes", "n_tokens", "units", "times"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]

    def join(batches):
        split, of_head = unit_ids(tokenizer).split, _head(name, known)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                sums, units, counts = [], [], []
                for text in part.column(1).to_pylist():
                    total, rest = 0, {}
                    for unit, times in Counter(split(text)).items():
                        pieces = of_head.get(unit)
                        if pieces is None:
                            rest[unit] = times
                        else:
                            total += pieces * times
                    sums.append(total)
                    units.append(list(rest))
                    counts.append(list(rest.values()))
                n = len(sums)
                size = pc.binary_length(part.column(1).cast(pa.binary())).to_pylist()
                yield _columns(names, [range(row, row + n), part.column(0).to_pylist(), size, sums, units, counts], kinds)
                row += n

    met = rows.mapInArrow(join, "row bigint, doc_id bigint, n_bytes bigint, n_tokens bigint, units array<string>, times array<bigint>")
    met = written(met, "rare-pre-tokens")
    tail = met.select("row", F.inline(F.arrays_zip("units", "times"))).select("row", F.col("units").alias("unit"), "times")
    tail = tail.join(vocabulary.select("unit", "pieces"), "unit")
    more = tail.groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    n_tokens = (F.col("n_tokens") + F.coalesce("more", F.lit(0))).cast("bigint")
    out = met.join(more, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def _head(name: str, known) -> dict[str, int]:
    """The broadcast counts as a dictionary, made once per worker."""
    if name not in _HEADS:
        _HEADS.clear()
        units, pieces = known.value
        _HEADS[name] = dict(zip(units.to_pylist(), pieces.to_pylist(), strict=True))
    return _HEADS[name]
