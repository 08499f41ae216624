"""Token ids in binary files: a concatenated id array with Elias-Fano coded document boundaries.

The files are a Parquet table of binary columns, so that any executor can write and read them in any store that Spark
reaches, with Spark's commit protocol. A row is one block of documents in ascending order of their ids:

shard, block       place in the order; blocks of a shard follow each other
base               ids in the blocks of the shard before this one
n_docs, n_null     documents of the block, and those of them without an id, which come first
first_doc, docs    the least doc_id, and all of them less that, Elias-Fano coded like the boundaries
n_ids              ids in the block
width, ids         bytes an id takes (2 or 4), and the ids, little-endian
bounds             n_docs + 1 boundaries of documents in ``ids``

An Elias-Fano code holds, for each value, its low bits, packed (``low_bits``, ``low``), and its high part in a unary bit
vector: value j with high part h sets bit h + j of ``high``. ``samples`` are the places of every 64th set bit, from
which select runs. There is no table of offsets: a reader selects a document's start and end.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text
from .units import unit_ids

SAMPLE = 64
CODE = "struct<low_bits: int, low: binary, high: binary, samples: binary>"
SCHEMA = f"shard int, block int, base bigint, n_docs bigint, n_null bigint, first_doc bigint, docs {CODE}, n_ids bigint, width int, ids binary, bounds {CODE}"
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(top / n) bits an element."""

    def __init__(self, low_bits: int, low: bytes, high: bytes, samples: bytes, n: int):
        self.low_bits, self.low, self.high, self.samples, self.n = low_bits, low, high, samples, n

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        low_bits = max(0, (int(values[-1]) // max(n, 1)).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes(), n)

    @property
    def code(self) -> dict:
        return {"low_bits": self.low_bits, "low": self.low, "high": self.high, "samples": self.samples}

    def select(self, j: int) -> int:
        """The j-th value: from the nearest sample on, count set bits of the high vector, then add the low bits."""
        at = int(np.frombuffer(self.samples, "<u4")[j // SAMPLE])
        left = j % SAMPLE
        byte, word = at >> 3, self.high[at >> 3] >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = 8 * byte + (word & -word).bit_length() - 1
        start = j * self.low_bits
        end = start + self.low_bits
        low = int.from_bytes(self.low[start >> 3 : (end + 7) >> 3], "little") >> (start & 7) & ((1 << self.low_bits) - 1)
        return (place - j) << self.low_bits | low


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_ids: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends ``end_id`` and writes the ids in ascending order of doc_id below ``path``.

    Texts are dealt by ranges of doc_id and sorted within, so shards follow each other and no task holds more than a
    block of ids. Null or empty text is the end id alone; rows that repeat follow each other, ordered by text; null
    ids come first; an empty table gives files without rows; other columns are ignored.
    """

    def run(batches):
        encoder, end, shard = unit_ids(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        width = 2 if encoder.tokenizer.get_vocab_size() < 65536 and end_id < 65536 else 4
        block, base, ids, docs_, sizes, total = 0, 0, [], [], [], 0

        def row():
            data = np.frombuffer(b"".join(ids), "<u4")
            known = np.array([d for d in docs_ if d is not None], np.int64)
            first = int(known[0]) if len(known) else 0
            docs_code = EliasFano.build(known.view(np.uint64) - np.uint64(first & ((1 << 64) - 1))).code
            bounds = EliasFano.build(np.concatenate([[0], np.cumsum(sizes)])).code
            values = [shard, block, base, len(docs_), len(docs_) - len(known), first, docs_code, len(data), width, data.astype(f"<u{width}").tobytes(), bounds]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                for doc_id, data in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids.append(data + end)
                    docs_.append(doc_id)
                    sizes.append(len(data) // 4 + 1)
                    total += sizes[-1]
                    if total >= block_ids:
                        yield row()
                        block, base, ids, docs_, sizes, total = block + 1, base + total, [], [], [], 0
        if docs_:
            yield row()

    code = pa.struct([("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])
    fields = T.StructType.fromDDL(SCHEMA).fields
    names, kinds = [f.name for f in fields], [_KINDS.get(f.dataType.simpleString(), code) for f in fields]
    rows = id_and_text(docs, id_col, text_col)
    shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    ranged = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of 32-bit ids).

    The ids before each shard come from one sum per shard, of which there are as many as write tasks, and are broadcast;
    the ids before a block of a shard are in its row; those before a document come from select on the boundaries. The
    blocks are not shuffled.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    sums = sorted(files.groupBy("shard").agg(F.sum("n_ids")).collect())
    before = dict(zip([s for s, _ in sums], np.cumsum([0, *(n for _, n in sums)])[:-1].tolist(), strict=True))
    shards = spark.sparkContext.broadcast(before)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4").tobytes()
                base, nulls = shards.value[r["shard"]] + r["base"], r["n_null"]
                bounds = EliasFano(**r["bounds"], n=r["n_docs"] + 1)
                known = EliasFano(**r["docs"], n=r["n_docs"] - nulls)
                columns: list[list] = [[], [], [], []]
                end = bounds.select(0)
                for j in range(r["n_docs"]):
                    start, end = end, bounds.select(j + 1)
                    doc = None if j < nulls else r["first_doc"] + known.select(j - nulls)
                    for column, value in zip(columns, (doc, base + start, end - start, zlib.crc32(data[4 * start : 4 * end])), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
