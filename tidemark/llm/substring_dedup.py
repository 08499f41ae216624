"""Removal of passages that recur: recurring phrases are confirmed, automata locate them, what they lead to is verified.

Documents are dealt to blocks of bounded size by a hash of their id, and stay there; blocks and owners of ranges of hash
values exchange sorted, Golomb-coded hashes and bitmaps (``exchange``).

1. Of each window of ``window`` words the phrase of half its length with the least hash is its anchor. Two equal windows
   have the same anchor. Blocks send their distinct anchors, about a tenth of all phrases, and learn which of them recur.
2. Each block compiles its recurring anchors to an Aho-Corasick automaton (pyahocorasick, over words' numbers), its shard of
   all recurring phrases, and streams its documents through it. A window that holds no occurrence of one can't recur. The
   other windows' hashes (96 bits) are exchanged.
3. The automaton locates the same occurrences again, and each word of a window around one that another place holds too goes.

A block's automaton holds only phrases that occur in the block, so its size is bounded by the block's, and each document
passes one automaton, whatever the size of the corpus.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import SENT, answered, answers, sent_blobs
from .wordhash import Words

#: UTF-8 bytes of text that a block holds, about.
BLOCK_BYTES = 3_000_000
#: Letters that words' numbers are spelled with.
_ALPHABET = 64


def _distinct(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (h, g), the place of each row among them, and how many rows each has."""
    order = np.argsort(h)
    if ((h[order][1:] == h[order][:-1]) & (g[order][1:] != g[order][:-1])).any():
        order = np.lexsort((g, h))
    hs, gs = h[order], g[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])
    group = np.cumsum(new) - 1
    place = np.empty(len(hs), np.int64)
    place[order] = group
    return hs[new], gs[new], place, np.bincount(group, minlength=int(new.sum()))


def _sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each value and the ``size`` - 1 after it."""
    least, have = values, 1
    while have < size:
        step = min(have, size - have)
        least = least.copy()
        least[:-step] = np.minimum(least[:-step], least[step:]) if step < len(least) else least[:-step]
        have += step
    return least


class Block:
    """The windows and phrases of a block's texts."""

    def __init__(self, table: pa.Table, window: int):
        self.window, self.phrase = window, (window + 1) // 2
        self.words = Words(table["text"])
        self.at, self.h, self.g = self.words.windows(window)
        self.start, self.phrase_hash, _ = self.words.windows(self.phrase)
        every = np.full(len(self.words.starts), np.iinfo(np.uint64).max, np.uint64)
        every[self.start] = self.phrase_hash
        self.anchors = np.unique(_sliding_least(every, window - self.phrase + 1)[self.at])

    def recurring(self, back: pa.Table) -> np.ndarray:
        """Anchors that another block holds too, or that stand twice in this one."""
        order = np.sort(self.phrase_hash)
        times = np.searchsorted(order, self.anchors, "right") - np.searchsorted(order, self.anchors)
        return self.anchors[answered(back, len(self.anchors)) | (times > 1)]

    def _spelled(self) -> tuple[str, int]:
        """All words as a string of a few letters each, the same for equal words: an automaton's nodes have few children then."""
        kinds, number = np.unique(self.words.hash, return_inverse=True)
        letters = 1
        while _ALPHABET**letters < len(kinds):
            letters += 1
        digits = number[:, None] // _ALPHABET ** np.arange(letters) % _ALPHABET
        return (digits.ravel() + 256).astype("<u4").tobytes().decode("utf-32-le"), letters

    def located(self, recurring: np.ndarray) -> np.ndarray:
        """Places in ``at`` of the windows that hold a recurring phrase where the automaton finds it."""
        if not len(recurring):
            return np.empty(0, np.int64)
        order = np.argsort(self.phrase_hash, kind="stable")
        first = self.start[order[np.searchsorted(self.phrase_hash[order], recurring)]]
        text, letters = self._spelled()
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        size = letters * self.phrase
        for a in (first * letters).tolist():
            automaton.add_word(text[a : a + size], 1)
        automaton.make_automaton()
        ends = np.fromiter((end for end, _ in automaton.iter(text)), np.int64) + 1
        found = np.zeros(len(self.words.starts) + 1, np.int64)
        found[ends[ends % letters == 0] // letters - self.phrase + 1] = 1  # a match across texts is in no window
        before = np.cumsum(found)
        return np.flatnonzero(before[self.at + self.window - self.phrase + 1] > before[self.at])

    def covered(self, windows: np.ndarray) -> np.ndarray:
        """Words under windows, given by their places in ``at``."""
        n, starts = len(self.words.starts) + 1, self.at[windows]
        return np.cumsum(np.bincount(starts, minlength=n) - np.bincount(starts + self.window, minlength=n))[:-1] > 0


def remove_repeated_passages(docs: DataFrame, window: int = 35, block_bytes: int = BLOCK_BYTES, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """Removes every word under a window of ``window`` words whose word sequence also starts anywhere else.

    Words are runs of other bytes than space and 0x09-0x0D, unchanged. Windows are judged on the input. Returns
    doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space); with ``keep_text`` also ``kept_text``,
    the kept words so joined, or the text itself where no word went. ``carry`` names a struct column to hand through.

    Null, empty or blank text has no words. Rows that repeat are copies of each other like any others. Null ids form
    no group of their own. An empty table gives no rows. Texts of any length are taken whole; other columns are ignored.
    """
    own = [F.col(carry).alias("carried")] if carry else []
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *own)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(11)), F.lit(blocks)).cast("int")).repartition(blocks, "part")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if keep_text else "")

    def send_anchors(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([sent_blobs(table["part"][0].as_py(), Block(table, window).anchors, max(1, blocks // 16))])

    def send_windows(table: pa.Table, back: pa.Table) -> pa.Table:
        block = Block(table, window)
        at = block.located(block.recurring(back))
        values, more, _, _ = _distinct(block.h[at], block.g[at])
        return pa.Table.from_batches([sent_blobs(table["part"][0].as_py(), values, max(1, blocks // 4), more)])

    def cut(table: pa.Table, back: pa.Table) -> pa.Table:
        block = Block(table, window)
        words, data = block.words, block.words.raw.tobytes()
        of = lambda kind: back.filter(pc.equal(back["kind"], kind))
        at = block.located(block.recurring(of(0)))
        values, _, place, times = _distinct(block.h[at], block.g[at])
        covered = block.covered(at[(answered(of(1), len(values)) | (times > 1))[place]])
        n = np.diff(words.first_word)
        removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[words.first_word])
        digests, texts = [], []
        for d, (a, b) in enumerate(zip(words.first_word[:-1].tolist(), words.first_word[1:].tolist(), strict=True)):
            kept = [data[words.starts[w] : words.ends[w]] for w in range(a, b)] if not removed[d] else [data[words.starts[w] : words.ends[w]] for w in np.flatnonzero(~covered[a:b]) + a]
            joined = b" ".join(kept)
            digests.append(hashlib.sha256(joined).hexdigest())
            if keep_text:
                texts.append(joined if removed[d] else data[words.offsets[d] : words.offsets[d + 1]])
        columns = {"doc_id": table["doc_id"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if keep_text:
            columns["kept_text"] = pa.array(texts, pa.binary()).cast(pa.string())
        if carry:
            columns["carried"] = table["carried"]
        return pa.table(columns)

    anchors = answers(dealt.groupBy("part").applyInArrow(send_anchors, SENT))
    windows = answers(dealt.groupBy("part").cogroup(anchors.groupBy("part")).applyInArrow(send_windows, SENT))
    back = anchors.withColumn("kind", F.lit(0)).unionByName(windows.withColumn("kind", F.lit(1)))
    if carry:
        schema = T.StructType([*T.StructType.fromDDL(schema), T.StructField("carried", docs.schema[carry].dataType)])
    return dealt.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(cut, schema)


def drop_repeated_passages(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns; texts that lose words are their kept words joined by a space, others are unchanged.

    A text all of whose words recur becomes empty; null stays null. Rows that repeat, null ids among them, are copies of
    each other like any others. Very long texts are taken whole. An empty table gives no rows.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    held = held.select(F.col(f"row.`{id_col}`").alias("doc_id"), F.col(f"row.`{text_col}`").alias("text"), "row")
    found = remove_repeated_passages(held, window, keep_text=True, carry="row")
    cut = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(f"carried.`{text_col}`")).alias(text_col)
    return found.select(*[cut if c == text_col else F.col(f"carried.`{c}`").alias(c) for c in docs.columns])
