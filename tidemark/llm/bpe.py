"""Byte-pair encoding and decoding of whole texts with a vocabulary of lower-case words that end in ``</w>``.

Merges run on a contiguous rank array: the parts of a word and the ranks of adjacent parts stand in two short lists;
the smallest rank is looked for by scanning, its right part is deleted and the ranks beside it are refreshed. Words
beyond ``SHORT`` symbols, where repeated scans would be quadratic, take a heap over linked parts with the same order.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_and_text
from .units import byte_letters, lower_nfc, word_units

SHORT = 96


class WordBpe:
    """Encoder and decoder for one vocabulary file of the tokenizers library."""

    def __init__(self, path: str, limit: int = 300_000):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in config["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        letters = byte_letters()
        self.first = [self.vocab.get(c) for c in letters]
        self.last = [self.vocab.get(c + self.end) for c in letters]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.limit, self.new, self.old = limit, {}, {}

    def word(self, word: str) -> list[int]:
        data = word.encode()
        parts = [self.first[b] for b in data[:-1]] + [self.last[data[-1]]]
        parts = [p for p in parts if p is not None]
        return self._short(parts) if len(parts) <= SHORT else self._long(parts)

    def _short(self, parts: list[int]) -> list[int]:
        far, merge = (1 << 60, 0), self.merge
        ranks = [merge.get(p, far) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best is far:
                break
            i = ranks.index(best)
            parts[i] = best[1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = merge.get((parts[i], parts[i + 1]), far)
            if i:
                ranks[i - 1] = merge.get((parts[i - 1], parts[i]), far)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        n, merge = len(parts), self.merge
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, p, m[1]) for i, p in enumerate(zip(parts, parts[1:])) if (m := merge.get(p))]
        heapq.heapify(heap)
        while heap:
            _, i, pair, made = heapq.heappop(heap)
            j = after[i]
            if j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (m := merge.get(p := (parts[a], parts[after[a]]))):
                    heapq.heappush(heap, (m[0], a, p, m[1]))
        return [p for p in parts if p >= 0]

    def encode_unit(self, unit: str) -> list[int]:
        ids: list[int] = []
        at = 0
        for hit in self.special_at.finditer(unit) if self.special_at else ():
            ids += [i for w in self.words.findall(lower_nfc(unit[at : hit.start()])) for i in self.word(w)]
            ids.append(self.special[hit[0]])
            at = hit.end()
        return ids + [i for w in self.words.findall(lower_nfc(unit[at:])) for i in self.word(w)]

    def encode(self, text: str) -> list[int]:
        return [i for u in word_units(text) for i in self.encode_unit(u)]

    def decode(self, ids: list[int]) -> str:
        """As the library does where a vocabulary names no decoder: the tokens, special ones too, joined by a space."""
        return " ".join(self.token[i] for i in ids)

    def learn(self, units: set[str]) -> dict[str, tuple[int, str, str]]:
        """For every unit: how many ids, the ids in decimal and the decoded tokens, each joined by a space."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        for u in units.difference(new):
            if u in old:
                new[u] = old[u]
            else:
                ids = self.encode_unit(u)
                new[u] = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        return new


_OPEN: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    if path not in _OPEN:
        _OPEN[path] = WordBpe(path)
    return _OPEN[path]


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Encodes every whole text, decodes the ids again, and returns digests of both.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep`` also ``ids`` (array<int>) and ``decoded``.
    Null or empty text: no ids, digests of the empty string. Repeated rows and null ids are kept as they are; an
    empty table gives no rows; other columns are ignored.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")

    def run(batches):
        bpe = word_bpe(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                units = [word_units(t) for t in part.column(1).to_pylist()]
                known = bpe.learn({u for us in units for u in us})
                found = [[known[u] for u in us] for us in units]
                n = [sum(x[0] for x in f) for f in found]
                ids = [" ".join([x[1] for x in f if x[0]]) for f in found]
                text = [" ".join([x[2] for x in f if x[0]]) for f in found]
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in text], pa.string())]
                if keep:
                    columns += [pa.array([[int(i) for i in x.split()] for x in ids], pa.list_(pa.int32())), pa.array(text, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
