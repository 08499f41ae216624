"""Byte radix tries of terms, each leaf with its number of documents and a counter for each source.

A trie is laid out in preorder, which is the order of the terms' UTF-8 bytes: each leaf tells how many bytes of its path it
shares with the leaf before, and its label from there on. A range of prefixes is then a slice, and tries of one range merge
in one walk over all of them in that order.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes that neighbours share are found for all pairs at once up to here, and pair by pair beyond.
_AT_ONCE = 48


def _bytes(values: np.ndarray) -> bytes:
    """Integers from 0 on, as the number of them, their width and so many bytes of each."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << (8 * w - (w == 8)))
    return len(values).to_bytes(8, "little") + bytes([width]) + values.astype(f"<u{width}").tobytes()


def _integers(data: bytes, at: int) -> tuple[np.ndarray, int]:
    n, width = int.from_bytes(data[at : at + 8], "little"), data[at + 8]
    return np.frombuffer(data, f"<u{width}", n, at + 9).astype(np.int64), at + 9 + n * width


def _shared(terms: list[bytes]) -> np.ndarray:
    """Bytes that each term shares with the one before."""
    lengths = np.fromiter(map(len, terms), np.int64, len(terms))
    starts = np.cumsum(lengths) - lengths
    flat = np.frombuffer(b"".join(terms), np.uint8)
    most = np.minimum(lengths, np.concatenate([[0], lengths[:-1]]))
    out, alive = np.zeros(len(terms), np.int64), np.flatnonzero(most > 0)
    for k in range(_AT_ONCE):
        alive = alive[flat[starts[alive] + k] == flat[starts[alive - 1] + k]] if len(alive) else alive
        out[alive] = k + 1
        alive = alive[most[alive] > k + 1]
    for i in alive.tolist():
        a, b = flat[starts[i] : starts[i] + most[i]], flat[starts[i - 1] : starts[i - 1] + most[i]]
        unlike = np.flatnonzero(a != b)
        out[i] = unlike[0] if len(unlike) else most[i]
    return out


class RadixTrie:
    """``terms`` in UTF-8 order, ``documents`` of each, and of each its counters: ``source`` and ``count`` from ``first`` on."""

    def __init__(self, terms: list[bytes], documents: np.ndarray, first: np.ndarray, source: np.ndarray, count: np.ndarray):
        self.terms, self.documents, self.first, self.source, self.count = terms, documents, first, source, count

    def __len__(self) -> int:
        return len(self.terms)

    @classmethod
    def counted(cls, documents: Counter, by_source: Sequence[Counter]) -> RadixTrie:
        """From the documents of each term and the occurrences of each term by source."""
        terms = sorted(documents)
        place = dict(zip(terms, range(len(terms)), strict=True))
        leaf = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in by_source])
        count = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in by_source])
        source = np.repeat(np.arange(len(by_source)), [len(c) for c in by_source])
        held = np.fromiter(map(documents.__getitem__, terms), np.int64, len(terms))
        return cls._of_leaves(terms, held, leaf, source, count)

    @classmethod
    def _of_leaves(cls, terms: list[bytes], documents: np.ndarray, leaf: np.ndarray, source: np.ndarray, count: np.ndarray) -> RadixTrie:
        order = np.lexsort((source, leaf))
        first = np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=len(terms)))])
        return cls(terms, documents, first, source[order], count[order])

    @classmethod
    def merged(cls, tries: Sequence[RadixTrie], sources: Sequence[np.ndarray], least: int) -> RadixTrie:
        """All leaves with at least ``least`` documents in all. ``sources``: the common numbers of each trie's sources."""
        terms = [t for trie in tries for t in trie.terms]
        order = sorted(range(len(terms)), key=terms.__getitem__)  # sorted runs, which this sort merges
        new = [a == 0 or terms[order[a]] != terms[order[a - 1]] for a in range(len(order))]
        group = np.empty(len(terms), np.int64)
        group[order] = np.cumsum(new) - 1
        leaves = [t for t, is_new in zip(map(terms.__getitem__, order), new, strict=True) if is_new]
        documents = np.zeros(len(leaves), np.int64)
        np.add.at(documents, group, np.concatenate([t.documents for t in tries]))
        stays = documents >= least
        place = np.cumsum(stays) - 1
        leaf = group[np.repeat(np.arange(len(terms)), np.concatenate([np.diff(t.first) for t in tries]))]
        source = np.concatenate([s[t.source] for t, s in zip(tries, sources, strict=True)])
        count = np.concatenate([t.count for t in tries])
        kept = stays[leaf]
        leaf, source, count = place[leaf[kept]], source[kept], count[kept]
        names, at = np.unique(np.stack([leaf, source]), axis=1, return_inverse=True) if len(leaf) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
        sums = np.zeros(names.shape[1], np.int64)
        np.add.at(sums, at.ravel(), count)
        return cls._of_leaves([t for t, s in zip(leaves, stays.tolist(), strict=True) if s], documents[stays], names[0], names[1], sums)

    def part(self, a: int, b: int) -> RadixTrie:
        """The leaves from a to b."""
        held = slice(int(self.first[a]), int(self.first[b]))
        return RadixTrie(self.terms[a:b], self.documents[a:b], self.first[a : b + 1] - self.first[a], self.source[held], self.count[held])

    def cut(self, bounds: list[bytes]) -> Iterator[tuple[int, RadixTrie]]:
        """The parts below the first bound, from each bound to the next and from the last on, with their numbers; none that is empty."""
        ends = [0, *(bisect_left(self.terms, b) for b in bounds), len(self)]
        yield from ((i, self.part(a, b)) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if a < b)

    def to_bytes(self) -> bytes:
        shared = _shared(self.terms)
        labels = [t[s:] for t, s in zip(self.terms, shared.tolist(), strict=True)]
        sizes = np.fromiter(map(len, labels), np.int64, len(labels))
        return b"".join([*map(_bytes, (shared, sizes, self.documents, np.diff(self.first), self.source, self.count)), *labels])

    @classmethod
    def from_bytes(cls, data: bytes) -> RadixTrie:
        at, columns = 0, []
        for _ in range(6):
            values, at = _integers(data, at)
            columns.append(values)
        shared, sizes, documents, fan, source, count = columns
        terms, path = [], b""
        for s, n in zip(shared.tolist(), sizes.tolist(), strict=True):
            path = path[:s] + data[at : at + n]
            at += n
            terms.append(path)
        return cls(terms, documents, np.concatenate([[0], np.cumsum(fan)]), source, count)
