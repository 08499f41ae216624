"""Words of many texts at once: places and 64-bit hashes by numpy over the texts' bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LETTER = np.random.default_rng(20).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

#: Class of each byte: 0 separates, equal neighbours of another class are one word, ``ALONE`` is a word by itself.
ALONE = 9
BY_SPACE = np.ones(256, np.uint8)
BY_SPACE[[0x20, *range(0x09, 0x0E)]] = 0
BY_KIND = np.full(256, ALONE, np.uint8)
BY_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0
BY_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
BY_KIND[[*range(48, 58)]] = 2
LETTERS = np.where(BY_KIND == 1, 1, 0).astype(np.uint8)
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1), base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each pair, by prefix sums of value times base ** place, modulo 2 ** 64."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), dtype=np.uint64, out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(_INVERSE, len(values) + 1)[starts]


#: Bytes of text whose letters are hashed at once; what is held meanwhile is 40 times as much.
_STEP = 1 << 20


def byte_hashes(raw: np.ndarray, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``rolling`` of letters[raw] between ascending starts and ends, a step of the text at a time."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        low = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, low + _STEP)))
        out[a:b] = rolling(letters[raw[low : ends[b - 1]]], starts[a:b] - low, ends[a:b] - low)
        a = b
    return out


class Words:
    """Words of a block of texts: ``starts`` and ``ends`` in ``data``, ``hash``, and each text's ``first_word``."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array, classes: np.ndarray = BY_SPACE, letters: np.ndarray | None = None):
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        self.raw, self.offsets = raw, offsets - offsets[0]
        kind = classes[raw]
        word = kind > 0
        change = np.ones(len(raw) + 1, bool)
        change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == ALONE)
        change[self.offsets] = True
        self.starts = np.flatnonzero(change[:-1] & word)
        self.ends = np.flatnonzero(change[1:] & word) + 1
        lettered = _LETTER if letters is None else _LETTER[letters]
        self.hash = mix(byte_hashes(raw, lettered, self.starts, self.ends) + (self.ends - self.starts).astype(np.uint64))
        self.first_word = np.searchsorted(self.starts, self.offsets)  # of each text, and the number of words

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words of all windows of ``size`` words within a text, 64 hash bits of each and 32 more."""
        n = np.diff(self.first_word)
        per = np.maximum(n - size + 1, 0)
        at = np.repeat(self.first_word[:-1] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum()) if len(n) else np.empty(0, np.int64)
        h = rolling(self.hash, at, at + size)
        g = rolling(mix(self.hash + np.uint64(0x5851F42D4C957F2D)), at, at + size)
        return at, mix(h), (mix(g) >> np.uint64(32)).astype(np.uint32)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first_word) - 1), np.diff(self.first_word))
