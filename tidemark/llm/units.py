"""Encoding by the tokenizers library once per distinct unit of text instead of once per occurrence.

A *unit* is a stretch of text whose ids do not depend on what stands around it, so that the ids of a text are the
ids of its units in order. Two pre-tokenisations are known here; for any other tokenizer the whole text is one unit.

byte level with its usual pattern
    A single space belongs to the word after it and all other single white space stands alone; of a run of three or
    more, all but the last form one pre-token, and a run at the end of the text is one pre-token.
words without white space
    White space only separates.

Texts with rare white space (where libraries differ on what counts) or NUL are one unit themselves. A special token's
string is a unit, and what stands before and after it is cut by itself, as if the text ended and began there.

Units are encoded by the tokenizers library, or, for plain units of these two kinds, by tiktoken's merge loop over the
same vocabulary, which is five times as fast on words not seen before. Both loops give the same ids where (1) ids rise
in the order of the merges and (2) each token, encoded by itself, is one token: parts of a text that spell a token
without a merge across its ends have gone through the same states as that token by itself, so the last two are the
pair of its merge. ``tests/llm`` checks both conditions and compares the results.

Byte-level texts are encoded whole by that loop: its own pattern cuts them, on every code point as the library does, and
that costs less than to cut units in Python and look each one up. Only texts with a special token's string or with
very long white space, on which the pattern's stack overflows, go to the library.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np

_ODD = re.compile("[\x00\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_RUN = re.compile(r"(\s{2,}(?=\s))")
_THREE = re.compile(r"\s{3}")
#: White space at which a text goes to the library; the pattern's stack holds a million steps.
LONG_SPACE = 100_000
_LONG = re.compile(r"\s(?<!\s\s)\s{%d}" % (LONG_SPACE - 1))


def byte_level_units(text: str) -> list[str]:
    if not text:
        return []
    if _ODD.search(text):
        return [text]
    body = text.rstrip()
    tail = text[len(body) :]
    if _THREE.search(body):
        units: list[str] = []
        for i, part in enumerate(_RUN.split(body)):
            units += [part] if i % 2 else part.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    else:
        units = body.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    if tail:
        units.append(tail)
    return units


def word_units(text: str) -> list[str]:
    return [text] if text and _ODD.search(text) else text.split()


def whole_text(text: str) -> list[str]:
    return [text] if text else []


def long_space(text: str) -> bool:
    return len(text) >= LONG_SPACE and _LONG.search(text) is not None


def splitter(config: dict) -> Callable[[str], list[str]]:
    """The unit splitter that a tokenizer's own description allows."""
    pre = config.get("pre_tokenizer") or {}
    if config.get("post_processor") or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in config.get("added_tokens", [])):
        return whole_text
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not config.get("normalizer"):
        return byte_level_units
    steps = pre.get("pretokenizers") or [{}]
    split, rest = steps[0], [s.get("type") for s in steps[1:]]
    normal = [n.get("type") for n in (config.get("normalizer") or {}).get("normalizers", [])]
    drops_space = split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed" and split["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
    if drops_space and rest == ["ByteLevel"] and not steps[1].get("add_prefix_space") and normal == ["NFC", "Replace", "Lowercase"]:
        return word_units
    return whole_text


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from code point 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def lower_nfc(text: str) -> str:
    """NFC, then every letter lower-cased by itself (a capital sigma at a word's end is no final sigma)."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def merge_loop(config: dict) -> Callable[[str], list[int]] | None:
    """Encodes plain units (no special token's text in them) by tiktoken over the vocabulary of a tokenizers file."""
    import regex
    import tiktoken

    kind, model = splitter(config), config["model"]
    byte = {c: bytes([b]) for b, c in enumerate(byte_letters())}
    end = model.get("end_of_word_suffix") or ""
    if kind is byte_level_units and not end:
        ranks = {b"".join(byte[c] for c in t): i for t, i in model["vocab"].items()}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if kind is word_units and end:
        #: 0xFF is in no UTF-8 text; it stands for the end of a word. Its merges with single bytes have the lowest ids.
        cut = lambda t: (t[: -len(end)], b"\xff") if t.endswith(end) else (t, b"")
        special = {t["content"] for t in config["added_tokens"]}
        ranks = {b"".join(byte[c] for c in body) + mark: i for t, i in model["vocab"].items() if t not in special for body, mark in [cut(t)]}
        ranks[b"\xff"] = max(ranks.values()) + 10
        whole = ranks.get
        one = tiktoken.Encoding("units", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        words = regex.compile(config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall

        def encode(unit: str) -> list[int]:
            unit = lower_nfc(unit)
            if unit.isalpha():
                data = unit.encode() + b"\xff"
                return one(data) if (i := whole(data)) is None else [i]
            return [i for w in words(unit) for i in one(w.encode() + b"\xff")]

        return encode
    return None


class UnitIds:
    """Ids of distinct units, as little-endian 32-bit bytes, in two generations of at most ``limit`` units each."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.cut = splitter(config)
        self.loop = merge_loop(config)
        special = sorted((t["content"] for t in config.get("added_tokens", [])), key=len, reverse=True)
        starts = "|".join(map(re.escape, special))
        self.by_library = re.compile(_ODD.pattern + (f"|{starts}" if starts else ""))
        self.special = [] if self.cut is whole_text else special
        self.special_at = re.compile(f"({starts})")
        self.whole = self.cut is byte_level_units and self.loop is not None
        self.limit, self.new, self.old = limit, {}, {}

    def split(self, text: str) -> list[str]:
        """The units of a text."""
        if not any(s in text for s in self.special):
            return self.cut(text)
        parts = self.special_at.split(text)
        return [u for i, part in enumerate(parts) for u in ([part] if i % 2 else self.cut(part))]

    def learn(self, units: Iterable[str]) -> dict[str, bytes]:
        """A dictionary that holds all the given units; those not seen before are encoded, in one call."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        gc.freeze()  # else each collection walks the dictionaries
        new, old = self.new, self.old
        missing = set(units).difference(new)
        if old:
            known = missing.intersection(old)
            for u in known:
                new[u] = old[u]
            missing -= known
        new.update((u, array("I", ids).tobytes()) for u, ids in self.encoded(missing))
        return new

    def encoded(self, units: set[str]) -> Iterator[tuple[str, list[int]]]:
        """Each unit and its ids, in any order; nothing is kept."""
        if self.loop:
            loop, library = self.loop, self.by_library.search
            held = {u for u in units if library(u)} if library("\n".join(units)) else set()
            if self.whole:
                held |= {u for u in units if long_space(u)}
            for u in units - held if held else units:
                yield u, loop(u)
            units = held
        ask = list(units)
        for i in range(0, len(ask), 20_000):
            part = ask[i : i + 20_000]
            for u, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                yield u, e.ids

    def of_text(self, text: str) -> list[int]:
        """The ids of a byte-level text, without units."""
        if any(s in text for s in self.special) or long_space(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.loop(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit bytes."""
        if self.whole:
            return [array("I", self.of_text(t)).tobytes() for t in texts]
        out: list[bytes] = []
        for i in range(0, len(texts), 500):
            units = [self.split(t) for t in texts[i : i + 500]]
            ids = self.learn(set().union(*units)).__getitem__
            out += [b"".join(map(ids, us)) for us in units]
        return out


_OPEN: dict[str, UnitIds] = {}


def unit_ids(path: str, limit: int = 400_000) -> UnitIds:
    """One encoder per Python worker and vocabulary file; it holds at most about twice ``limit`` units."""
    if path not in _OPEN:
        _OPEN[path] = UnitIds(path)
    _OPEN[path].limit = limit
    return _OPEN[path]
