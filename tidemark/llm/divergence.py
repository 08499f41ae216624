"""Divergence of sources from each other and from their language, by mergeable radix tries of term counts.

1. Tasks count the terms of their documents and send them as tries (``tries``), one for each language, in pieces.
2. Ranges of prefixes are set from a sample of where pieces begin, all about as large; pieces are cut at their bounds, and
   each range merges what all tasks sent, drops terms in too few documents, and keeps the rest as tries.
3. Each range walks its tries in UTF-8 order and streams what it adds to each pair of sources, and its candidates for each
   source's most divergent terms, ties in that order. Sums and ranks follow in DataFrame functions.

What a pair of sources adds up over terms that neither has is reckoned at once; over terms that one of them has, from how
many terms have each count; only terms that both have are met one by one.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .tries import RadixTrie

#: (source, term) entries that a task counts before it sends them, leaves of a piece, and bytes of tries merged by one task.
GATHERED, LEAVES, RANGE_BYTES = 500_000, 4096, 4 << 20
#: Bytes of a text that are split at once, numbers that are reckoned at once, and sources whose sums a task holds at once.
SLICE, CELLS, SOURCES = 4 << 20, 1 << 20, 512
#: What probabilities are parts of.
ONE = 1_000_000_000

#: A-Z lowered, other ASCII but letters as space, the rest as it is.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PIECES = "lang string, sources array<string>, begins binary, ends binary, leaves bigint, totals array<bigint>, trie binary"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Runs of letters and non-ASCII characters, A-Z lowered, some megabytes of text at a time."""
    if len(text) <= SLICE:
        yield text.translate(_TERMS).split()
        return
    text, a = text.translate(_TERMS), 0
    while a < len(text):
        b = text.find(b" ", a + SLICE)
        b = len(text) if b < 0 else b
        yield text[a:b].split()
        a = b


def _pieces(lang: str, sources: list[str], trie: RadixTrie) -> Iterator[dict]:
    for a in range(0, len(trie), LEAVES):
        part = trie.part(a, min(a + LEAVES, len(trie)))
        totals = np.zeros(len(sources), np.int64)
        np.add.at(totals, part.source, part.count)
        yield {"lang": lang, "sources": sources, "begins": part.terms[0], "ends": part.terms[-1], "leaves": len(part), "totals": totals.tolist(), "trie": part.to_bytes()}


def _kind(name: str) -> pa.DataType:
    return {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}[name]


def _table(rows: list[dict], ddl: str) -> pa.Table:
    columns = [c.split() for c in ddl.split(", ")]
    return pa.table({n: pa.array([r[n] for r in rows], _kind(k)) for n, k in columns})


def _counted(rows: DataFrame) -> DataFrame:
    """Pieces of tries of (lang, source, text)."""

    def gather(batches):
        counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        documents: dict[str, Counter] = defaultdict(Counter)
        held = 0

        def sent():
            for lang, by_source in counts.items():
                pieces = list(_pieces(lang, list(by_source), RadixTrie.counted(documents[lang], list(by_source.values()))))
                yield from _table(pieces, _PIECES).to_batches()

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, batch.column(2), strict=True):
                counter, before, seen = counts[lang][source], len(counts[lang][source]), set()
                for terms in terms_of(text.as_buffer().to_pybytes()):
                    counter.update(terms)
                    seen.update(terms)
                documents[lang].update(seen)
                held += len(counter) - before
                if held >= GATHERED:
                    yield from sent()
                    counts.clear()
                    documents.clear()
                    held = 0
        yield from sent()

    return rows.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(gather, _PIECES)


def _bounds(pieces: DataFrame, range_bytes: int) -> list[tuple[str, bytes]]:
    """Where ranges of about ``range_bytes`` begin, by Spark's own sample of where pieces do; one row a range."""
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("trie")), F.lit(0))).first()[0]
    n = -(-size // range_bytes)
    if n < 2:
        return []
    ranged = pieces.select("lang", "begins").repartitionByRange(n, "lang", "begins").select("lang", "begins", F.spark_partition_id().alias("of"))
    first = ranged.groupBy("of").agg(F.min(F.struct("lang", "begins")).alias("at"))
    return sorted((r.at.lang, bytes(r.at.begins)) for r in first.collect())[1:]


def _merged(pieces: DataFrame, min_docs: int, range_bytes: int) -> DataFrame:
    """Pieces of the tries of all terms in at least ``min_docs`` documents of their language."""
    bounds = _bounds(pieces, range_bytes)
    sent = "range int, lang string, sources array<string>, trie binary"

    def cut(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                a, b = (bisect_right(bounds, (r["lang"], r[x])) for x in ("begins", "ends"))
                of = {"lang": r["lang"], "sources": r["sources"]}
                if a == b:
                    rows.append(of | {"range": a, "trie": r["trie"]})
                else:
                    own = [term for _, term in bounds[a:b]]
                    rows += [of | {"range": a + i, "trie": part.to_bytes()} for i, part in RadixTrie.from_bytes(r["trie"]).cut(own)]
            yield from _table(rows, sent).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = []
        for lang in sorted({r["lang"] for r in rows}):
            own = [r for r in rows if r["lang"] == lang]
            names = sorted({s for r in own for s in r["sources"]})
            place = {s: i for i, s in enumerate(names)}
            numbers = [np.array([place[s] for s in r["sources"]], np.int64) for r in own]
            out += _pieces(lang, names, RadixTrie.merged([RadixTrie.from_bytes(r["trie"]) for r in own], numbers, min_docs))
        return _table(out, _PIECES)

    ranged = pieces.select("lang", "sources", "begins", "ends", "trie").mapInArrow(cut, sent)
    return ranged.groupBy("range").applyInArrow(merge, _PIECES)


def share(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(ONE * (count + 1) / of), exactly, for a count below ``of``."""
    count, of = np.broadcast_arrays(np.asarray(count, np.int64) + 1, np.asarray(of, np.int64))
    if not count.size or int(count.max()) <= (1 << 63) // ONE - 1:
        return 1 + count * ONE // of
    out, rest = count // of, count % of
    for _ in range(3):  # three decimals at a time
        rest = rest * 1000
        out, rest = out * 1000 + rest // of, rest % of
    return 1 + out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Sources:
    """The sources of a language: names in UTF-8 order, what their counts are shares of, and the share of a count of 0."""

    def __init__(self, names: list[str], occurrences: list[int], kept: int):
        self.names = names
        self.of = np.array(occurrences, np.int64) + kept
        self.all = sum(occurrences) + kept
        self.none = share(0, self.of) if kept else self.of
        self.place = {n: i for i, n in enumerate(names)}

    def added(self, trie: RadixTrie, source: np.ndarray, low: int, high: int) -> np.ndarray:
        """What the leaves add to the sums of sources low .. high against all, beyond the sum of leaves that neither has."""
        out = np.zeros((high - low, len(self.names)), np.int64)
        none, block = self.none, self.none[low:high]
        for s in np.unique(source).tolist():
            count, times = np.unique(trie.count[source == s], return_counts=True)
            p = share(count, self.of[s])
            for a in range(0, len(p), step := max(1, CELLS // len(none))):
                own, n = p[a : a + step], times[a : a + step]
                if low <= s < high:
                    out[s - low] += n @ (divergence(own[:, None], none) - divergence(none[s], none))
                out[:, s] += (divergence(block[:, None], own) - divergence(block, none[s])[:, None]) @ n
        fan = np.diff(trie.first)
        p = share(trie.count, self.of[source])
        for n in np.unique(fan[fan > 1]).tolist():
            rows = trie.first[:-1][fan == n][:, None] + np.arange(n)
            for a in range(0, len(rows), step := max(1, CELLS // (n * n))):
                of = source[rows[a : a + step]]
                own, bare = p[rows[a : a + step]], none[of]
                for k in range(0, n, width := max(1, CELLS // (len(of) * n))):
                    g, s = of[:, k : k + width, None], of[:, None, :]
                    own_g, bare_g, own_s, bare_s = own[:, k : k + width, None], bare[:, k : k + width, None], own[:, None, :], bare[:, None, :]
                    both = divergence(own_g, own_s) - divergence(own_g, bare_s) - divergence(bare_g, own_s) + divergence(bare_g, bare_s)
                    g, s = np.broadcast_arrays(g, s)
                    mine = (g >= low) & (g < high)
                    np.add.at(out, (g[mine] - low, s[mine]), both[mine])
        return out

    def candidates(self, trie: RadixTrie, source: np.ndarray, top: int) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
        """Of each source that occurs, its ``top`` terms above the language's share: (-value, term), ties in UTF-8 order."""
        leaf = np.repeat(np.arange(len(trie)), np.diff(trie.first))
        total = np.add.reduceat(trie.count, trie.first[:-1])
        p, q = share(trie.count, self.of[source]), share(total, np.int64(self.all))[leaf]
        value = divergence(p, q)
        for s in np.unique(source).tolist():
            mine = np.flatnonzero((source == s) & (p > q))
            best = mine[np.argsort(-value[mine], kind="stable")[:top]]
            yield s, [(-int(value[i]), trie.terms[leaf[i]]) for i in best.tolist()]


def _judged(kept: DataFrame, languages: dict[str, Sources], top: int) -> DataFrame:
    """lang, source, part, item, value: sums by pair and candidate terms of each task's tries."""
    schema = "lang string, source string, part string, item binary, value bigint"

    def read(own):  # one by one: as bytes they are a fraction of what they are in use
        for data, numbers in own:
            trie = RadixTrie.from_bytes(data)
            yield trie, numbers[trie.source]

    def judge(batches):
        pieces = defaultdict(list)
        for batch in batches:
            for r in batch.to_pylist():
                pieces[r["lang"]].append((r["trie"], np.array([languages[r["lang"]].place[s] for s in r["sources"]], np.int64)))
        for lang, own in pieces.items():
            of = languages[lang]
            names = np.array([n.encode() for n in of.names], object)
            best = defaultdict(list)
            for trie, source in read(own):
                for s, found in of.candidates(trie, source, top):
                    best[s] = list(heapq.merge(best[s], found))[:top]
            rows = [{"lang": lang, "source": of.names[s], "part": "term", "item": t, "value": -v} for s, found in best.items() for v, t in found]
            yield from _table(rows, schema).to_batches()
            for low in range(0, len(of.names), SOURCES):
                high = min(low + SOURCES, len(of.names))
                sums = sum(of.added(trie, source, low, high) for trie, source in read(own))
                for g, s in ((g, np.flatnonzero(np.arange(len(of.names)) != g)) for g in range(low, high)):
                    n = len(s)
                    columns = [pa.array([lang] * n, pa.string()), pa.array([of.names[g]] * n, pa.string()), pa.array(["pair"] * n, pa.string()), pa.array(names[s], pa.binary()), pa.array(sums[g - low, s])]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "part", "item", "value"])

    return kept.select("lang", "sources", "trie").mapInArrow(judge, schema)


def _rest(groups: DataFrame) -> DataFrame:
    """lang, source, part, item, value: each source against each other of its language, over all terms as if neither had any."""
    own = groups.withColumn("p", F.when(F.col("kept") > 0, 1 + F.expr(f"{ONE} div (occurrences + kept)")))
    other = own.select("lang", F.col("source").alias("item"), F.col("p").alias("q"))
    value = F.coalesce(F.col("kept") * F.expr("(p - q) * (p - q) div q"), F.lit(0).cast("bigint"))
    return own.join(other, "lang").where("source != item").select("lang", "source", F.lit("pair").alias("part"), F.col("item").cast("binary").alias("item"), value.alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = 3, top: int = 200, range_bytes: int = RANGE_BYTES, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """How far each source's use of words is from every other source's of its language, and by which terms from its language's.

    Terms are runs of letters and non-ASCII characters with A-Z lowered. A language keeps its V terms in at least
    ``min_docs`` of its documents. A group (a source of a language, or the language) gives a term that it has c times the
    share p = 1 + floor(10^9 (c + 1) / (N + V)), N being its occurrences of all kept terms. Divergence from a share q is
    floor((p - q)^2 / q). Returns lang, source, part, item, value, rank:

    * part ``pair``: item is each other source of the language, value the sum over all kept terms.
    * part ``term``: item is a term of the source with a share above the language's, the ``top`` first.

    Ranks go by value, descending, then by the items' bytes. Null text, language or source is an empty one, which is a
    language or source like others. Each row is a document, rows that repeat too. A source without kept terms gives each
    the least share; without kept terms in the language all its values are 0. An empty table gives no rows; other columns
    and ids are ignored. Texts and terms of any length are taken whole.
    """
    rows = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).alias("text"))
    pieces = written(_counted(rows), "tries")
    kept = written(_merged(pieces, min_docs, range_bytes), "kept-tries")
    # Groups are few: the report has a row for each two of them in a language.
    number = kept.groupBy("lang").agg(F.sum("leaves").alias("kept"))
    occurs = kept.select("lang", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("totals").alias("n")))).groupBy("lang", "source").agg(F.sum("n").alias("occurrences"))
    zero = F.lit(0).cast("bigint")
    groups = rows.select("lang", "source").distinct().join(number, "lang", "left").join(occurs, ["lang", "source"], "left")
    groups = written(groups.select("lang", "source", F.coalesce("kept", zero).alias("kept"), F.coalesce("occurrences", zero).alias("occurrences")), "groups")
    by_lang = defaultdict(list)
    for r in groups.collect():
        by_lang[r.lang].append(r)
    languages = {}
    for lang, own in by_lang.items():
        own.sort(key=lambda r: r.source.encode())
        languages[lang] = Sources([r.source for r in own], [r.occurrences for r in own], own[0].kept)
    found = written(_judged(kept, languages, top), "divergences")
    by = ["lang", "source"]
    pairs = found.where("part = 'pair'").unionByName(_rest(groups)).groupBy(*by, "part", "item").agg(F.sum("value").cast("bigint").alias("value"))
    return _ranked(pairs, by, None).unionByName(_ranked(found.where("part = 'term'"), by, top))


def _ranked(rows: DataFrame, by: list[str], top: int | None) -> DataFrame:
    rank: Column = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "item")).alias("rank")
    out = rows.select(*by, "part", "item", "value", rank)
    return (out if top is None else out.where(F.col("rank") <= top)).select(*by, "part", F.col("item").cast("string").alias("item"), "value", "rank")
