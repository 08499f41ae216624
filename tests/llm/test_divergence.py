"""Divergence of sources against brute force; tries against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import divergence as dv
from tidemark.llm import queries
from tidemark.llm.tries import RadixTrie

from .fixtures import collected, empty, nasty, ordered, passage, rows

NAMES = ("lang", "source", "part", "item", "value", "rank")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def by_hand(known, least=3, top=200):
    """``known``: (lang, source, text)."""
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in known):
        terms = [t.translate(LOWER) for t in TERM.findall(text)]
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    f = lambda p, q: (p - q) * (p - q) // q
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= least]
        own = {s: counts[lang, s] for of, s in counts if of == lang}
        whole = Counter()
        for c in own.values():
            whole.update(c)

        def shares(c):
            of = sum(c[u] for u in kept) + len(kept)  # noqa: B023
            return {t: 1 + 10**9 * (c[t] + 1) // of for t in kept}  # noqa: B023

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, x.decode(), -v, i + 1) for i, (v, x) in enumerate(found)]
    return out


def planted(rng, n):
    vocabulary = [passage(k, 1).split()[0] for k in range(60)] + ["Éa", "éa", "x", "ß", "漢字", "z" * 70, "z" * 71, "z" * 69 + "y"]
    out = []
    for _ in range(n):
        lang = rng.choice(("en", "en", "en", "de", "", None))
        source = rng.choice(("s0", "s0", "s1", "s2", "É", "s10", None))
        words = rng.choices(vocabulary, [1 / (1 + i % 23) for i in range(len(vocabulary))], k=rng.randrange(0, 40))
        out.append((lang, source, rng.choice((" ", "-", "7", "\n")).join(w.title() if rng.random() < 0.3 else w for w in words)))
    return [*out, *out[:7], ("xx", "alone", "one two"), ("yy", "a", "rare"), ("yy", "b", None), ("zz", "a", "same same"), ("zz", "b", "same"), ("zz", "c", "same")]


terms = st.lists(st.text(st.sampled_from("abé漢"), min_size=1, max_size=60).map(str.encode), max_size=30)


@given(st.lists(terms, min_size=1, max_size=4), terms)
@settings(max_examples=60, deadline=None)
def test_tries_round_trip_cut_and_merge(docs, bounds):
    tries, whole, held = [], Counter(), Counter()
    for d in docs:
        tries.append(RadixTrie.counted(Counter(set(d)), [Counter(d), Counter(d[:3])]))
        whole.update((t, 0) for t in d)
        whole.update((t, 1) for t in d[:3])
        held.update(set(d))
    tries = [RadixTrie.from_bytes(t.to_bytes()) for t in tries]
    assert [t.terms for t in tries] == [sorted(set(d)) for d in docs]
    for least in (1, 2):
        m = RadixTrie.merged(tries, [np.array([0, 1])] * len(tries), least)
        assert m.terms == sorted(t for t, n in held.items() if n >= least)
        got = {(t, int(m.source[k])): int(m.count[k]) for i, t in enumerate(m.terms) for k in range(m.first[i], m.first[i + 1])}
        assert got == {(t, s): n for (t, s), n in whole.items() if held[t] >= least}
    bounds = sorted(set(bounds))
    parts = list(m.cut(bounds))
    assert [t for _, p in parts for t in p.terms] == m.terms
    assert all(sum(b <= t for b in bounds) == i for i, p in parts for t in p.terms)


def test_shares_of_very_large_counts():
    counts, of = [0, 5, 10**10, 7 * 10**14], [9, 10, 3 * 10**10, 8 * 10**14 + 1]
    assert dv.share(np.array(counts), np.array(of)).tolist() == [1 + 10**9 * (c + 1) // n for c, n in zip(counts, of, strict=True)]
    assert dv.share(np.array(counts[:2]), np.array(of[:2])).tolist() == [1 + 10**9 * (c + 1) // n for c, n in zip(counts[:2], of[:2], strict=True)]


@pytest.mark.parametrize(("gathered", "leaves", "size", "cells", "sources"), [(500_000, 4096, 4 << 20, 1 << 20, 512), (50, 7, 300, 40, 2)])
def test_planted_sources(spark, monkeypatch, gathered, leaves, size, cells, sources):
    for name, value in (("GATHERED", gathered), ("LEAVES", leaves), ("CELLS", cells), ("SOURCES", sources), ("SLICE", size)):
        monkeypatch.setattr(dv, name, value)
    known = planted(random.Random(1), 300)
    docs = spark.createDataFrame(known, "lang string, source string, text string").repartition(4)
    expect = by_hand(known, 3, 20)
    assert {r[2] for r in expect} == {"pair", "term"}
    assert collected(dv.source_divergence(docs, 3, 20, size), *NAMES) == ordered(expect)


def test_odd_rows(spark):
    known = [(r[2], r[3], r[1]) for r in rows()]
    for least in (1, 3):
        assert collected(dv.source_divergence(nasty(spark), least), *NAMES) == ordered(by_hand(known, least))
    assert dv.source_divergence(empty(spark)).count() == 0 and dv.source_divergence(empty(spark)).columns == list(NAMES)


def test_very_long_texts(spark):
    known = [("en", "a", passage(3, 300_000)), ("en", "b", "x" * 3_000_000 + " " + passage(3, 50)), ("en", "c", "x" * 3_000_000 + " y"), ("en", "c", "x" * 3_000_000)]
    got = dv.source_divergence(spark.createDataFrame(known, "lang string, source string, text string").repartition(2), 1)
    assert collected(got, *NAMES) == ordered(by_hand(known, 1))


def test_query_as_duckdb(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op11_source_divergence"]).fetchall()
    got = collected(queries.QUERIES["op11_source_divergence"](spark, small), *NAMES)
    assert got == ordered(want)
    t = pq.read_table(f"{small}/documents.parquet")
    assert got == ordered(by_hand(list(zip(*(t[c].to_pylist() for c in ("lang", "source", "text")), strict=True))))
