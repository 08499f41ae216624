"""Line deduplication against brute force."""

import hashlib
import random

import duckdb
import pytest

from tidemark.llm import line_dedup as lines
from tidemark.llm import queries

from .fixtures import collected, empty, id_texts, nasty, ordered, passage, rows

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
LEAST = -(1 << 63)


def by_hand(known, min_chars=40, min_docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holds = {}
    for i, t in known:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holds.setdefault(key(line), set()).add(LEAST if i is None else i)
    out = []
    for i, t in known:
        split = (t or "").split("\n")
        gone = [len(h) >= min_docs and max(h) != (LEAST if i is None else i) for line in split for h in [holds.get(key(line), ())]]
        kept = "\n".join(line for line, g in zip(split, gone, strict=True) if not g)
        out.append((i, len(split), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def planted(n=60, seed=4):
    rng = random.Random(seed)
    common = [passage(100 + k, 12) for k in range(8)] + ["short line", "é" * 39, "é" * 40, " " * 50]
    out = []
    for i in range(n):
        own = [passage(1000 + i * 10 + k, 9) for k in range(rng.randrange(0, 6))]
        both = own + [rng.choice(("", " ", "\t\x0b")) + (c.upper() if rng.random() < 0.3 else c) + rng.choice(("", "\r", "  \x0c")) for c in rng.choices(common, k=rng.randrange(0, 12))]
        rng.shuffle(both)
        out.append((rng.randrange(-5, 200), "\n".join(both)))
    return [*out, out[3], out[3], (None, common[0] + "\n" + common[1]), (None, common[0]), (7, None), (8, ""), (9, "\n\n" + common[2] * 2)]


@pytest.mark.parametrize("slot", [1, 3, 256])
def test_planted_lines(spark, monkeypatch, slot):
    monkeypatch.setattr(lines, "SLOT_LINES", slot)
    known = planted()
    docs = spark.createDataFrame(known, "doc_id bigint, text string").repartition(5)
    expect = by_hand(known)
    assert sum(r[2] for r in expect) > 100
    assert collected(lines.line_dedup(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == ordered([r[:4] for r in expect])


@pytest.mark.parametrize(("chars", "least"), [(40, 5), (1, 2), (0, 1), (12, 3)])
def test_odd_rows_and_limits(spark, chars, least):
    known = [(r[0], r[1]) for r in rows()]
    got = lines.line_dedup(nasty(spark), chars, least)
    assert collected(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == ordered([r[:4] for r in by_hand(known, chars, least)])
    assert lines.line_dedup(empty(spark)).count() == 0 and lines.drop_repeated_lines(empty(spark)).columns == empty(spark).columns


def test_bitmaps_joined_by_shuffle(spark, tiny, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    got = lines.line_dedup(spark.read.parquet(f"{tiny}/documents.parquet"))
    assert collected(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == ordered([r[:4] for r in by_hand(id_texts(tiny))])


def test_texts_and_clashing_columns_stay(spark):
    names = "doc_id bigint, text string, document string, print int, at int, h string, g string, slot int, lines int, stays int, runs int, held map<string,int>, kept string, n_dropped int"
    known = planted(30, 5)
    docs = spark.createDataFrame([(i, t, "d", 1, 2, "h", "g", 3, 4, 5, 6, {"a": 1}, "k", 7) for i, t in known], names)
    out = lines.drop_repeated_lines(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    texts = [(i, t if not n else kept) for (i, t), (_, _, n, _, kept) in zip(known, by_hand(known), strict=True)]
    assert collected(out, "doc_id", "text") == ordered(texts)
    assert out.where("document != 'd' or at != 2 or held['a'] != 1 or kept != 'k' or n_dropped != 7").count() == 0


def test_a_very_long_text_and_a_line_in_every_document(spark):
    line = passage(9, 10)
    known = [(0, "\n".join([line, passage(1, 8)] * 30_000)), *((i, line) for i in range(1, 2000))]
    got = lines.line_dedup(spark.createDataFrame(known, "doc_id bigint, text string"))
    by = {r.doc_id: (r.n_lines, r.n_dropped) for r in got.collect()}
    assert by == {0: (60_000, 30_000), **{i: (1, 1) for i in range(1, 1999)}, 1999: (1, 0)}


def test_query_as_duckdb_and_without_python(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_line_dedup"]).fetchall()
    got = queries.QUERIES["op12_line_dedup"](spark, small)
    assert collected(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == ordered(want)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for df in (got, lines.dropped_lines(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
