"""Token counts, packing, byte-pair encoding and token files against the tokenizers library."""

import hashlib
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.bpe import SHORT, WordBpe, bpe_round_trip
from tidemark.llm.packing import Packer, attention_cost, pack_documents
from tidemark.llm.token_counts import token_counts
from tidemark.llm.token_store import EliasFano, read_token_files, write_token_files
from tidemark.llm.units import _ODD, LONG_SPACE, UnitIds

from .fixtures import collected, empty, id_texts, nasty, ordered, rows, texts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def byte_ids():
    return library(BYTE)


@pytest.fixture(scope="module")
def word_ids():
    return library(WORD)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def all_rows(tiny):
    return [(r[0], r[1]) for r in rows()], id_texts(tiny)


@pytest.mark.parametrize(("which", "head"), [(0, 200_000), (1, 200_000), (0, 5), (1, 300)])
def test_token_counts(spark, tiny, byte_ids, which, head):
    docs = nasty(spark) if which == 0 else spark.read.parquet(f"{tiny}/documents.parquet")
    expect = [(i, len((t or "").encode()), n, n > 1024) for i, t in all_rows(tiny)[which] for n in [len(byte_ids(t))]]
    assert collected(token_counts(docs, BYTE, head=head), "doc_id", "n_bytes", "n_tokens", "over_limit") == ordered(expect)


def test_special_tokens_and_white_space_as_the_library(byte_ids, word_ids):
    rng = random.Random(4)
    bits = ["a", "Bc", " ", "  ", "\n", "\n\n", "\t", "\r\n", "<|endoftext|>", "<|startoftext|>", "it's", "12", "é", "\u3000", "!!", "<|", "|>"]
    mixed = ["a\n\n<|endoftext|>b", "a \n<|endoftext|>", *("".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(3000))]
    for path, ids in ((BYTE, byte_ids), (WORD, word_ids)):
        got = [np.frombuffer(b, "<u4").tolist() for b in UnitIds(path).encode(mixed)]
        assert got == [ids(t) for t in mixed]
    bpe, whole = WordBpe(WORD), Tokenizer.from_file(WORD)
    for text in mixed:
        ids = word_ids(text)
        assert bpe.encode(text) == ids
        assert bpe.decode(ids) == whole.decode(ids, skip_special_tokens=False)


def test_unit_ids_as_the_library(tiny, byte_ids, word_ids):
    every = [t or "" for t in texts()] + [t or "" for _, t in id_texts(tiny)]
    for path, ids in ((BYTE, byte_ids), (WORD, word_ids)):
        got = [np.frombuffer(b, "<u4").tolist() for b in UnitIds(path, limit=100).encode(every)]
        assert got == [ids(t) for t in every]


def mixed_texts(n):
    rng = random.Random(5)
    odd = [chr(c) for c in range(0x10000) if _ODD.match(chr(c))]
    bits = [*odd, *" \t\n\r '!1aB", "  ", "   ", "\r\n", "'s", "'LL", "word", "É", "e\u0301", "漢", "😀", "<|", "<|endoftext|>"]
    return ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(n)]


def test_byte_level_texts_are_encoded_without_a_dictionary_of_units(byte_ids):
    every = [t or "" for t in texts()] + mixed_texts(5000)
    encoder = UnitIds(BYTE)
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(every)] == [byte_ids(t) for t in every]
    assert not encoder.new and not encoder.old


def test_byte_level_units_as_the_library(byte_ids):
    encoder = UnitIds(BYTE)
    for text in [t or "" for t in texts()] + mixed_texts(5000):
        units = encoder.split(text)
        ids = encoder.learn(units)
        assert [i for u in units for i in np.frombuffer(ids[u], "<u4").tolist()] == byte_ids(text)


def test_both_loops_cut_at_the_same_code_points(byte_ids):
    encoder = UnitIds(BYTE)
    for c in map(chr, [*range(0x3400), *range(0xA000, 0xD800), *range(0xE000, 0x20000)]):
        text = f"a{c}1{c}!{c} {c}{c}  {c}\n{c}a"
        assert encoder.loop(text) == byte_ids(text), hex(ord(c))


@pytest.mark.parametrize("text", [" " * 1_200_000 + "a", "a" + "\r\n" * 600_000, "\t" * 1_100_000, "a" + "\n" * LONG_SPACE + "b", " " * (LONG_SPACE - 1)])
def test_very_long_white_space(byte_ids, text):
    encoder, ids = UnitIds(BYTE), byte_ids(text)
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids
    units = encoder.split(text)
    known = encoder.learn(units)
    assert [i for u in units for i in np.frombuffer(known[u], "<u4").tolist()] == ids


def test_operators_on_very_long_white_space(spark, byte_ids):
    known = [(1, "a" + " " * 1_100_000 + "b"), (2, "c")]
    docs, n = spark.createDataFrame(known, "doc_id bigint, text string"), {i: len(byte_ids(t)) for i, t in known}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, BYTE).collect()} == n
    assert {r.doc_id: r.doc_tokens for r in pack_documents(docs, BYTE).collect()} == {i: k + 1 for i, k in n.items()}


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_each_token_is_one_token_of_its_own_and_ids_rise_with_merges(path):
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    assert all(a < b for a, b in zip(made, made[1:]))


@pytest.mark.parametrize("which", [0, 1])
def test_packing_gives_every_id_once(spark, tiny, byte_ids, which):
    docs = nasty(spark) if which == 0 else spark.read.parquet(f"{tiny}/documents.parquet")
    found = pack_documents(docs, BYTE).collect()
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    padding = total = 0
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        total += at
    tails = sum(sum(n for _, n in held) < 2048 - 16 for held in sequences.values())
    assert tails <= (3 if which == 0 else 1) and padding <= 2048 * tails + 0.008 * total  # one for each scan partition
    wanted = defaultdict(list)
    for i, t in all_rows(tiny)[which]:
        wanted[i].append([*byte_ids(t), 1])
    assert wanted.keys() == pieces.keys()
    for i, texts_of in wanted.items():
        if len(texts_of) == 1:
            at = 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(texts_of[0]) and r.ids_crc32 == crc(texts_of[0][at : at + r.length])
                at += r.length
            assert at == len(texts_of[0])
        else:
            assert sum(r.length for r in pieces[i]) == sum(map(len, texts_of))


@pytest.mark.parametrize(("n", "pool"), [(0, 8), (1, 8), (5, 8), (400, 8), (3000, 64)])
def test_packer_cuts_few_documents_and_leaves_little_padding(n, pool):
    rng = np.random.default_rng(1)
    sizes = np.minimum(rng.lognormal(5.5, 1.2, n).astype(int) + 1, 2048).tolist()
    packer = Packer(2048, pool, 1.0, 1 / 1024)
    done = [s for d, size in enumerate(sizes) for s in packer.add(size, (d,))]
    most = len(packer.open) + len(packer.waiting)
    done += packer.finish()
    got, pieces = defaultdict(list), 0
    for held in done:
        assert 0 < sum(k for *_, k in held) <= 2048
        for (doc,), start, k in held:
            got[doc].append((start, k))
            pieces += 1
    for doc, size in enumerate(sizes):
        at = 0
        for start, k in sorted(got[doc]):
            assert start == at
            at += k
        assert at == size
    cut = sum(len(p) > 1 for p in got.values())
    assert cut <= 2 * pool and (n < 3000 or cut <= 0.02 * n)
    assert sum(2048 - sum(k for *_, k in held) for held in done) <= 2048 + 16 * len(done)
    assert most <= 3000 and sum(sum(k for *_, k in held) < 256 for held in done) <= 1


@pytest.mark.parametrize("size", [1100, 2040, 2048, 1, 683])
def test_packer_holds_a_bounded_number_of_documents(size):
    packer = Packer(2048, 16, 1.0, 1 / 1024)
    done, most = [], 0
    for d in range(2000):
        done += packer.add(size, (d,))
        most = max(most, len(packer.open) + packer.tokens // 2048)
    done += packer.finish()
    assert most <= 16 * 4 and sum(k for held in done for *_, k in held) == 2000 * size
    assert sum(2048 - sum(k for *_, k in held) for held in done) <= 2048 + 16 * len(done)


def test_packer_balances_the_cost_of_attention():
    rng = np.random.default_rng(2)
    packer = Packer(2048, 64, 1.0, 1 / 1024)
    done = [s for d, size in enumerate(rng.integers(20, 1000, 4000).tolist()) for s in packer.add(size, (d,))]
    cost = np.array([sum(attention_cost(k, 1.0, 1 / 1024) for *_, k in held) for held in done])
    assert len(done) > 500 and cost.std() < 0.12 * cost.mean()


@pytest.mark.parametrize("which", [0, 1])
def test_bpe_round_trip(spark, tiny, word_ids, which):
    t = Tokenizer.from_file(WORD)
    t.no_truncation()
    docs = nasty(spark) if which == 0 else spark.read.parquet(f"{tiny}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expect = [(i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))) for i, x in all_rows(tiny)[which] for ids in [word_ids(x)]]
    assert collected(bpe_round_trip(docs, WORD), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ordered(expect)


def test_bpe_long_words_take_the_same_merges(word_ids):
    bpe = WordBpe(WORD)
    for text in ("ab" * 200, "hello" * 60, "é" * 120, "mississippi" * 30):
        assert len(text.encode()) > SHORT
        assert bpe.encode(text) == word_ids(text)


def test_bpe_keeps_ids_and_text(spark):
    docs = spark.createDataFrame([(1, "Hello there")], "doc_id bigint, text string")
    r = bpe_round_trip(docs, WORD, keep=True).first()
    assert r.ids and len(r.ids) == r.n_tokens and r.decoded.startswith("hello")


@pytest.mark.parametrize("which", [0, 1])
def test_token_files(spark, tiny, word_ids, tmp_path, which):
    docs = nasty(spark) if which == 0 else spark.read.parquet(f"{tiny}/documents.parquet")
    write_token_files(docs, f"file://{tmp_path}/ids", WORD, block_ids=5000)
    expect, start = [], 0
    for i, t in sorted(all_rows(tiny)[which], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*word_ids(t), 1]
        expect.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert collected(read_token_files(spark, f"file://{tmp_path}/ids"), "doc_id", "start", "n_tokens", "ids_crc32") == ordered(expect)


def test_elias_fano_selects():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (70, 5), (500, 1 << 20), (2000, 3000)):
        values = np.sort(rng.integers(0, top, n))
        ef = EliasFano.build(values)
        assert [ef.select(j) for j in range(n)] == values.tolist()
        assert len(ef.low) + len(ef.high) <= n * (3 + np.log2(max(top / n, 1))) / 8 + 16
    wide = np.array([0, 1, 1, 2**40, 2**63 + 5], np.uint64)
    assert [EliasFano.build(wide).select(j) for j in range(5)] == wide.tolist()


def test_offsets_come_from_select(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    write_token_files(docs, f"file://{tmp_path}/ids", WORD)
    files = spark.read.parquet(f"file://{tmp_path}/ids")
    assert not any("array" in kind for _, kind in files.dtypes)
    plan = read_token_files(spark, f"file://{tmp_path}/ids")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_doc_ids_far_apart(spark, tmp_path, word_ids):
    ids = [-(2**63), -7, 0, 3, 3, 2**62, 2**63 - 1, None]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id bigint, text string").repartition(3)
    write_token_files(docs, f"file://{tmp_path}/far", WORD, block_ids=9)
    got = [(r.doc_id, r.n_tokens) for r in read_token_files(spark, f"file://{tmp_path}/far").orderBy("start").collect()]
    assert [i for i, _ in got] == [None, *ids[:-1]] and all(n == len(word_ids(f"text {i}")) + 1 for i, n in got)


def test_empty_tables(spark, tmp_path):
    assert token_counts(empty(spark), BYTE).count() == 0
    assert pack_documents(empty(spark), BYTE).count() == 0
    assert bpe_round_trip(empty(spark), WORD).count() == 0
    write_token_files(empty(spark), f"file://{tmp_path}/none", WORD)
    assert read_token_files(spark, f"file://{tmp_path}/none").count() == 0
