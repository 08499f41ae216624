"""Texts of several megabytes go through every operator whole."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.bpe import bpe_round_trip
from tidemark.llm.exact_dedup import exact_duplicates
from tidemark.llm.oph import fingerprint_documents
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import quality_scores
from tidemark.llm.simhash import drop_near_duplicates, near_duplicates
from tidemark.llm.substring_dedup import remove_repeated_passages
from tidemark.llm.token_counts import token_counts
from tidemark.llm.token_store import read_token_files, write_token_files
from tidemark.llm.toxicity import toxicity

from .fixtures import passage

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def known():
    long = passage(90, 450_000)
    return [(1, long), (2, "short"), (3, long.upper()), (4, "x" * 2_000_000)]


def test_texts_of_megabytes(spark, known, tmp_path):
    docs = spark.createDataFrame(known, "doc_id bigint, text string").repartition(2)
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert max(len(t) for _, t in known) > 3_000_000
    byte = Tokenizer.from_file(BYTE)
    n = {i: len(byte.encode(t, add_special_tokens=False).ids) for i, t in known}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, BYTE).collect()} == n
    packed = pack_documents(docs, BYTE).collect()
    assert {i: sum(r.length for r in packed if r.doc_id == i) for i in n} == {i: k + 1 for i, k in n.items()}
    word = Tokenizer.from_file(WORD)
    ids = {i: word.encode(t, add_special_tokens=False).ids for i, t in known}
    sha = lambda x: hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()
    assert {r.doc_id: r.ids_sha256 for r in bpe_round_trip(docs, WORD).collect()} == {i: sha(x) for i, x in ids.items()}
    write_token_files(docs, f"file://{tmp_path}/long", WORD)
    assert {r.doc_id: r.n_tokens for r in read_token_files(spark, f"file://{tmp_path}/long").collect()} == {i: len(x) + 1 for i, x in ids.items()}
    assert {r.doc_id: r.keep_id for r in exact_duplicates(docs).collect()} == {1: 3, 2: 2, 3: 3, 4: 4}
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in remove_repeated_passages(docs).collect()}
    assert removed == {1: (450_000, 0), 2: (1, 0), 3: (450_000, 0), 4: (1, 0)}
    assert len({r.component_id for r in near_duplicates(docs).where("doc_id in (1, 3)").collect()}) == 1
    assert {r.doc_id for r in drop_near_duplicates(docs).collect()} == {1, 2, 4}
    prints = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    assert prints[1].n_chars == len(known[0][1]) and prints[4].n_chars == 2_000_000
    assert quality_scores(docs, marks).count() == toxicity(docs, marks).count() == 4
