"""The corpus pipeline: stages in order, each on all that its predecessor kept."""

import corpus_pipeline
from tidemark.llm import queries

from .fixtures import collected, empty, nasty


def test_stages_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    assert sum(n.startswith("op") for n in queries.QUERIES) == 13 and "pipeline" in queries.QUERIES


def test_run_equals_the_stages_one_by_one(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, last = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tiny).cache()
        assert docs.columns == columns and docs.count() <= last
        last = docs.count()
    found = collected(corpus_pipeline.run(spark, tiny), "doc_id", "doc_tokens")
    packed = collected(corpus_pipeline.packing(spark, docs, tiny), "doc_id", "doc_tokens")
    assert {i for i, _ in found} == {i for i, _ in packed} and set(found) == set(packed)


def test_stages_take_odd_tables(spark, tiny):
    for docs in (nasty(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, tiny)
            assert out.count() <= max(docs.count() * 20, 0)
