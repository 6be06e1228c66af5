"""Queries of this subpackage against their SQL, and the pipeline's stages against brute force."""

import pytest
from compare import difference
from pyspark.sql import functions as F
from test_decontamination import brute as leaks
from test_ngram_join import brute as components
from test_pii import brute as spans

import corpus_pipeline
from tallyloom.llm import pii, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert difference(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf) == ""


def test_one_query_for_each_operator():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "PII", "BPE encoding and decoding"]

    kept = stages["language ID"](spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * len(before)

    out = stages["n-gram Jaccard join"](spark, docs, sf)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == set(components([(r["doc_id"], r["text"]) for r in before]).values())

    out = stages["benchmark decontamination"](spark, docs, sf)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in out.collect()}
    assert out.columns == docs.columns and gone == {eval(x)[0] for x in leaks([(r["doc_id"], r["text"]) for r in before if len(r["text"]) < 4000], items)} | {g for g in gone if any(r["doc_id"] == g and len(r["text"]) >= 4000 for r in before)}

    out = {r["doc_id"]: r for r in stages["PII"](spark, docs, sf).collect()}
    finder = pii.train(docs)
    for r in before:
        base, every = finder.spans(r["text"])
        assert base == spans(r["text"]) and out[r["doc_id"]]["text"] == pii.redacted(r["text"], every) and out[r["doc_id"]]["n_chars"] == len(out[r["doc_id"]]["text"])
        if not any(c in r["text"] for c in "0123456789@([") and " dot " not in r["text"].lower():
            assert out[r["doc_id"]]["text"] == r["text"]

    out = stages["BPE encoding and decoding"](spark, docs, sf)
    assert out.count() == len(before) and out.where(~F.col("whole")).count() == 0


def test_pipeline_runs_through(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() <= spark.read.parquet(f"{sf}/documents.parquet").count()


def write(tmp_path, docs, benchmark):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_over_odd_rows(spark, odd, tmp_path):
    """Nulls, empty and very long texts, repeats, clashing columns; each stage on its own, then all of them."""
    items = spark.createDataFrame([(1, "zero one two three four five six"), (2, None), (None, ""), (3, "  ")], "item_id long, text string")
    sf = write(tmp_path, odd, items)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("language ID", "n-gram Jaccard join", "benchmark decontamination", "PII"):
        out = stages[name](spark, odd, sf)
        assert out.columns == odd.columns and out.count() <= odd.count()
    assert {r["doc_id"] for r in stages["n-gram Jaccard join"](spark, odd, sf).collect()} == {1, 2, 3, 4, 5, 6, None}
    assert stages["benchmark decontamination"](spark, odd, sf).count() == odd.count()
    assert sorted(str(r["text"])[:50] for r in stages["PII"](spark, odd, sf).collect()) == sorted(str(r["text"])[:50] for r in odd.collect())
    out = stages["BPE encoding and decoding"](spark, odd, sf)
    assert out.count() == odd.count() and set(out.columns) == (set(odd.columns) - {"text"}) | {"n_tokens", "ids", "whole"} and out.where("NOT whole").count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} <= {1, 4, None}


def test_pipeline_over_nothing(spark, nothing, tmp_path):
    sf = write(tmp_path, nothing, spark.createDataFrame([], "item_id long, text string"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_scratch_tables_are_deleted(spark, documents):
    import os

    from tallyloom.llm import graph, ngram_join

    with graph.scratch(spark):
        count = ngram_join.classes(documents).count()
        made = list(graph._made)
    assert count == documents.count() and made and not any(os.path.exists(p) for p in made if p not in graph._made)


def test_samples_are_never_empty():
    from tallyloom.llm.kernel import sample_bound

    for total in (20_001, 10**6, 10**12, 10**15):
        assert abs(sample_bound(20_000, total) * total / 2**63 - 20_000) <= 1 or sample_bound(20_000, total) > 0
    assert sample_bound(20_000, 10**12) > 10**11 and sample_bound(5, 5) == 1 << 63
