import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import toxicity


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        y = int(i % 4 == 0)
        parts = [" ".join(rng.choice(words, rng.integers(4, 12))) for _ in range(rng.integers(1, 8))]
        if y:
            parts[rng.integers(len(parts))] += " nastyword" + rng.choice(["", "s", "ed"])
        docs.append((i, ". ".join(parts)))
        labels.append((i, y, 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_held_out_and_offending_sentence(made):
    docs, labels = made
    out = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").join(docs, "doc_id").where("held_out")
    right = out.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.97
    for r in out.where("predicted = 1 AND toxic = 1").collect():
        assert any("nastyword" in r["text"][s["start"] : s["end"]] for s in r["offending"])


def test_documents(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.score(documents, toxicity.train(documents, labels)).collect()
    assert len(out) == documents.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)


def test_odd_rows(spark, odd, nothing, made):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 0, 1), (7, None, 1), (None, 1, 1), (99, 1, 0)], "doc_id long, toxic int, quality int")
    assert toxicity.score(odd, toxicity.train(odd, labels)).count() == odd.count()
    weights = toxicity.train(*made)
    out = toxicity.score(odd, weights).collect()
    assert [r["score"] for r in out if r["doc_id"] in (2, 3, 5)] == [0, 0, 0]
    assert toxicity.score(nothing, toxicity.train(nothing, labels)).count() == 0
    assert {r["score"] for r in toxicity.score(odd, toxicity.train(odd, labels.where("false"))).collect()} == {0.0}


def test_sentences_do_not_cross_rows():
    import pyarrow as pa

    words, _, first, at = toxicity.sentences(pa.array(["a b. c", None, "d", "", "e! f? g\nh"]))
    assert list(np.diff(at)) == [2, 0, 1, 0, 4]
    assert list(np.diff(words.rows)) == [3, 0, 1, 0, 4]


def test_scores_against_brute_force(made, odd):
    """Noisy-or of sentence scores by plain loops over words."""
    import math
    import re

    import pyarrow as pa

    docs, labels = made
    weights = toxicity.train(docs, labels)
    rows = docs.limit(40).union(odd.select("doc_id", "text").where("length(text) < 1000 OR text IS NULL"))
    out = sorted((str(r["doc_id"]), round(r["score"], 6)) for r in toxicity.score(rows, weights).collect())
    expected = []
    for r in rows.collect():
        clean = 1.0
        for part in re.split(rb"[\n!.?]", (r["text"] or "").encode()):
            words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", part)
            if words:
                z = float(weights[-1])
                for w in words:
                    feats = toxicity.sentences(pa.array([w.decode()]))[1][0]
                    assert (feats >= 0).sum() == 1 + sum(len(w) > size for size in toxicity.PREFIXES)
                    z += sum(float(weights[f]) for f in feats if f >= 0)
                clean *= 1 - 1 / (1 + math.exp(-z))
        expected.append((str(r["doc_id"]), round(1 - clean, 6)))
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-4 for a, b in zip(out, sorted(expected), strict=True))
