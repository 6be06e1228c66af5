import pyarrow as pa
from pyspark.sql import functions as F

from tallyloom.llm import language_id


def test_held_out_accuracy(spark, documents):
    out = language_id.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right >= 0.95


def test_fold_is_not_learned_from(documents):
    import zlib

    kept = {r["doc_id"] for r in documents.where(language_id.in_training()).collect()}
    assert kept == {r["doc_id"] for r in documents.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}


def test_ngrams_do_not_cross_rows():
    both, at, has = language_id.ngrams(pa.array(["ab", None, "1 2", "c d"]))
    assert list(has) == [True, False, False, True]
    for i, t in enumerate(["ab", None, "1 2", "c d"]):
        alone, _, _ = language_id.ngrams(pa.array([t]))
        assert sorted(both[at[i] : at[i + 1]]) == sorted(alone)


def test_odd_rows(odd, nothing):
    langs, model = language_id.train(odd)
    out = language_id.detect(odd, langs, model).collect()
    assert len(out) == odd.count()
    assert [r["lang_pred"] for r in out if r["doc_id"] in (2, 3, 5, 6)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in out)
    assert language_id.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in language_id.detect(odd, *language_id.train(nothing)).collect()} == {"und"}


def test_rejection_keeps_columns(odd):
    kept = language_id.keep_identified(odd, *language_id.train(odd), least_score=0.3)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 4, 7, None}


def grams(text):
    """Buckets of the n-grams of one text by plain loops."""
    body, open_word = [32], False
    for c in (text or "").replace("\n", " ").lower():
        if c.isalpha():
            body.append(ord(c))
        elif open_word:
            body.append(32)
        open_word = c.isalpha()
    body.append(32)
    out = []
    for k in language_id.ORDERS:
        for i in range(len(body) - k + 1):
            if k == 1 and body[i] == 32:
                continue
            h = k
            for c in body[i : i + k]:
                h = (h ^ c) * 0x01000193 % 2**32
                h ^= h >> 15
            out.append((h * 0x85EBCA6B % 2**32) >> 16)
    return out


def test_against_brute_force(spark, documents):
    import math
    from collections import Counter

    rows = documents.orderBy("doc_id").limit(60).collect() + [("x", "Ünïcode 漢字 — 𠀀\U00030000!", "fr"), ("y", "\U00030000\U00030001", "de"), ("z", "... ", "en")]
    rows = [(i, r[1][:2000], r[2]) for i, r in enumerate(rows)]
    counts, docs = {}, Counter()
    for _, text, lang in rows:
        counts.setdefault(lang, Counter()).update(grams(text))
        docs[lang] += 1
    totals = {lang: sum(c.values()) + 0.1 * language_id.BUCKETS for lang, c in counts.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in language_id.detect(df, *language_id.train(df)).collect()}
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text):
            assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0)
            continue
        score = {lang: math.log((docs[lang] + 1) / (len(rows) + len(docs))) + sum(math.log((c[g] + 0.1) / totals[lang]) for g in grams(text)) for lang, c in counts.items()}
        best = max(sorted(score), key=score.get)
        post = 1 / sum(math.exp(s - score[best]) for s in score.values())
        assert out[i]["lang_pred"] == best and abs(out[i]["score"] - post) < 0.01
