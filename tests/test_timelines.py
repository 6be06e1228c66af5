"""Edge cases of joins in time, folds and windows."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import folds, joins, ranking, windows


def slides(spark, rows, duration, least=3.0):
    events = spark.createDataFrame([(1, float(t), i, inc) for i, (t, inc) in enumerate(rows)], "job long, t double, id long, inc boolean")
    durations = spark.createDataFrame([(1, float(duration))], "job long, duration double")
    out = windows.slides(events, "job", "t", "id", F.col("inc"), durations, least).orderBy("slide_number").collect()
    return [(r["slide_number"], r["start"], r["end"], r["is_incremental"], r["parent_slide_number"]) for r in out]


@pytest.mark.parametrize(
    ("rows", "duration", "expected"),
    [
        ([], 300, [(1, 0, 300)]),
        ([60], 120, [(1, 0, 60), (2, 60, 120)]),
        ([30, 60, 90], 120, [(1, 0, 30), (2, 30, 60), (3, 60, 90), (4, 90, 120)]),
        ([10, 11, 12, 60], 120, [(1, 0, 10), (2, 10, 60), (3, 60, 120)]),
        ([2], 120, [(1, 0, 120)]),
        ([3], 120, [(1, 3, 120)]),
        ([10, 12, 14], 60, [(1, 0, 10), (2, 10, 14), (3, 14, 60)]),
    ],
)
def test_slides(spark, rows, duration, expected):
    assert [s[:3] for s in slides(spark, [(t, False) for t in rows], duration)] == expected


def test_incremental_slides(spark):
    assert slides(spark, [(30, False), (60, True), (90, False)], 120) == [(1, 0, 30, False, None), (2, 30, 90, False, None), (3, 90, 120, False, None), (4, 60, 120, True, 2)]


def test_incremental_before_any_start_has_no_parent(spark):
    assert slides(spark, [(1, True), (3, False)], 10)[-1] == (2, 1, 10, True, None)


@pytest.mark.parametrize(
    ("tie", "miss", "expected"),
    [("first", "drop", {10: 1, 15: 1, 25: 3}), ("first", "first", {-1: 0, 10: 1, 15: 1, 25: 3}), ("last", "first", {-1: 0, 10: 2, 15: 2, 25: 3}), ("last", "null", {-1: None, 10: 2, 15: 2, 25: 3}), ("first", "zero", {-1: 0, 10: 1, 15: 1, 25: 3})],
)
def test_asof(spark, tie, miss, expected):
    lines = spark.createDataFrame([(1, 0.0, 0), (1, 10.0, 1), (1, 10.0, 2), (1, 20.0, 3)], "k long, t double, i long")
    probes = spark.createDataFrame([(1, float(t)) for t in (-1, 10, 15, 25)], "k long, t double")
    assert {r["t"]: r["i"] for r in joins.asof(probes, lines, "k", "t", ["i"], "i", tie, miss).collect()} == expected


def test_overlap_bounds_are_strict_and_buckets_change_nothing(spark):
    spans = spark.createDataFrame([(1, 1, 0.0, 60.0), (1, 2, 60.0, 120.0)], "k long, n long, start double, end double")
    parts = spark.createDataFrame([(1, "zero", 60.0, 60.0), (1, "both", 50.0, 70.0), (1, "second", 60.0, 61.0)], "k long, name string, part_start double, part_end double")
    expected = {(1, "both"), (2, "both"), (2, "second")}
    for width in (None, 7.0, 1000.0):
        out = joins.overlap(spans, parts, "k", width).collect()
        assert sorted((r["n"], r["name"]) for r in out) == sorted(expected)


@pytest.mark.parametrize(("sizes", "expected"), [([4, 4, 4], [2, 1]), ([9, 5, 5], [1, 1, 1]), ([9, 5, 4], [1, 2]), ([40], [1]), ([], [])])
def test_greedy_packing(spark, sizes, expected):
    row = spark.createDataFrame([([(float(i), "x" * n) for i, n in enumerate(sizes)],)], "items array<struct<ts: double, text: string>>")
    out = row.select(folds.packed(F.col("items"), 10).alias("s")).first()["s"]
    assert [s["n_items"] for s in out] == expected
    assert [s["sequence"] for s in out] == list(range(len(expected)))


def test_admission(spark):
    rows = spark.createDataFrame(list(enumerate("AAABBC")), "at long, user string")
    out = folds.admitted(rows, "user", ["at"], 4, 2).orderBy("at").collect()
    assert [r["queue_reason"] for r in out] == [None, None, "per-user", None, None, "global"]


def test_anchored_fold_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = spark.range(2000).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).cast("double").alias("t"), "id")
    kept = {}
    for r in folds.anchored(rows, "k", "t", 5.0, "id").where("kept").collect():
        kept.setdefault(r["k"], set()).add(r["t"])
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert kept[0] == {float(t) for t in range(5, 667, 5)}


def test_queue_position(spark):
    rows = spark.createDataFrame([(1, 1, "q"), (2, 1, "q"), (3, 2, "q"), (4, 0, "r"), (5, None, "q")], "id long, at long, state string").withColumn("one", F.lit(1))
    out = windows.queue_position(rows, F.col("state") == "q", "at", ["one"]).orderBy("id").collect()
    assert [r["queue_position"] for r in out] == [1, 1, 3, None, 1]


@pytest.mark.parametrize(("t", "ends"), [("Wow!", True), ("Dr. Smith is here.", True), ("etc.", False), ("U.", False), ("hmm...", False), ("costs $5.", False), ("Python 3.12.", False), ("config.py.", False), ("", False), ("no", False)])
def test_sentence_end(spark, t, ends):
    assert spark.createDataFrame([(t,)], "t string").select(text.ends_sentence(F.col("t")).alias("e")).first()["e"] is ends


@pytest.mark.parametrize(
    ("t", "answer"),
    [("plain", "plain"), ("a<think>x</think> b", "a b"), ("a <think>x", "a"), ("Thinking process: x", ""), ("Here's a thinking process [output] draft FINAL ANSWER: yes ", "yes"), (None, None)],
)
def test_strip_reasoning(spark, t, answer):
    assert spark.createDataFrame([(t,)], "t string").select(text.strip_reasoning(F.col("t")).alias("a")).first()["a"] == answer


def test_page_checks_its_bounds(spark):
    with pytest.raises(ValueError, match="out of range"):
        ranking.page(spark.range(3), [F.col("id")], 0, 101)
