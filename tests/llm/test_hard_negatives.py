"""Mined negatives against brute force, with ties, nulls, extreme and unequal vectors; queries against SQL are in test_llm_queries."""

import math

import numpy as np
import pytest

from tallyloom.llm import hard_negatives
from tallyloom.llm.hard_negatives import mine

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, group string, rank string"


def brute(rows):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) by comparing everything."""
    kept = []
    for i, x, label, *_ in rows:
        if i is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(c)) for c in x)))
    out = []
    for a, label, x in sorted({r for r in kept if r[0] % 50 == 0}):
        scored = [(-sum(p * q for p, q in zip(x, y, strict=False)), i, other) for i, other, y in kept if i != a]
        for p, positive, _ in sorted(s for s in scored if s[2] == label)[:5]:
            inside = sorted(s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p)[:3]
            out += [(a, positive, k + 1, s[1], -p, -s[0]) for k, s in enumerate(inside)]
    return sorted(out)


def found(spark, rows, parts=3):
    rows = [(*r, "clash", "clash", "clash")[:6] for r in rows]
    return sorted(tuple(r) for r in mine(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect())


def made(n, d=12, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(c) for c in rng.normal(size=d) * spread], int(rng.integers(0, 10))) for i in range(n)]


@pytest.mark.parametrize("seed, n, d", [(1, 700, 12), (2, 400, 3), (3, 300, 40), (4, 120, 1)])
def test_equals_brute_force(spark, seed, n, d):
    rows = made(n, d, seed)
    assert found(spark, rows) == brute(rows)


def test_small_whole_numbers_tie(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.integers(-1, 3, 4) / 16], int(rng.integers(0, 3))) for i in range(900)]
    assert found(spark, rows) == brute(rows)


def test_copies_of_one_vector(spark):
    rows = made(300, 6, 7)
    rows = [(i, rows[0][1] if i % 3 else x, label) for i, x, label in rows]
    assert found(spark, rows, 7) == brute(rows)


def test_odd_rows(spark):
    rows = made(200, 5, 8)
    rows += [(None, [1.0] * 5, 1), (1000, None, 1), (1050, [1.0, None, 1.0, 1.0, 1.0], 1), (1100, [float("nan")] * 5, 2), (1150, [float("inf")] * 5, 2), (1200, [1.0] * 5, None)]
    rows += [(1250, [], 3), (1251, [1.0, 2.0], 3), (1252, [0.5] * 9, 4), (1300, [0.0] * 5, 4), rows[50], rows[50], rows[51], rows[100]]
    assert found(spark, rows) == brute(rows)


def test_large_components_stay_exact(spark):
    rows = made(150, 5, 9, spread=3.0e5)
    assert found(spark, rows) == brute(rows)


def test_groups_of_anchors(spark, monkeypatch):
    rows = made(600, 4, 10)
    monkeypatch.setattr(hard_negatives, "GROUP_ANCHORS", 3)
    assert found(spark, rows) == brute(rows)


def test_few_and_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, made(1)) == [] and found(spark, [(7, [1.0], 1)]) == []
    rows = [(50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [0.9, 0.0], 2)]
    assert found(spark, rows) == brute(rows) != []
