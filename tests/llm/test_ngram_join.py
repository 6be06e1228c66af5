import random

import pytest

from tallyloom.llm import graph, ngram_join


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    """component of each id, by all pairs"""
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    of = [(i, sets(t)) for i, t in rows if i is not None]
    for n, (i, a) in enumerate(of):
        for j, b in of[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in parent}


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    expected, out = brute(rows), ngram_join.classes(df).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"])) for r in out) == sorted(str((i, len(sets(t)))) for i, t in rows)
    assert {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None} == expected


def test_documents(documents):
    check(documents)


def test_odd_rows(odd, nothing):
    check(odd)
    assert ngram_join.classes(nothing).count() == 0


@pytest.fixture(scope="module")
def families(spark):
    """Chains and groups of near copies around the bound, containments, copies and a common passage."""
    random.seed(11)
    words = [f"w{i}" for i in range(400)]
    passage = [random.choice(words) for _ in range(40)]
    rows = []
    for _ in range(12):
        base = [random.choice(words) for _ in range(random.randint(3, 120))]
        for _ in range(12):
            new = list(base)
            for _ in range(random.choice([0, 1, 1, 2, 3, 5])):
                new[random.randrange(len(new))] = random.choice(words)
            if random.random() < 0.3:
                new = new[: int(len(new) * random.uniform(0.75, 1))] or new
            if random.random() < 0.3:
                new = new + [random.choice(words) for _ in range(random.randint(1, 20))]
            rows.append(" ".join(new))
    rows += [" ".join(passage + [random.choice(words) for _ in range(random.randint(0, 60))]) for _ in range(40)]
    random.shuffle(rows)
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_families(families):
    check(families)


def test_families_with_split_columns_and_without_broadcast(families, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(ngram_join, "COLUMN_PART", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 2)
    check(families)


def test_one_of_each(families, odd):
    kept = {r["doc_id"] for r in ngram_join.one_of_each(families).collect()}
    expected = brute([(r["doc_id"], r["text"]) for r in families.collect()])
    assert kept == set(expected.values())
    out = ngram_join.one_of_each(odd)
    assert out.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(["1", "2", "3", "4", "5", "6", "None"])


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 5), (7, 7), (3, 4), (4, 9)] + [(1, i) for i in range(1000, 1100)]
    out = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out[160] == 100 and out[5] == out[9] == 3 and out[1099] == 1 and 7 not in out
    assert len(out) == 61 + 4 + 101
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
