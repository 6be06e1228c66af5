import numpy as np

from tallyloom.llm import embedding_dedup


def brute(rows):
    """links and component of each row's id by all pairs"""
    good = [(i, np.array(x, float)) for i, x in rows if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x) and any(v != 0 for v in x)]
    unit = [x / np.linalg.norm(x) for _, x in good]
    links, parent = [0] * len(good), {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95:
                links[a] += 1
                links[b] += 1
                x, y = find(good[a][0]), find(good[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted((i, n) for (i, _), n in zip(good, links, strict=True)), {i: find(i) for i in parent}


def check(spark, rows, monkeypatch=None):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'clash' AS kept", "'clash' AS n_links", "1 AS label")
    links, component = brute(rows)
    out = embedding_dedup.near_duplicates(df).collect()
    assert len(out) == len(rows)
    bad = len(rows) - len(links)
    assert sorted(((r["vec_id"] if r["vec_id"] is not None else -1), r["n_links"]) for r in out)[-len(links) :] == links or bad
    assert {r["vec_id"]: r["component_id"] for r in out if r["vec_id"] is not None} == component
    return out


def test_groups_chains_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(12):
        centre = rng.normal(size=16)
        rows += [(centre + rng.normal(size=16) * s).tolist() for s in rng.choice([0.0, 0.1, 0.3, 0.6], 25)]
    rows += [rng.normal(size=16).tolist() for _ in range(100)]
    rows = [(int(i), x) for i, x in zip(rng.permutation(len(rows)), rows, strict=True)]
    check(spark, rows)


def test_one_large_group_is_dealt_over_cells(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PART_ROWS", 20)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=8)
    rows = [(i, (centre + rng.normal(size=8) * 0.2).tolist()) for i in range(300)]
    out = check(spark, rows)
    links, _ = brute(rows)
    assert sorted((r["vec_id"], r["n_links"]) for r in out) == links


def test_extreme_finite_vectors_harm_no_other(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(24, 8))
    rows = [(i, (centres[i % 24] + rng.normal(size=8) * 0.02).tolist()) for i in range(120)]
    rows += [(200, [1e300] * 8), (201, [1e-300] * 8), (202, [1e200, -1e-200] * 4), (203, [5e-324] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    links, component = brute([r for r in rows if r[0] < 200])
    assert {(i, out[i]["n_links"]) for i in range(120)} == set(links) and all(out[i]["component_id"] == component[i] for i in range(120))
    assert out[200]["component_id"] == out[201]["component_id"] == out[203]["component_id"] == 200


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 0.0]), (8, [1.0]), (9, [3.0]), (10, [])]
    out = {}
    for r in check(spark, rows):
        out.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert out[1] == [(2, 1, True)] * 2 and out[2] == [(2, 1, False)] and out[9] == [(1, 8, False)]
    assert all(out[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 10)) and out[None] == [(0, None, True)]


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
