import math
import random

import pytest

from tallyloom.llm import decontamination


def words(t):
    return (t or "").encode().lower().split()


def grams(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def brute(docs, items):
    items = [(i, words(t)) for i, t in items if words(t)]
    holders = {}
    for i, (_, w) in enumerate(items):
        for g in set(grams(w)):
            holders.setdefault(g, set()).add(i)
    weight = {g: math.log1p(len(items) / len(h)) for g, h in holders.items()}
    out = []
    for d, t in docs:
        w = words(t)
        for i, iw in items:
            own, n = set(grams(iw)), min(len(iw), len(w))
            total, best = sum(weight[g] for g in own), (0, 0)
            all_grams = grams(w)
            starts = {max(0, min(p - q, len(w) - len(iw))) for p, g in enumerate(all_grams) if g in own for q, h in enumerate(grams(iw)) if g == h}
            for start in sorted(starts):
                held = set(all_grams[start : start + max(1, n - 4)]) & own
                best = max(best, (round(sum(weight[g] for g in held) / total, 9), -start))
            if best[0] >= 0.8:
                out.append((d, i, -best[1], n, round(best[0], 6)))
    return sorted(map(str, out))


def check(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' AS item_id", "'clash' AS similarity")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'clash' AS doc_id")
    out = decontamination.find(d, b, **more).collect()
    found = sorted(str((r["doc_id"], r["item_id"], r["first_word"], r["n_words"], round(r["similarity"], 6))) for r in out)
    assert found == brute(docs, items)
    assert {r["doc_id"] for r in decontamination.clean(d, b, **more).collect()} == {i for i, _ in docs} - {r["doc_id"] for r in out}
    return out


@pytest.fixture(scope="module")
def planted():
    random.seed(8)
    vocabulary = [f"v{i}" for i in range(200)]
    text = lambda n: [random.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(random.randint(8, 40)))) for i in range(25)] + [(100, "short item"), (101, None), (102, "  ")]
    docs = []
    for i in range(120):
        body = text(random.randint(0, 90))
        if i % 3 == 0:
            item = items[random.randrange(25)][1].split()
            for _ in range(random.randint(0, 2)):
                item[random.randrange(len(item))] = "changed"
            at = random.randint(0, len(body))
            body[at:at] = item
        docs.append((i, " ".join(body).upper() if i % 2 else "\n".join(body)))
    return docs, items


def test_planted(spark, planted):
    assert len(check(spark, *planted)) > 15


def test_items_in_blocks(spark, planted):
    docs, items = planted
    ids = lambda out: {(r["doc_id"], r["item_id"]) for r in out}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([i for i in items if i[0] < 100], "item_id long, text string")
    # weights are those of a block, so borderline similarities may differ; exact passages may not
    whole, split = decontamination.find(d, b).where("similarity > 0.999").collect(), decontamination.find(d, b, max_block_chars=800).where("similarity > 0.999").collect()
    assert ids(whole) == ids(split) and whole


def test_odd_rows(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (2, ""), (3, None), (None, "x a b c d e f"), (4, "short item"), (5, "z " * 50_000 + "a b c d e f")]
    check(spark, docs, [(1, "A b c d e f"), (1, "a b c d e f"), (None, "short item"), (3, None), (4, "")])
    check(spark, docs, [(3, None)])
    check(spark, [(3, None)], [(1, "a b")])


def test_all_within_the_radius_are_found():
    import numpy as np

    rng = np.random.default_rng(4)
    items = decontamination.Items(list(range(60)), [" ".join(rng.choice(list("abcdefgh"), 20)) for _ in range(60)])
    prints = np.concatenate([items.print ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)), rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    w, i = items.near(prints)
    expected = {(a, b) for a in range(len(prints)) for b in range(60) if bin(int(prints[a] ^ items.print[b])).count("1") <= decontamination.RADIUS}
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == expected


def test_items_with_a_common_beginning(spark):
    """The rare part of an item reaches the similarity without the beginning that all items share."""
    random.seed(9)
    text = lambda n: [f"w{random.randrange(5000)}" for _ in range(n)]
    common = text(20)
    items = [(i, " ".join(common + text(20))) for i in range(60)]
    docs = [(i, " ".join(text(30) + t.split()[16:] + text(30))) for i, t in items]
    docs += [(100 + i, " ".join(text(16) + t.split()[16:])) for i, t in items]
    assert len(check(spark, docs, items)) == 120


def test_window_begins_where_its_own_item_would(spark):
    """A window of one item isn't told as another's, even if their fingerprints are near."""
    words = [f"w{i}" for i in range(40)]
    out = check(spark, [(1, " ".join(["a", "b", *words, "c"]))], [(1, " ".join(words)), (2, " ".join(words[1:])), (3, " ".join(words[:-1]))])
    assert [(r["item_id"], r["first_word"], r["n_words"]) for r in sorted(out, key=lambda r: r["item_id"])] == [(1, 2, 40), (2, 3, 39), (3, 2, 39)]


def test_blocks_change_no_similarity(spark, planted):
    """Items that share shingles across blocks, copies near 0.8."""
    random.seed(10)
    text = lambda n: [f"w{random.randrange(3000)}" for _ in range(n)]
    common = text(15)
    items = [(i, " ".join(common + text(15))) for i in range(40)] + planted[1]
    docs = [(1000 + 100 * i + k, " ".join([*t.split()[:k], "other", *t.split()[k + 1 :]])) for i, t in items[:40] for k in (7, 16, 18, 26)]
    assert len(check(spark, docs + planted[0], items, max_block_chars=800)) == len(check(spark, docs + planted[0], items)) > 60
