"""The trie against brute force, whatever the ranges and tree sizes; queries against SQL are in test_llm_queries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import prefix_trie
from tallyloom.llm.prefix_trie import RESULT, Direct, Indexed, Node, Sorted, Tree, conversation_trie, rebuilt, trie

WHITE = " \t\n\x0b\x0c\r"


def words(text):
    return len("".join(" " if c in WHITE else c for c in text).split(" ")) - "".join(" " if c in WHITE else c for c in text).split(" ").count("")


def sequences(rows):
    """Rebuilt turns of each conversation of (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], text))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = turns.get(base, [])[:h] + mine[h:]
    return out


def brute(seqs):
    """Rows of RESULT from sequences by conversation id."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(seqs):
        s = tuple(seqs[c])
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += children[k] == 0
        saved[k] += (len(members[k]) - 1) * (words(k[-1][1]) if k else 0)
        if k:
            children[k[:-1]] += 1
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(map(repr, [(m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], sha(ends[k])) for k, m in members.items()]))


def found(df):
    assert df.columns == RESULT
    return sorted(repr(tuple(r)) for r in df.collect())


def strings(spark, seqs, parts):
    key = {c: b"".join(hashlib.sha256(repr(t).encode()).digest()[:16] for t in s) for c, s in seqs.items()}
    return spark.createDataFrame([(c, bytearray(key[c]), [words(t[1]) for t in s]) for c, s in seqs.items()], "conv_id long, key binary, words array<int>").repartition(parts)


def random_sequences(n, seed, kinds=3, longest=6):
    rng = random.Random(seed)
    turn = lambda: ("user", "word " * rng.randrange(kinds))
    return {rng.randrange(10**6): [turn() for _ in range(rng.randrange(longest))] for _ in range(n)}


@pytest.mark.parametrize("tree_turns", [1, 7, 100_000])
@pytest.mark.parametrize("seed, kinds, longest", [(1, 2, 6), (2, 4, 4), (3, 1, 12)])
def test_any_cut_into_trees_gives_the_same_nodes(spark, monkeypatch, tree_turns, seed, kinds, longest):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    seqs = random_sequences(250, seed, kinds, longest)
    assert found(trie(strings(spark, seqs, 3), tree_turns)) == brute(seqs)


def test_copies_over_many_ranges(spark):
    seqs = {i: [("user", "a b"), ("assistant", "c")] for i in range(300)} | {1000 + i: [("user", "a b"), ("assistant", "c"), ("user", str(i % 4))] for i in range(20)} | {-5: [], -7: [("user", "a b")]}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        for turns in (1, 5, 1000):
            assert found(trie(strings(spark, seqs, 3), turns)) == brute(seqs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_layouts_grow_and_paths_are_split():
    tree, rng = Tree(), random.Random(4)
    keys = {bytes(rng.choice((b, 7)) for b in rng.randbytes(n)) for n in (1, 2, 3, 5, 9) for _ in range(700)} | {bytes([b, 1]) for b in range(256)} | {b""}
    kinds = set()
    for k in keys:
        tree.insert(k, k)
    back, work = set(), [(b"", tree.root)]
    while work:
        path, node = work.pop()
        path += node.path
        if node.ends is not None:
            assert node.ends == path
            back.add(path)
        if node.children is not None:
            kinds.add(getattr(node.children, "most", type(node.children).__name__))
            below = list(node.children.items())
            assert [b for b, _ in below] == sorted({b for b, _ in below})
            assert all(node.children.get(b) is n for b, n in below)
            work += [(path + bytes([b]), n) for b, n in below]
    assert back == keys and kinds == {4, 16, "Indexed", "Direct"}
    for layout in (Sorted(4), Sorted(16), Indexed(), Direct()):
        first, second = Node(b"x"), Node(b"y")
        assert layout.get(9) is None and layout.put(9, first) and layout.put(9, second) and layout.get(9) is second


def test_conversations_with_heads_nulls_ties_and_repeats(spark):
    rng = random.Random(6)
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(("user", "assistant", None, "")), rng.choice(("hi", " two\twords\x0b", "", None, "x\x00y", "é \x85 z"))) for c in range(-45, 130) for t in range(rng.randrange(1, 6)) if c % 20 or c % 3]
    rows += [rows[5], rows[5], (None, 1, "user", "x"), (20, 1, "user", "w " * 50_000)] + [(60, t, "user", f"t{t}") for t in range(700)]
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], "conv_id long, turn int, role string, text string, depth string, key string, prefix string").repartition(5)
    assert found(conversation_trie(df)) == brute(sequences(rows))
    assert rebuilt(df).where(F.length("key") != 16 * F.size("words")).count() == 0


def test_empty(spark):
    assert conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
