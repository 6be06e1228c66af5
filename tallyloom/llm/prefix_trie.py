"""The prefix trie of conversations, from adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is the first 16 bytes of a SHA-256 of its role and text, so a conversation is a byte string of 16 bytes a turn and equal
strings are equal turns. Strings are dealt out in ranges of their order (and of conversation ids, so that many copies of one
conversation are several ranges); a task inserts its sorted range into adaptive radix trees: inner nodes of 4, 16, 48 or 256 children
that grow as they fill, with compressed paths. A tree is emitted and begun anew after TREE_TURNS turns, so memory does not grow with
the range. Only byte depths that are multiples of 16 are nodes of the trie: they are emitted with what their subtree sums up to,
whether a tree branches there or passes through a compressed path.

What lies on the path of a tree's first or last string may go on in another tree. Such nodes are emitted as parts and added up by
Spark; where a tree's first path was begun by an earlier tree, what both have counted is put right: sums along that path, a row for
each node of it. No node, nor the root, is gathered in one task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import written
from .kernel import small_batches

TURN_BYTES = 16
#: Turns of the strings in one tree, about.
TREE_TURNS = 100_000
#: Conversation ids in one piece of a list that is hashed in order.
CHUNK_IDS = 4_096
#: Rows of shared nodes up to which they are broadcast; beyond, joins shuffle.
BROADCAST_NODES = 500_000
#: Which head a conversation takes: that of the multiple of HEAD_EVERY below it, up to HEAD_TURNS - 1 turns.
HEAD_EVERY, HEAD_TURNS = 20, 4
WHITE_WORDS = r"[^\x20\x09-\x0D]+"
NO_IDS = hashlib.sha256(b"").hexdigest()


class Sorted:
    """Children in two parallel arrays, in byte order: the layouts of 4 and 16."""

    __slots__ = ("most", "bytes", "nodes")

    def __init__(self, most: int):
        self.most, self.bytes, self.nodes = most, bytearray(), []

    def get(self, byte: int) -> Node | None:
        at = bisect_left(self.bytes, byte)
        return self.nodes[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, node: Node) -> bool:
        """False if there is no room."""
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
        elif len(self.bytes) == self.most:
            return False
        else:
            self.bytes.insert(at, byte)
            self.nodes.insert(at, node)
        return True

    def items(self) -> Iterable[tuple[int, Node]]:
        return zip(self.bytes, self.nodes, strict=True)

    def larger(self) -> Sorted | Indexed:
        return Sorted(16) if self.most < 16 else Indexed()


class Indexed:
    """48 children at most, found by an index over all bytes."""

    __slots__ = ("index", "nodes")

    def __init__(self):
        self.index, self.nodes = bytearray(256), []

    def get(self, byte: int) -> Node | None:
        return self.nodes[self.index[byte] - 1] if self.index[byte] else None

    def put(self, byte: int, node: Node) -> bool:
        if self.index[byte]:
            self.nodes[self.index[byte] - 1] = node
        elif len(self.nodes) == 48:
            return False
        else:
            self.nodes.append(node)
            self.index[byte] = len(self.nodes)
        return True

    def items(self) -> Iterable[tuple[int, Node]]:
        return ((b, self.nodes[at - 1]) for b, at in enumerate(self.index) if at)

    def larger(self) -> Direct:
        return Direct()


class Direct:
    """A place for each byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes: list[Node | None] = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> bool:
        self.nodes[byte] = node
        return True

    def items(self) -> Iterable[tuple[int, Node]]:
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


class Ends:
    """Conversations that end at a node: how many, the smallest id, and the digest of all ids, or None where other trees may have more."""

    __slots__ = ("count", "least", "digest")

    def __init__(self, count: int, least: int, digest: str | None):
        self.count, self.least, self.digest = count, least, digest


class Node:
    """path: the bytes between the byte that leads here and this node; ends: what ends here; children: a layout, or None."""

    __slots__ = ("path", "ends", "children")

    def __init__(self, path: bytes, ends: Ends | None = None):
        self.path, self.ends, self.children = path, ends, None

    def put(self, byte: int, node: Node) -> None:
        if self.children is None:
            self.children = Sorted(4)
        while not self.children.put(byte, node):
            grown = self.children.larger()
            for b, n in self.children.items():
                grown.put(b, n)
            self.children = grown


class Tree:
    """An adaptive radix tree over byte strings."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, ends: Ends) -> None:
        """Adds a key that is not in the tree yet."""
        node, above, via, at = self.root, None, 0, 0
        while True:
            path = node.path
            if not key.startswith(path, at):
                same = 0
                while at + same < len(key) and same < len(path) and path[same] == key[at + same]:
                    same += 1
                split = Node(path[:same])
                node.path = path[same + 1 :]
                split.put(path[same], node)
                above.put(via, split)
                node, at = split, at + same
            else:
                at += len(path)
            if at == len(key):
                node.ends = ends
                return
            below = node.children.get(key[at]) if node.children is not None else None
            if below is None:
                node.put(key[at], Node(key[at + 1 :], ends))
                return
            node, above, via, at = below, node, key[at], at + 1


class Open:
    """A node of the trie on the way down: sums of what is below so far."""

    __slots__ = ("depth", "words", "prefix", "first", "last", "n", "least", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, depth: int, words: int, prefix: bytes | None, first: bool, last: bool):
        self.depth, self.words, self.prefix, self.first, self.last = depth, words, prefix, first, last
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: Ends | None = None
        self.waiting: list[tuple] = []  # rows of children, which still lack this node's smallest member

    def add(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None or least < self.least else self.least


NAMES = ["kind", "conv_id", "depth", "parent_conv_id", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "prefix", "tree", "first", "childless", "words", "place", "ids"]
KINDS = [pa.int32(), *[pa.int64()] * 3, pa.binary(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
SCHEMA = "kind int, conv_id long, depth long, parent_conv_id long, parent binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, prefix binary, tree long, first boolean, childless boolean, words long, place long, ids string"
#: Kinds of rows: a node that is done; a part of a node on a tree's first or last path; a piece of the ids that end at a node.
DONE, PART, IDS = 0, 1, 2


def name_of(prefix: bytes, turn: bytes) -> bytes:
    """The name of a node from that of its parent."""
    return hashlib.sha256(prefix + turn).digest()[:16]


def nodes(tree: Tree, number: int, first: bytes, last: bytes, words: dict[bytes, int]) -> Iterator[tuple]:
    """Rows of the trie's nodes in a tree, whose first and last keys are given; words: of each turn in it."""
    path = bytearray()
    up: list[Open] = []

    def enter(depth: int) -> None:
        turn = bytes(path[TURN_BYTES * (depth - 1) : TURN_BYTES * depth])
        above, at = up[-1], slice(TURN_BYTES * (depth - 1), TURN_BYTES * depth)
        on_first, on_last = above.first and first[at] == turn, above.last and last[at] == turn
        up.append(Open(depth, words[turn], name_of(above.prefix, turn) if on_first or on_last else None, on_first, on_last))

    def leave() -> Iterator[tuple]:
        node = up.pop()
        node.leaves += node.children == 0
        node.saved += (node.n - 1) * node.words
        digest = node.ends.digest if node.ends else NO_IDS
        known = None if node.prefix is not None else node.least
        for row in node.waiting:
            yield row[:3] + (known, node.prefix) + row[5:]
        if node.prefix is not None:
            yield (PART, node.least, node.depth, None, up[-1].prefix if up else None, node.n, node.children, node.leaves, node.saved, node.ends and node.ends.digest, node.prefix, number, node.first, node.children == 0, node.words, None, None)
        else:
            up[-1].waiting.append((DONE, node.least, node.depth, None, None, node.n, node.children, node.leaves, node.saved, digest, None, None, None, None, None, None, None))
        if up:
            above = up[-1]
            above.add(node.n, node.least)
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved

    up.append(Open(0, 0, b"", True, True))
    # a node is entered, then its children one after the other, then what its edge has pushed is left
    work: list[tuple] = [(None, tree.root, 0)]
    while work:
        byte, node, size = work.pop()
        if node is None:  # the way back: of an edge that began at this size of the path
            while up[-1].depth * TURN_BYTES > size and len(up) > 1:
                yield from leave()
            del path[size:]
            continue
        begin = len(path)
        if byte is not None:
            path.append(byte)
        path += node.path
        for depth in range(begin // TURN_BYTES + 1, len(path) // TURN_BYTES + 1):
            enter(depth)
        work.append((None, None, begin))
        if node.ends:
            up[-1].ends = node.ends
            up[-1].add(node.ends.count, node.ends.least)
        if node.children is not None:
            work += [(b, n, 0) for b, n in reversed(list(node.children.items()))]
    yield from leave()


def named(key: bytes) -> bytes:
    prefix = b""
    for at in range(0, len(key), TURN_BYTES):
        prefix = name_of(prefix, key[at : at + TURN_BYTES])
    return prefix


def of_range(rows: Iterable[tuple[bytes, int, list[int]]], part: int, tree_turns: int = TREE_TURNS) -> Iterator[tuple]:
    """Rows of a range, of its sorted strings: (key, conversation id, words of each turn)."""
    number = part << 32
    tree, words, turns, first, last = Tree(), {}, 0, None, None
    key: bytes | None = None
    count = least = pieces = 0
    held: list[str] = []
    digest = None

    def piece() -> tuple:
        return (IDS, *[None] * 9, named(key), number, None, None, None, pieces, ",".join(held))

    def close(edge: bool) -> Iterator[tuple]:
        """What is known of the current key goes into the tree; at an edge its ids are kept, as the next or last tree may have more."""
        nonlocal pieces, held
        digest.update(("," * (pieces > 0) + ",".join(held)).encode())
        if held and edge:
            yield piece()
        tree.insert(key, Ends(count, least, None if edge else digest.hexdigest()))

    for new, conv_id, wide in rows:
        if new != key:
            if key is not None:
                full = turns >= tree_turns
                yield from close(key == first or full)
                if full:
                    yield from nodes(tree, number, first, key, words)
                    number, tree, words, turns, first = number + 1, Tree(), {}, 0, None
            key, count, least, pieces, held, digest = new, 0, conv_id, 0, [], hashlib.sha256()
            first = key if first is None else first
            turns += len(wide) + 1
            for at, w in enumerate(wide):
                words[key[TURN_BYTES * at : TURN_BYTES * (at + 1)]] = w
        if len(held) == CHUNK_IDS:
            digest.update(("," * (pieces > 0) + ",".join(held)).encode())
            yield piece()
            pieces, held = pieces + 1, []
        held.append(str(conv_id))
        count += 1
    if key is not None:
        yield from close(True)
        yield from nodes(tree, number, first, key, words)


def _trees(tree_turns: int):
    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), batch.column("words").to_pylist(), strict=True)

        held = []
        for row in of_range(rows(), TaskContext.get().partitionId(), tree_turns):
            held.append(row)
            if len(held) == 5_000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, key (turn ids, one after the other) and words (of each turn) of every conversation with the head that it takes.

    Turns of one number are in the order of role and turn id, a null turn is the first, null roles and texts are empty, repeated rows
    are turns of their own, rows of a null conv_id are left out. Texts are not shuffled, only ids of 16 bytes and numbers of words.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, TURN_BYTES)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), name.alias("id"), F.regexp_count(text, F.lit(WHITE_WORDS)).alias("words"))
    whole = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    whole = whole.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    whole = whole.select("conv_id", F.transform("turns", lambda x: F.struct(x.id.alias("id"), x.words.alias("words"))).alias("turns"))
    base = F.col("conv_id") - F.col("conv_id") % HEAD_EVERY
    heads = whole.where(F.col("conv_id") % HEAD_EVERY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD_TURNS - 1).alias("head"))
    many = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_TURNS).cast("int")
    own = F.slice("turns", many + 1, F.greatest(F.size("turns"), F.lit(1)))
    taken = F.coalesce(F.slice("head", F.lit(1), many), F.slice("turns", 1, 0))
    turns = whole.withColumn("base", base).join(heads, "base", "left").select("conv_id", F.concat(taken, own).alias("turns"))
    key = F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x.id)), ""))
    return turns.select("conv_id", key.alias("key"), F.transform("turns", lambda x: x.words).alias("words"))


def _beside(nodes: DataFrame, count: int) -> DataFrame:
    return F.broadcast(nodes) if count <= BROADCAST_NODES else nodes


def _hashed(batches):
    """SHA-256 of the pieces of each prefix, which come in order."""
    now, digest = None, None
    for batch in batches:
        done = []
        for prefix, ids in zip(batch.column("prefix").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if prefix != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = prefix, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["prefix", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["prefix", "ends_sha256"])


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(strings: DataFrame, tree_turns: int = TREE_TURNS) -> DataFrame:
    """The nodes of the trie over strings (conv_id, key, words), as rebuilt() gives them.

    One row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. Without strings there is no node. A conversation's turn ids are held in one row, 20 bytes a turn.
    """
    ordered = small_batches(strings).repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    found, _ = written(ordered.mapInArrow(_trees(tree_turns), SCHEMA))
    parts = found.where(F.col("kind") == PART)

    # sums over the trees of each shared node; trees of a node follow each other
    no_child = F.col("childless")
    sums = parts.groupBy("prefix").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.min("tree").alias("begun"), F.min(F.when(~no_child, F.col("tree"))).alias("with_children"), F.max("ends_sha256").alias("known"),
    )
    sums, _ = written(sums)
    count = sums.count()
    # the first path of a tree, as far as an earlier tree has begun it, was counted twice
    again = parts.where("first").select("prefix", "tree", "depth", "words").join(_beside(sums.select("prefix", "begun", "with_children"), count), "prefix").where("tree > begun")
    # the tree before ended with the string of this node, childless so far
    after_leaf = F.col("with_children").isNull() | (F.col("tree") <= F.col("with_children"))
    whole, below = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy(F.desc("depth"))
    again = again.select(
        "prefix", F.sum("words").over(below).alias("more_saved"), (F.col("depth") < F.max("depth").over(whole)).cast("long").alias("fewer_children"),
        F.max(after_leaf.cast("long")).over(whole).alias("fewer_leaves"),
    )
    again = again.groupBy("prefix").agg(*[F.sum(c).alias(c) for c in ("more_saved", "fewer_children", "fewer_leaves")])

    def mended(c: str, by: Column) -> Column:
        return (F.col(c) + F.coalesce(by, F.lit(0))).alias(c)

    shared = sums.join(again, "prefix", "left").select(
        "prefix", "parent", "conv_id", "depth", "n_convs", "known", mended("n_children", -F.col("fewer_children")), mended("n_leaves", -F.col("fewer_leaves")), mended("saved_tokens", F.col("more_saved"))
    )
    pieces = found.where(F.col("kind") == IDS).join(_beside(sums.where("known is null").select("prefix"), count), "prefix", "left_semi")
    hashed = pieces.repartition("prefix").sortWithinPartitions("prefix", "tree", "place").select("prefix", "ids").mapInArrow(_hashed, "prefix binary, ends_sha256 string")
    parents = _beside(sums.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id")), count)
    shared = shared.join(hashed, "prefix", "left").join(parents, "parent", "left").withColumn("ends_sha256", F.coalesce("known", "ends_sha256", F.lit(NO_IDS)))
    done = found.where(F.col("kind") == DONE)
    inside = done.where("parent is null").select(*RESULT)
    at_edge = done.where("parent is not null").drop("parent_conv_id").join(parents, "parent").select(*RESULT)
    return inside.unionByName(at_edge).unionByName(shared.select(*RESULT))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """trie() of all conversations, each with the head that it takes."""
    return trie(rebuilt(conversations))
