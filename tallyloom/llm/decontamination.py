"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle check.

Windows that share no five-word shingle with any item cannot reach the similarity, so only windows in which a shared
shingle stands where it stands in an item are fingerprinted: they begin where the item would begin. Each fingerprint is
cut into blocks; two fingerprints within RADIUS differ by at most RADIUS // BLOCKS bits in one block at least, so looking
every block up within that distance finds all item fingerprints within RADIUS. A fingerprint gives all words the same weight
and the similarity doesn't, so items far from it may reach the similarity too: items of which a row holds shingles of enough
weight, wherever they stand, are checked as well, which leaves none out. Checked exactly is, for each window that begins where
the item would begin, the weight of the item's shingles that it holds, against the weight of all of them.

Items are read in blocks of bounded size, each broadcast in turn; a larger benchmark means more blocks. The weights are those of
the whole benchmark, so blocks bound memory and change no result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import delete, written
from .kernel import Words, shingles, slices, small_batches

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 16
BLOCKS = 6
#: Characters of item text that are indexed and broadcast together.
MAX_BLOCK_CHARS = 16 << 20
_PREFILTER_BITS = 22


def fingerprints(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """SimHash of windows of word hashes: each of 64 bits is what most words of the window have there."""
    out = np.zeros(len(start), np.uint64)
    for lo in range(0, len(start), 4096):
        s, n = start[lo : lo + 4096], length[lo : lo + 4096]
        at = np.concatenate(([0], np.cumsum(n)))
        index = np.repeat(s - at[:-1], n) + np.arange(at[-1])
        bits = np.unpackbits(words[index].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at[:-1], axis=0, dtype=np.int32)
        out[lo : lo + 4096] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


class Items:
    """Index of a block of items: shingle postings, fingerprints by block value, weights.

    `whole`: items of the whole benchmark, hashes of at least this block's shingles in order, and items that hold each; None if
    the block is the whole benchmark.
    """

    def __init__(self, ids: list, texts: list[str], whole: tuple[int, np.ndarray, np.ndarray] | None = None):
        words = Words(pa.array(texts, pa.large_string()))
        hashes, at = shingles(words, SHINGLE)
        self.ids, self.length = ids, np.diff(words.rows)
        item = np.repeat(np.arange(len(ids)), np.diff(at))
        place = np.arange(len(hashes)) - at[item]
        order = np.argsort(hashes, kind="stable")
        self.posting_item, self.posting_place = item[order], place[order]
        self.keys, first, many = np.unique(hashes[order], return_index=True, return_counts=True)
        self.first, self.many = first, many
        # weight of a shingle: the fewer items of the benchmark hold it, the more it says
        holders = np.zeros(len(self.keys), np.int64)
        pair = np.unique(np.stack((np.searchsorted(self.keys, hashes), item)), axis=1)
        np.add.at(holders, pair[0], 1)
        count = len(ids)
        if whole:
            count, known, many = whole
            holders = many[np.searchsorted(known, self.keys)]
        self.weight = np.log1p(count / np.maximum(holders, 1))
        self.own = [pair[0][pair[1] == i] for i in range(len(ids))] if len(ids) < 2000 else np.split(pair[0][np.argsort(pair[1], kind="stable")], np.cumsum(np.bincount(pair[1], minlength=len(ids)))[:-1])
        self.total = np.array([self.weight[o].sum() for o in self.own])
        self.may = np.zeros(1 << _PREFILTER_BITS, bool)
        self.may[(self.keys >> np.uint64(64 - _PREFILTER_BITS)).astype(np.int64)] = True
        full = np.flatnonzero(self.length > 0)
        w = words.hashes()
        self.print = np.zeros(len(ids), np.uint64)
        self.print[full] = fingerprints(w, words.rows[:-1][full], self.length[full])
        self._blocks(full)

    def _blocks(self, full: np.ndarray) -> None:
        """For each block and each value, the items whose fingerprint has a near value in the block."""
        edges = np.linspace(0, 64, BLOCKS + 1).astype(int)
        self.cut = [(int(a), int(b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.tables = []
        for shift, bits in self.cut:
            value = ((self.print[full] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            flips = [sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(bits), k)]
            near = (value[:, None] ^ np.array(flips)).ravel()
            owner = np.repeat(full, len(flips))
            order = np.argsort(near, kind="stable")
            self.tables.append((np.searchsorted(near[order], np.arange((1 << bits) + 1)), owner[order].astype(np.int32)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) pairs whose fingerprints differ in at most RADIUS bits."""
        found = []
        for (shift, bits), (at, owner) in zip(self.cut, self.tables, strict=True):
            value = ((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            many = at[value + 1] - at[value]
            for lo in range(0, len(prints), 64):
                m = many[lo : lo + 64]
                total = int(m.sum())
                window = np.repeat(np.arange(lo, lo + len(m)), m)
                begin = np.concatenate(([0], np.cumsum(m)))[:-1]
                item = owner[np.repeat(at[value[lo : lo + 64]] - begin, m) + np.arange(total)]
                close = np.bitwise_count(prints[window] ^ self.print[item]) <= RADIUS
                found.append(np.stack((window[close], item[close].astype(np.int64))))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        return pairs[0], pairs[1]

    def matches(self, text: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """(row, item, first word, words, similarity) of the best window of each item in each row."""
        words = Words(text)
        hashes, at = shingles(words, SHINGLE)
        hit = np.flatnonzero(self.may[(hashes >> np.uint64(64 - _PREFILTER_BITS)).astype(np.int64)])
        if not len(hit):
            return []
        key = np.searchsorted(self.keys, hashes[hit])
        good = (key < len(self.keys)) & (self.keys[np.minimum(key, len(self.keys) - 1)] == hashes[hit])
        hit, key = hit[good], key[good]
        if not len(hit):
            return []
        row = np.searchsorted(at, hit, "right") - 1
        place = hit - at[row]  # word of the row at which the shingle begins
        known = np.full(len(hashes), -1, np.int64)  # which item shingle each shingle is
        known[hit] = key
        many = self.many[key]
        begin = np.concatenate(([0], np.cumsum(many)))
        posting = np.repeat(self.first[key] - begin[:-1], many) + np.arange(begin[-1])
        row, place = np.repeat(row, many), np.repeat(place, many)
        owner = self.posting_item[posting]
        length = self.length[owner]
        count = np.diff(words.rows)[row]
        start = np.clip(place - self.posting_place[posting], 0, np.maximum(count - length, 0))
        length = np.minimum(length, count)
        pair, where = np.unique(row * len(self.ids) + owner, return_inverse=True)  # rows and items that share a shingle
        held = np.unique(where * len(self.keys) + np.repeat(key, many))
        held = np.bincount(held // len(self.keys), self.weight[held % len(self.keys)], len(pair))
        check = held >= (SIMILARITY - 1e-9) * self.total[pair % len(self.ids)]
        window = np.unique(np.stack((row, start, length)), axis=1)
        near_window, near_item = self.near(fingerprints(words.hashes(), words.rows[window[0]] + window[1], window[2]))
        check |= np.isin(pair, window[0][near_window] * len(self.ids) + near_item)
        sought = check[where]
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for r, i, s, n in np.unique(np.stack((row, owner, start, length))[:, sought], axis=1).T.tolist():
            held = np.unique(known[at[r] + s : min(at[r] + s + max(1, n - SHINGLE + 1), at[r + 1])])
            similar = float(self.weight[np.intersect1d(held, self.own[i], assume_unique=True)].sum() / self.total[i])
            if similar >= SIMILARITY - 1e-12 and (-similar, s) < best.get((r, i), (1.0, 0))[:2]:
                best[r, i] = (-similar, s, n)
        return [(r, i, s, n, -x) for (r, i), (x, s, n) in sorted(best.items())]


def _holders(items: DataFrame) -> tuple[int, DataFrame, str]:
    """Items that have words; for each block, the hash of each of its shingles and the number of all items that hold it; the
    path of that table."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                hashes, at = shingles(Words(part.column("text")), SHINGLE)
                row = np.repeat(np.arange(part.num_rows), np.diff(at))
                order = np.lexsort((hashes, row))
                hashes, row = hashes[order], row[order]
                first = np.diff(row, prepend=-1) > 0  # of an item's shingles
                once = first | (np.diff(hashes, prepend=np.uint64(0)) != 0)
                row = pa.array(row[once])
                yield pa.RecordBatch.from_arrays([part.column("block").take(row), pa.array(hashes[once].view(np.int64)), pa.array(first[once].astype(np.int64))], ["block", "shingle", "first"])

    rows = small_batches(items).select("block", "text").mapInArrow(run, "block long, shingle long, first long")
    counts, path = written(rows.groupBy("block", "shingle").agg(F.count("*").alias("n"), F.sum("first").alias("first")))
    count = counts.agg(F.sum("first").alias("n")).first()["n"] or 0
    out, kept = written(counts.join(counts.groupBy("shingle").agg(F.sum("n").alias("holders")), "shingle").select("block", "shingle", "holders"))
    delete(items.sparkSession, path)
    return count, out, kept


def _blocks(benchmark: DataFrame, max_chars: int):
    """Indexed items, a bounded block at a time; items without words are left out."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = -(-chars // max_chars)
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("long") if blocks else F.lit(0))
    count, holders, path = _holders(items) if blocks > 1 else (0, None, "")
    for b in range(blocks):
        part = items.where(F.col("block") == b).orderBy("item_id", "text").collect()  # about max_chars characters
        part = [r for r in part if r["text"].encode().split()]
        if part:
            whole = None
            if holders is not None:  # as many rows as the block has different shingles
                rows = holders.where(F.col("block") == b).toArrow()
                known = rows.column("shingle").to_numpy().view(np.uint64)
                order = np.argsort(known)
                whole = count, known[order], rows.column("holders").to_numpy()[order]
            yield Items([r["item_id"] for r in part], [r["text"] for r in part], whole)
    if path:
        delete(benchmark.sparkSession, path)


def find(docs: DataFrame, benchmark: DataFrame, max_block_chars: int = MAX_BLOCK_CHARS) -> DataFrame:
    """One row for each item found in each row of docs: doc_id, item_id, first_word, n_words, similarity.

    first_word counts words (runs of anything but ASCII white space) from 0; of equally similar windows the first is told.
    A-Z is folded. An item of fewer than five words is one shingle. Null and empty texts hold nothing and null or empty
    items are not sought; without items there are no rows. Repeated rows of docs and null ids give rows of their own; only
    doc_id and text, item_id and text are read.
    """
    schema = "doc_id long, item_id long, first_word long, n_words long, similarity double"
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in _blocks(benchmark, max_block_chars):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            items = shared.value
            for batch in batches:
                for part in slices(batch):
                    if found := items.matches(part.column("text")):
                        r, i, s, n, x = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(r)), pa.array([items.ids[k] for k in i], pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(x)], ["doc_id", "item_id", "first_word", "n_words", "similarity"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, max_block_chars: int = MAX_BLOCK_CHARS) -> DataFrame:
    """The rows of docs in whose text no item is found, with all their columns, without a shuffle."""
    for items in _blocks(benchmark, max_block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for batch in batches:
                for part in slices(batch):
                    keep = np.ones(part.num_rows, bool)
                    keep[[m[0] for m in shared.value.matches(part.column("text"))]] = False
                    yield part.filter(pa.array(keep))

        docs = small_batches(docs).mapInArrow(run, docs.schema)
    return docs
