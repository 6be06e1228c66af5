"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Columns (shingles) are put in one order, rare ones first; the order comes from a count sketch over all rows. Two sets of
Jaccard similarity t or more share a column among the first n - ceil(t * n) + 1 of each, so the product is first taken over
those prefixes: the matrix is dealt out by column, columns with one entry go, and pairs whose sizes, or whose accumulated overlap up
to here and the columns that may follow, bound the similarity below t are dropped. Pairs that stay are counted exactly, over whole
rows of the matrix, a block of rows against one row at a time.

Only links that matter for components are sought. In each column all entries are first paired with one of them, the
column's hub, and counted; then what still lies in different components is. No column's entries are paired with each other
while they are known to be connected.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components, delete, written
from .kernel import Words, shingles, slices, small_batches

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
_CELL_BITS = 18
#: A column of more entries than this (by the sketch) is dealt out in parts of about as many.
COLUMN_PART = 4_000
#: Rows (of one id) of a table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Members that are compared with one row in one part.
BLOCK_ROWS = 500
#: Entries of a column that are compared with the others in one part.
PAIR_ROWS = 2_000
#: Different sets of one task that are remembered.
SEEN_SETS = 1_000_000
#: Digests of more than LEAST_HOT rows and of more than one in HOT_SHARE of all rows are hot: HOT_SHARE of them at most, so they are
#: broadcast.
HOT_SHARE, LEAST_HOT = 10_000, 1_000


def row_sets(text: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    hashes, at = shingles(Words(text), k)
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def required(n: np.ndarray | int, percent: int = PERCENT):
    """Least intersection of a set of n with any set that it links with: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def _rows(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def survey(docs: DataFrame) -> tuple[DataFrame, str]:
    """A table of every row's set size and digest (kind 1), and of the count sketch's cells for each task (kind 0)."""

    def run(batches):
        cells = np.zeros(1 << _CELL_BITS, np.int64)
        names = ["kind", "doc_id", "n", "digest", "check"]
        for batch in batches:
            for part in slices(batch):
                sets = row_sets(part.column("text"))
                cells += np.bincount((np.concatenate(sets) >> np.uint64(64 - _CELL_BITS)).astype(np.int64), minlength=len(cells))
                digest = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(sets), np.int8)), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1])], names)
        hit = np.flatnonzero(cells)
        if len(hit):
            zero = pa.array(np.zeros(len(hit), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(hit), np.int8)), pa.array(hit), pa.array(cells[hit]), zero, zero], names)

    return written(_rows(docs).mapInArrow(run, "kind byte, doc_id long, n long, digest long, check long"))


def sketch(surveyed: DataFrame) -> np.ndarray:
    """Entries of each cell's columns over all rows; of fixed size."""
    found = surveyed.where("kind = 0").groupBy("doc_id").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(1 << _CELL_BITS, np.int64)
    cells[found["doc_id"].to_numpy()] = found["n"].to_numpy()
    return cells


def _kept(batch: pa.RecordBatch, new: np.ndarray, parts: np.ndarray):
    group = np.cumsum(new) - 1
    cell = batch.column("column").to_numpy().view(np.uint64) >> np.uint64(56 - _CELL_BITS) & np.uint64((1 << _CELL_BITS) - 1)
    keep = (np.bincount(group)[group] > 1) | (parts[cell.astype(np.int64)] > 1) if len(group) else np.zeros(0, bool)
    if keep.any():
        yield batch.filter(pa.array(keep)).drop_columns(["salt"])


def prefix_columns(docs: DataFrame, cells: np.ndarray, percent: int) -> tuple[DataFrame, str]:
    """Prefix entries (column, doc_id, n) of columns with two entries or more.

    Rows of one task with equal sets enter once, under the id of the first of them, as long as there are not too many different ones.
    """
    level = np.minimum(255, (8 * np.log2(cells + 1.0)).astype(np.int64)).astype(np.uint64)  # at most 8 * 31: the order of 2**31 entries and more is that of their hashes
    parts = np.maximum(1, cells // COLUMN_PART).astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((level, parts))  # 2**_CELL_BITS numbers each

    def run(batches):
        level, parts = shared.value
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch):
                columns, ids, sizes, salts = [], [], [], []
                for s, i in zip(row_sets(part.column("text")), part.column("doc_id").to_pylist(), strict=True):
                    if not len(s) or i is None:
                        continue
                    key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if key in seen:
                        continue
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(key)
                    cell = (s >> np.uint64(64 - _CELL_BITS)).astype(np.int64)
                    full = (level[cell] << np.uint64(56)) | (s >> np.uint64(8))
                    keep = len(s) - required(len(s), percent) + 1
                    first = np.argpartition(full, keep - 1)[:keep] if keep < len(full) else np.arange(len(full))
                    columns.append(full[first])
                    salts.append(int.from_bytes(key[:4], "little") % parts[cell[first]])
                    ids.append(np.full(keep, i, np.int64))
                    sizes.append(np.full(keep, len(s), np.int32))
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([c.view(np.int64) for c in columns], [s.astype(np.int32) for s in salts], ids, sizes)], ["column", "salt", "doc_id", "n"])

    def several(batches):
        """Entries of columns with two entries or more; a part of a split column passes whole."""
        _, parts = shared.value
        left = None
        for batch in batches:
            if left is not None:
                batch = pa.concat_batches([left, batch])
            column, salt = batch.column("column").to_numpy(), batch.column("salt").to_numpy()
            new = np.concatenate(([True], (column[1:] != column[:-1]) | (salt[1:] != salt[:-1])))
            last = np.flatnonzero(new)[-1]
            left = batch.slice(last)  # may go on in the next batch; by the sketch, about COLUMN_PART entries at most
            yield from _kept(batch.slice(0, last), new[:last], parts)
        if left is not None:
            yield from _kept(left, np.arange(left.num_rows) == 0, parts)

    entries = _rows(docs).mapInArrow(run, "column long, salt int, doc_id long, n int")
    dealt = entries.repartition("column", "salt").sortWithinPartitions("column", "salt")
    return written(dealt.mapInArrow(several, "column long, doc_id long, n int"))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets link, by exact counts. An empty set links with nothing."""
    low, high = (a, b) if len(a) < len(b) else (b, a)
    if not len(low) or 100 * len(low) < percent * len(high):
        return False
    at = np.searchsorted(high, low)
    both = int((high[np.minimum(at, len(high) - 1)] == low).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def counted(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose rows of the whole matrix link: a, b.

    Each b is a block's one row; its set goes to every part of the rows that are compared with it.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    members = pairs.join(parts, "b").select(F.col("a").alias("doc_id"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("is_hub"))
    hubs = parts.select(F.col("b").alias("doc_id"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_hub"))
    wanted, _ = written(members.unionByName(hubs))
    names = ["hub", "part", "is_hub"]
    # texts, not sets: a set's hashes take more room than the text that it is made of, and do not compress
    rows = _rows(docs).join(wanted.hint("shuffle_hash"), "doc_id").select("text", "doc_id", *names)
    dealt = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.desc("is_hub"))

    def compare(batches):
        key, own = None, []  # sets of one id: more than one if its rows differ
        for batch in batches:
            for some in slices(batch):
                doc, hub, part, first = (some.column(c).to_pylist() for c in ("doc_id", *names))
                a, b = [], []
                for i, cells in enumerate(row_sets(some.column("text"))):
                    if first[i]:
                        if key != (hub[i], part[i]):
                            key, own = (hub[i], part[i]), []
                        own.append(cells)
                    elif key == (hub[i], part[i]) and any(linked(cells, o, percent) for o in own):
                        a.append(doc[i])
                        b.append(hub[i])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def _labelled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries with the component of their row, its own id where it has no link yet."""
    joined = entries.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return joined.withColumn("component", F.coalesce("component", "doc_id"))


def links(docs: DataFrame, surveyed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b), all of them links, that connect the same rows of different sets as all links do."""
    spark = docs.sparkSession
    entries, entries_path = prefix_columns(docs, sketch(surveyed), percent)
    sizes = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))

    hubs = entries.groupBy("column").agg(F.min(F.struct("doc_id", "n")).alias("hub"))
    stars = entries.join(hubs, "column").where(F.col("doc_id") != F.col("hub.doc_id")).where(sizes(F.col("n"), F.col("hub.n")))
    stars, stars_path = written(stars.groupBy(F.col("doc_id").alias("a"), F.col("hub.doc_id").alias("b")).agg(F.count("*").alias("together")))

    # each row with the hub that it meets most often
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("together", -F.col("b"))).alias("b"))
    found, _ = written(counted(docs, best, percent))
    labels, _ = written(components(found))

    # hubs that are still in another component
    lost = stars.join(best.select("a", "b"), ["a", "b"], "left_anti")
    for side in ("a", "b"):
        lost = lost.join(labels.select(F.col("node").alias(side), F.col("component").alias(f"component_{side}")), side, "left")
    lost = lost.where(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).select("a", "b")
    lost, lost_path = written(lost)
    if lost.limit(1).count():
        found, _ = written(found.unionByName(counted(docs, lost, percent)))
        labels, _ = written(components(found))

    # columns that still hold different components. Up to the end of the prefix that ends first all shared columns of a pair are
    # known, and past it there are no more than the rest of that row, so a pair that links shares `least` of the columns left
    # here. Put in one order, fewest entries first, the first that it shares has least - 1 of each row's columns after it.
    labelled = _labelled(entries, labels)
    mixed = labelled.groupBy("column").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("entries")).where("low < high").select("column", "entries")
    own = Window.partitionBy("doc_id")
    rest = labelled.join(mixed, "column").withColumn("after", F.count("*").over(own) - F.row_number().over(own.orderBy("entries", "column")))
    rest, rest_path = written(rest)
    # a column of many entries is dealt out: each of its parts meets all of the column, in a task of its own
    parts = F.ceil(F.col("entries") / PAIR_ROWS).cast("int")
    side = lambda s, part: rest.select("column", part.alias("part"), *[F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "component", "after")])
    left, right = side("a", F.pmod(F.xxhash64("doc_id"), parts).cast("int")), side("b", F.explode(F.sequence(F.lit(0), parts - 1)))
    past = lambda n: F.ceil(F.lit(percent) * F.col(n) / 100) - 1
    least = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100.0 + percent) - 1e-9) - F.greatest(past("n_a"), past("n_b"))
    pairs = left.join(right, ["column", "part"]).where((F.col("doc_id_a") > F.col("doc_id_b")) & (F.col("component_a") != F.col("component_b"))).where(sizes(F.col("n_a"), F.col("n_b")))
    pairs = pairs.where(F.least("after_a", "after_b") >= least - 1)
    pairs = pairs.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti")
    pairs, pairs_path = written(pairs)
    if pairs.limit(1).count():
        found, _ = written(found.unionByName(counted(docs, pairs, percent)))
    for path in (entries_path, stars_path, lost_path, rest_path, pairs_path):
        delete(spark, path)
    return found


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id.

    component_id is the smallest id reachable over links, the own id included. Rows of one id count as one document: they
    share a component. A null id has a null component and no links; null texts and texts without words have size 0 and no
    links. Only doc_id and text are read.
    """
    surveyed, _ = survey(docs)
    rows = surveyed.where("kind = 1")
    full = rows.where("n > 0 AND doc_id IS NOT NULL")
    key = ["digest", "check"]
    groups, groups_path = written(full.groupBy(*key).agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
    bound = max(LEAST_HOT, (groups.agg(F.sum("rows").alias("n")).first()["n"] or 0) // HOT_SHARE)
    full = full.join(F.broadcast(groups.where(F.col("rows") > bound).select(*key, F.col("first").alias("hot"))), key, "left")  # HOT_SHARE rows at most
    cold = full.where("hot IS NULL").join(groups.where(F.col("rows") <= bound), key)
    copies = cold.select("doc_id", "first").unionByName(full.where("hot IS NOT NULL").select("doc_id", F.col("hot").alias("first"))).where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    found = components(links(docs, surveyed, percent).unionByName(copies))
    delete(docs.sparkSession, groups_path)
    out = rows.join(found, rows["doc_id"] == found["node"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stand for their component: those of its smallest id, with all columns.

    Of several rows of one id the smallest by its columns stays. Rows of null id, without text or without words stay.
    """
    found, _ = written(classes(docs, percent))
    gone, _ = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    match = docs["doc_id"].cast("long") == F.col("_gone")
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, match, "left_anti")
    again, _ = written(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")))
    if not again.limit(1).count():
        return kept
    match = F.col("doc_id").cast("long") == F.col("_again")
    single = kept.join(again, match, "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.join(again, match, "left_anti").unionByName(single)
