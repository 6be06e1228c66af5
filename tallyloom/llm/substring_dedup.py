"""Substring deduplication by content-defined chunking.

A gear hash rolls over the last WINDOW bytes; where it falls below a bound, and did not within the last LEAST bytes, a chunk
ends. Whether a chunk ends at a byte depends on the WINDOW + LEAST bytes before it alone, so an insertion moves no other
boundary, and equal passages have equal chunks but for what is cut at their ends. A chunk of more than LONG bytes (a word over and over has few
hashes or none below the bound) is cut again where the hash is least within REACH bytes to both sides. Chunks are compared by a 96-bit digest:
of the 3e12 chunks of 100 TB of text, two different ones share it with a probability below 1e-4.
A digest that occurs in two documents or more is shared; the document of the smallest id keeps it. A passage has chunks at its ends
that it shares in part, so its run of shared chunks is shorter than it is, but not by more words than the chunks before and after the
run have, and the WINDOW + LEAST bytes before them. A run is a repeated passage if it has MIN_WORDS words and, with the chunks around it, `passage_words`: none that long is
left out for its ends, and most shorter ones are.

A digest of more than 1/HOT_SHARE of all shared chunks is hot; there are at most HOT_SHARE of them, so they are broadcast, and their
chunks meet no shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import written
from .kernel import WHITE, buffers, mix, powers, slices, small_batches

WINDOW = 16
LEAST = 9
#: A chunk ends at about one in so many bytes that are far enough from the last.
MEAN_GAP = 20
LONG, REACH = 200, 24
MIN_WORDS = 5
PASSAGE_WORDS = 50
#: Hot digests are those of more than LEAST_HOT chunks and of more than one in HOT_SHARE of all shared ones.
HOT_SHARE, LEAST_HOT = 10_000, 1_000
_GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_TABLE = np.random.default_rng(78).integers(1, 1 << 63, 256, dtype=np.uint64)
_TABLE_2 = np.random.default_rng(79).integers(1, 1 << 63, 256, dtype=np.uint64)


def gear(data: np.ndarray) -> np.ndarray:
    """For each byte, the sum over the WINDOW bytes up to it of GEAR[byte] << age, by doubling."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h * np.uint32(0x9E3779B1)


def least_places(h: np.ndarray) -> np.ndarray:
    """Places whose value is the least within REACH to both sides; equal ones count each."""
    low, width = np.pad(h, REACH, constant_values=np.iinfo(h.dtype).max), 1
    while width < 2 * REACH + 1:  # the least of the 2 * REACH + 1 values from each place on, by doubling
        step = min(width, 2 * REACH + 1 - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    return np.flatnonzero(h == low[: len(h)])


def chunks(text: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, place in the row, start and end (code points), words, words that a passage may have before and after it, and two digests of each
    chunk of a string column.

    A word counts for the chunk it begins in.
    """
    data, ends = buffers(text)
    n = len(data)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(9))
    h = gear(data)
    low = np.flatnonzero(h < np.uint32((1 << 32) // MEAN_GAP)) + 1  # a chunk may end before byte `low`
    row = np.searchsorted(ends, low, "left") - 1
    low = low[low - ends[row] >= WINDOW]  # a window that reaches into the row before says nothing
    low = low[(low < n)]
    low = low[(data[low] & 0xC0) != 0x80]
    far = np.ones(len(low), bool)
    far[1:] = np.diff(low) > LEAST
    cut = np.unique(np.concatenate((low[far], ends)))
    more = [a + WINDOW + least_places(h[a + WINDOW : b]) + 1 for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a > LONG] if np.diff(cut).max() > LONG else []
    if more:
        more = np.concatenate(more)
        cut = np.unique(np.concatenate((cut, more[(more < n) & ((data[np.minimum(more, n - 1)] & 0xC0) != 0x80)])))
    start, end = cut[:-1], cut[1:]
    row = np.searchsorted(ends, start, "right") - 1
    up, down = powers(n)
    c = np.zeros(n + 1, np.uint64)
    np.multiply(_TABLE[data], up[:n], out=c[1:])
    np.cumsum(c[1:], out=c[1:])
    digest = mix((c[end] - c[start]) * down[start] + (end - start).astype(np.uint64))
    np.multiply(_TABLE_2[data], up[:n], out=c[1:])
    np.cumsum(c[1:], out=c[1:])
    check = (mix((c[end] - c[start]) * down[start]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    first = ~WHITE[data]
    first[1:] &= WHITE[data[:-1]]
    inner = ends[(ends > 0) & (ends < n)]
    first[inner] = ~WHITE[data[inner]]
    word = np.concatenate(([0], np.cumsum(first)))
    point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    place = np.arange(len(row)) - np.searchsorted(row, row, "left")
    words = word[end] - word[start]
    reach = np.maximum(np.roll(start, 1) - WINDOW - LEAST, ends[row])  # boundaries there may come of what stands before the passage
    before, after = np.where(place > 0, word[start] - word[np.minimum(reach, start)], 0), np.where(np.append(place[1:] > 0, False), np.roll(words, -1), 0)
    return row, place, point[start] - point[ends[row]], point[end] - point[ends[row]], words, before, after, digest.view(np.int64), check


def chunk_rows(docs: DataFrame) -> DataFrame:
    """doc_id, place, start, end, n_words, before, after, digest, check of every chunk of every text; rows without id or text have none."""
    names = ["place", "start", "end", "n_words", "before", "after"]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                row, *numbers, digest, check = chunks(part.column("text"))
                if len(row):
                    ids = part.column("doc_id").to_numpy(zero_copy_only=False)[row]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(a.astype(np.int32)) for a in numbers], pa.array(digest), pa.array(check)], ["doc_id", *names, "digest", "check"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.mapInArrow(run, f"doc_id long, {', '.join(f'{n} int' for n in names)}, digest long, check int")


def find(docs: DataFrame, min_words: int = MIN_WORDS, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """One row for each repeated passage of each document: doc_id, start, end (code points), n_words, first_doc_id, kept, cuts.

    first_doc_id is the smallest id that holds part of the passage; kept tells that the document itself keeps all of it;
    cuts are the spans to delete so that each shared chunk stays once. What repeats in one document only is left alone;
    rows of one id are one document, whose equal chunks count once. Null and empty texts have no passages; only doc_id and
    text are read, and repeated rows give no row twice.
    """
    rows, key = chunk_rows(docs), ["digest", "check"]
    owners, _ = written(rows.groupBy(*key).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("owner < last").drop("last"))
    total = owners.agg(F.sum("n").alias("n")).first()["n"] or 0
    bound = max(LEAST_HOT, total // HOT_SHARE)
    hot = owners.where(F.col("n") > bound).select(*key, F.col("owner").alias("hot"))  # HOT_SHARE rows at most
    rows = rows.join(F.broadcast(hot), key, "left")
    cold = rows.where("hot IS NULL").drop("hot").join(owners.where(F.col("n") <= bound).drop("n"), key)
    shared = cold.unionByName(rows.where("hot IS NOT NULL").withColumnRenamed("hot", "owner"))
    per_doc = Window.partitionBy("doc_id").orderBy("place", "start", "end", "digest")
    # rows of one id fall together: an equal place, or the next one, goes on with the run
    shared = shared.select("doc_id", "place", "start", "end", "n_words", "before", "after", "owner", "digest").withColumn("last", F.lag("place").over(per_doc))
    shared = shared.withColumn("run", F.sum(F.when(F.col("place") - F.col("last") <= 1, 0).otherwise(1)).over(per_doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = shared.groupBy("doc_id", "run").agg(
        F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.sum("n_words").alias("n_words"), F.min("owner").alias("first_doc_id"),
        F.bool_and(F.col("owner") == F.col("doc_id")).alias("kept"), (F.min(F.struct("place", "before"))["before"] + F.max(F.struct("place", "after"))["after"]).alias("around"),
        F.array_sort(F.collect_set(F.when(F.col("owner") != F.col("doc_id"), F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))))).alias("cuts"),
    )
    return runs.where((F.col("n_words") >= min_words) & (F.col("n_words") + F.col("around") >= passage_words)).drop("run", "around")


def cut(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs with the spans to delete taken out of their texts; all columns stay, and so do rows without passages.

    passages: what find() gave for docs. Meant for docs with one row for each id.
    """
    spans = passages.where(F.size("cuts") > 0).groupBy(F.col("doc_id").alias("_cut_id")).agg(F.flatten(F.collect_list("cuts")).alias("_cuts"))

    @F.pandas_udf("string")
    def without(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        def one(text, spans):
            if text is None or spans is None:
                return text
            out, at = [], 0
            for s in sorted((s["start"], s["end"]) for s in spans):
                out.append(text[at : max(at, s[0])])
                at = max(at, s[1])
            return "".join([*out, text[at:]])

        return pd.Series([one(t, c) for t, c in zip(texts, cuts, strict=True)], dtype=object)

    joined = docs.join(spans, F.col("doc_id") == F.col("_cut_id"), "left")
    return joined.withColumn("text", without("text", "_cuts")).select(*docs.columns)
