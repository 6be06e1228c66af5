"""Hard negatives of embeddings by vertical scan with branch and bound: dimension by dimension, over columns.

A block of vectors is held as columns, one row of a matrix for each dimension. For an anchor, dimensions are read in the order of
its own components, largest magnitude first, a few at a time. What the dimensions not read yet can add to a score lies between sums
of products with each dimension's least and largest value of the block, so every candidate has bounds of its score, and the bitmap of
candidates shrinks: to those that may be among the best of the anchor's label (positives), or to those that may lie in the window of
one of its positives and be among the first there (negatives). What is left when all dimensions are read has its exact score.

Anchors are the rows whose vec_id is divisible by ANCHOR_EVERY. They are broadcast in groups of a bounded size; for each group all
vectors are read twice where they are, without a shuffle, and a task emits its best rows for each anchor, not pairs. Scores are whole
numbers, summed in double precision while that is exact and as Python's integers beyond.

Rows with a null vec_id, label or vector, or a null or non-finite component, take no part. Rows of the anchor's vec_id are not among
its others. Repeated rows count as often as they occur as positives and negatives, and once as anchors. Vectors of different
lengths are compared over the components that both have. Only vec_id, label and embedding are read; an empty table has no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import delete, shared_folder, written
from .kernel import small_batches

ANCHOR_EVERY = 50
RELABEL_EVERY = 7
LABELS = 10
POSITIVES = 5
NEGATIVES = 3
SCALE = 256
#: A negative's score is at least and at most so many hundredths of the positive's.
LEAST, MOST = 50, 95
#: Anchors of a group at most, and bytes of their components.
GROUP_ANCHORS = 16_384
GROUP_BYTES = 16 << 20
#: Dimensions read between two looks at the bounds.
STEP = 8


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows that take part; some labels moved on, as the task states."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(good)
    return rows.withColumn("label", F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))


def columns(vectors: pa.Array) -> np.ndarray:
    """A row for each dimension, a column for each vector, missing components 0; whole numbers, as objects where doubles are not exact."""
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), vectors.value_lengths().to_numpy(zero_copy_only=False)
    most = int(sizes.max()) if len(sizes) else 0
    whole = np.floor(np.asarray(flat, np.float64) * SCALE)
    if len(sizes) and (sizes == most).all():
        return np.ascontiguousarray(whole.reshape(len(sizes), most).T)
    out = np.zeros((len(sizes), most))
    out[np.arange(most) < sizes[:, None]] = whole
    return np.ascontiguousarray(out.T)


def exact(anchor: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as they are if every sum of products is exact in double precision, else as Python's integers."""
    most = float(np.abs(anchor).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, len(anchor))
    if most < 2**53:
        return anchor, x
    whole = np.vectorize(int, otypes=[object])
    return whole(anchor) if anchor.size else anchor.astype(object), whole(x) if x.size else x.astype(object)


class Columns:
    """Vectors by columns, with the least and the largest value of each dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.low, self.high = (x.min(1), x.max(1)) if x.shape[1] else (x.sum(1), x.sum(1))

    def scan(self, anchor: np.ndarray, shrink) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the vectors that stay. shrink(partial, least, most) gives the bitmap of those that may count, if what
        is still to come adds `least` to `most`."""
        d = min(len(anchor), len(self.x))
        anchor, x = exact(anchor[:d], self.x[:d])
        order = np.argsort(-np.abs(anchor), kind="stable")
        a, b = anchor * self.low[:d], anchor * self.high[:d]
        least, most = (np.append(np.cumsum(f(a, b)[order][::-1])[::-1], 0) for f in (np.minimum, np.maximum))
        at, part = None, np.zeros(x.shape[1], x.dtype)  # at: the columns that are left
        for k in range(0, d, STEP):
            dims = order[k : k + STEP]
            part = part + anchor[dims] @ (x[dims] if at is None else x[dims[:, None], at])
            keep = shrink(part, least[min(d, k + STEP)], most[min(d, k + STEP)])
            if not keep.all():
                at = np.flatnonzero(keep) if at is None else at[keep]
                part = part[keep]
            if not len(part):
                break
        return (self.ids if at is None else self.ids[at]), part


def kth(x: np.ndarray, k: int):
    """The k-th largest value of x, or None."""
    return None if len(x) < k else np.partition(x, len(x) - k)[len(x) - k]


def first(ids: list[int], scores: list[int], k: int) -> tuple[list[int], list[int]]:
    """The k rows of the highest scores, the smaller id first among equals."""
    best = sorted(zip([-s for s in scores], ids, strict=True))[:k]
    return [i for _, i in best], [-s for s, _ in best]


def trimmed(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """As first(), from arrays of any length."""
    if len(ids) > 4 * k:
        bound = kth(scores, k)
        above, equal = np.flatnonzero(scores > bound), np.flatnonzero(scores == bound)
        if len(equal) > k:
            equal = equal[np.argpartition(ids[equal], k - 1)[:k]]
        at = np.concatenate((above, equal))
        ids, scores = ids[at], scores[at]
    return first([int(i) for i in ids], [int(s) for s in scores], k)


class Positives:
    """The best others of each anchor's label, over the blocks that a task reads."""

    def __init__(self, anchors: dict):
        self.anchors = anchors
        self.best: list[tuple[list[int], list[int]]] = [([], []) for _ in anchors["ids"]]

    def read(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        blocks = {label: Columns(ids[at], x[:, at]) for label in set(labels.tolist()) if len(at := np.flatnonzero(labels == label))}
        for n, (own, label, vector) in enumerate(zip(self.anchors["ids"], self.anchors["labels"], self.anchors["vectors"], strict=True)):
            block = blocks.get(label)
            if block is None:
                continue
            found, scores = self.best[n]
            # one more than wanted: the anchor itself may be in the block, however often
            want = POSITIVES + int((block.ids == own).sum())
            floor = scores[-1] if len(scores) == POSITIVES else None

            def shrink(part, least, most, want=want, floor=floor):
                bound = kth(part, want)
                bound = floor if bound is None else bound + least if floor is None else max(floor, bound + least)
                return np.ones(len(part), bool) if bound is None else part + most >= bound

            new, exact_scores = block.scan(vector, shrink)
            other = new != own
            a, b = trimmed(new[other], exact_scores[other], POSITIVES)
            self.best[n] = first(found + a, scores + b, POSITIVES)

    def rows(self):
        for n, (ids, scores) in enumerate(self.best):
            for i, s in zip(ids, scores, strict=True):
                yield n, i, s

    names = ["anchor", "positive_id", "positive_score"]


class Negatives:
    """The first rows of other labels in the window of each positive, over the blocks that a task reads."""

    def __init__(self, anchors: dict):
        self.anchors = anchors
        self.windows = [[(-(-LEAST * p // 100), MOST * p // 100) for p in scores] for scores in anchors["positive_scores"]]
        self.best = [[([], []) for _ in w] for w in self.windows]

    def read(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        blocks = {label: Columns(ids[at], x[:, at]) for label in set(self.anchors["labels"]) if len(at := np.flatnonzero(labels != label))}
        for n, (own, label, vector) in enumerate(zip(self.anchors["ids"], self.anchors["labels"], self.anchors["vectors"], strict=True)):
            block = blocks.get(label)
            windows = {w: [max(lo, self.best[n][w][1][-1]) if len(self.best[n][w][1]) == NEGATIVES else lo, hi] for w, (lo, hi) in enumerate(self.windows[n]) if lo <= hi}
            if block is None or not windows:
                continue
            taken = int((block.ids == own).sum())

            def shrink(part, least, most, windows=windows, want=NEGATIVES + taken):
                keep = np.zeros(len(part), bool)
                for bounds in windows.values():
                    lo, hi = bounds
                    sure = part[(part >= lo - least) & (part <= hi - most)]
                    bound = kth(sure, want)
                    if bound is not None:
                        bounds[0] = max(lo, bound + least)
                    keep |= (part >= bounds[0] - most) & (part <= hi - least)
                return keep

            new, scores = block.scan(vector, shrink)
            other = new != own
            new, scores = new[other], scores[other]
            for w, (lo, hi) in windows.items():
                inside = (scores >= lo) & (scores <= hi)
                if inside.any():
                    a, b = trimmed(new[inside], scores[inside], NEGATIVES)
                    kept_ids, kept_scores = self.best[n][w]
                    self.best[n][w] = first(kept_ids + a, kept_scores + b, NEGATIVES)

    def rows(self):
        for n, best in enumerate(self.best):
            for w, (ids, scores) in enumerate(best):
                for i, s in zip(ids, scores, strict=True):
                    yield n, w, self.anchors["ids"][n], self.anchors["positive_ids"][n][w], self.anchors["positive_scores"][n][w], i, s

    names = ["anchor", "window", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]


def scanned(rows: DataFrame, kind: type, anchors: dict) -> DataFrame:
    """What the tasks over rows have found for a group of anchors."""
    held = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        state = kind(held.value)
        for batch in batches:
            if batch.num_rows:
                ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
                state.read(ids, labels, columns(batch.column("embedding")))
        found = list(state.rows())
        for at in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[at : at + 10_000], strict=True)], kind.names)

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in kind.names))


def group_of(anchors: DataFrame, group: int) -> dict:
    """The anchors of a group, in the order of their ids, with their vectors as whole numbers; at most about GROUP_ANCHORS."""
    table = anchors.where(F.col("group") == group).select("vec_id", "label", "embedding").orderBy("vec_id", "label", "embedding").toArrow()
    vectors = [columns(chunk).T for chunk in table.column("embedding").chunks]
    lengths = [n for chunk in table.column("embedding").chunks for n in chunk.value_lengths().to_pylist()]
    return {"ids": table.column("vec_id").to_pylist(), "labels": table.column("label").to_pylist(), "vectors": [v[:n] for v, n in zip((v for m in vectors for v in m), lengths, strict=True)]}


def mine(vectors: DataFrame) -> DataFrame:
    """A row for each anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    rows = small_batches(usable(vectors))
    about = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0).agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    groups = max(1, -(-about["n"] // max(1, min(GROUP_ANCHORS, GROUP_BYTES // (8 * max(1, about["d"] or 1))))))
    anchors, anchors_path = written(rows.where(F.col("vec_id") % ANCHOR_EVERY == 0).distinct().withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    path = f"{shared_folder(spark)}/{anchors_path.rsplit('/', 1)[1]}-mined"
    spark.createDataFrame([], schema).write.parquet(path)
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    in_window = Window.partitionBy("anchor", "window").orderBy(F.desc("negative_score"), "negative_id")
    for group in range(groups):
        held = group_of(anchors, group)
        if not held["ids"]:
            continue
        best = scanned(rows, Positives, held).withColumn("place", F.row_number().over(order)).where(F.col("place") <= POSITIVES)
        held |= {"positive_ids": [[] for _ in held["ids"]], "positive_scores": [[] for _ in held["ids"]]}
        for r in best.orderBy("anchor", "place").collect():  # POSITIVES rows for each anchor of the group at most
            held["positive_ids"][r["anchor"]].append(r["positive_id"])
            held["positive_scores"][r["anchor"]].append(r["positive_score"])
        found = scanned(rows, Negatives, held).withColumn("rank", F.row_number().over(in_window)).where(F.col("rank") <= NEGATIVES)
        found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
    delete(spark, anchors_path)
    return spark.read.schema(schema).parquet(path)
