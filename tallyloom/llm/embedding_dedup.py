"""Embedding near-duplicates by product quantisation: coarse inverted lists, residual codes, table distances, exact cosine.

Vectors are scaled to length 1, so a cosine of `cosine` or more is a distance of `radius` or less. A vector's home is the list
of its nearest centroid; what is left is coded by the nearest code word in each subspace, and the coding error is kept. A
link across two lists crosses the plane half-way between their centroids, so a vector probes a list if that plane is within
MARGIN_SIGMAS / sqrt(dimension) of the radius: the part along the plane's normal of a difference of that length, in a
direction not tied to the plane, is beyond that once in tens of thousands. In a list, the table distance less the coding
error is a lower bound of the true distance, so leaving out what it puts beyond the radius loses nothing; what stays is
decided by the exact cosine in double precision.

Lists are dealt out in cells (a part of the list's members and of its visitors against a part of its members), so a list
with a third of all vectors is many cells. A cell emits numbers of links and a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, delete, written
from .kernel import sampled, small_batches

COSINE = 0.95
MARGIN_SIGMAS = 4.0
SUBSPACES = 8
CODE_WORDS = 64
#: Lists: about LISTS_FACTOR * sqrt(rows), up to MAX_LISTS. Centroids and code words are fitted on about so many rows at
#: most: MIN_TRAINING_ROWS, or 8 for each list; all rows are indexed.
LISTS_FACTOR = 2.0
MAX_LISTS = 16_384
MIN_TRAINING_ROWS = 20_000
PART_ROWS = 1_000


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by a power of two first: squares of the large components of any finite vector neither over- nor underflow."""
    if not x.size:
        return x
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    half = (centres**2).sum(1) / 2
    for lo in range(0, len(x), 2048):
        out[lo : lo + 2048] = (half - x[lo : lo + 2048] @ centres.T).argmin(1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Centroids; starts from rows evenly spread over x, and empty ones stay where they were."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        home = nearest(x, centres)
        many = np.bincount(home, minlength=len(centres))
        order = np.argsort(home, kind="stable")
        full = np.flatnonzero(many)
        sums = np.add.reduceat(x[order], np.concatenate(([0], np.cumsum(many)))[full], axis=0)
        centres[full] = sums / many[full, None]
    return centres


class Quantiser:
    """Coarse centroids and the code words of each subspace."""

    def __init__(self, sample: np.ndarray, lists: int, radius: float):
        self.radius = radius
        self.centres = k_means(sample, lists)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.spans = [s for s in np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1])) if len(s)]
        self.words = [k_means(rest[:, s], CODE_WORDS) for s in self.spans]
        self.margin = radius * min(1.0, MARGIN_SIGMAS / math.sqrt(sample.shape[1])) + 1e-9
        self.gaps = None

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and coding errors."""
        rest = x - self.centres[home]
        codes = np.stack([nearest(rest[:, s], w) for s, w in zip(self.spans, self.words, strict=True)], axis=1).astype(np.uint8)
        left = np.concatenate([rest[:, s] - w[codes[:, j]] for j, (s, w) in enumerate(zip(self.spans, self.words, strict=True))], axis=1)
        return codes, np.sqrt((left**2).sum(1))

    def probes(self, x: np.ndarray, home: np.ndarray) -> list[np.ndarray]:
        """For each vector, the lists after its home that a link may lead to."""
        out = []
        half = (self.centres**2).sum(1)
        for lo in range(0, len(x), 512):
            far = half - 2 * x[lo : lo + 512] @ self.centres.T
            h = home[lo : lo + 512]
            gap = np.sqrt(np.maximum(half[h][:, None] + half - 2 * self.centres[h] @ self.centres.T, 1e-18))
            near = (far - far[np.arange(len(h)), h][:, None]) / (2 * gap) <= self.margin
            near &= np.arange(len(half)) > h[:, None]
            out += [np.flatnonzero(r) for r in near]
        return out

    def table_distances(self, x: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Distances of vectors (rows) to the decoded members (columns) of a list, from a table for each subspace."""
        rest = x - self.centres[centre]
        total = np.zeros((len(x), len(codes)), np.float32)
        for j, (s, w) in enumerate(zip(self.spans, self.words, strict=True)):
            table = ((rest[:, s] ** 2).sum(1)[:, None] - 2 * rest[:, s] @ w.T + (w**2).sum(1)).astype(np.float32)
            total += table[:, codes[:, j]]
        return np.sqrt(np.maximum(total, 0))


def _vectors(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(b.as_buffer(), np.float64) for b in column]) if len(column) else np.zeros((0, 0))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes, the smallest node reachable over the edges (a, b)."""
    label = np.arange(n)
    while True:
        old = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == old).all():
            return label


def _valid(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array of double), dimension of the vectors that can link."""
    x = small_batches(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return x.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(finite & F.exists("x", lambda v: v != 0)).withColumn("dimension", F.size("x"))


def compare_cells(rows: DataFrame, quantiser: Quantiser, cosine: float) -> DataFrame:
    """kind 0: vector a has n more links (weighted by copies); kind 1: an edge (a, b) of a spanning forest."""
    shared = rows.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches):
        q = shared.value
        table = pa.Table.from_batches([batches]) if isinstance(batches, pa.RecordBatch) else batches
        cell = int(table["list"][0].as_py())
        role = table["role"].to_numpy()
        ids, copies = table["vec_id"].to_numpy(), table["copies"].to_numpy()
        x = unit(_vectors(table["x"].combine_chunks()))
        left, right = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        out = {"kind": [], "a": [], "b": [], "n": []}
        if len(left) and len(right):
            codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
            error = table["error"].to_numpy()
            low = q.table_distances(x[left], cell, codes[right]) - error[right].astype(np.float32)
            i, j = np.nonzero(low <= q.radius + 1e-4)
            a, b = left[i], right[j]
            if role[0] == 2 or (role == 2).any():  # a part against itself: each pair once
                a, b = a[a < b], b[a < b]
            hit = np.zeros(len(a), bool)
            for lo in range(0, len(a), 65536):
                u, v = a[lo : lo + 65536], b[lo : lo + 65536]
                hit[lo : lo + 65536] = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
            a, b = a[hit], b[hit]
            if len(a):
                n = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
                label = forest(a, b, len(ids))
                some, tied = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(ids)))
                out = {
                    "kind": np.repeat(np.array([0, 1], np.int32), [len(some), len(tied)]), "a": np.concatenate((ids[some], ids[tied])),
                    "b": np.concatenate((ids[some], ids[label[tied]])), "n": np.concatenate((n[some], np.zeros(len(tied)))).astype(np.int64),
                }
        return pa.table({"kind": pa.array(out["kind"], pa.int32()), "a": pa.array(out["a"], pa.int64()), "b": pa.array(out["b"], pa.int64()), "n": pa.array(out["n"], pa.int64())})

    return rows.groupBy("list", "i", "j").applyInArrow(run, "kind int, a long, b long, n long")


def links(distinct: DataFrame, rows: int, cosine: float) -> DataFrame:
    """Links among different vectors of one dimension (vec_id, x, copies): what compare_cells() gives."""
    spark = distinct.sparkSession
    lists = max(1, min(MAX_LISTS, int(LISTS_FACTOR * math.sqrt(rows))))
    most = max(MIN_TRAINING_ROWS, 8 * lists)
    sample = sampled(distinct, "vec_id", most, rows).select("vec_id", "x").toArrow().sort_by("vec_id")["x"]  # about `most` rows
    if not len(sample):
        raise RuntimeError(f"a sample of about {most} of {rows} vectors is empty")
    sample = unit(np.stack([r.values.to_numpy() for r in sample]))
    quantiser = Quantiser(sample, lists, math.sqrt(max(0.0, 2 - 2 * cosine)))
    shared = spark.sparkContext.broadcast(quantiser)

    def index(batches):
        q = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                raw = np.stack([r.values.to_numpy() for r in part.column("x")])
                x = unit(raw)
                home = nearest(x, q.centres)
                codes, error = q.encode(x, home)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("copies"), pa.array(home.astype(np.int32)), pa.array([p.astype(np.int32) for p in q.probes(x, home)], pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array([r.tobytes() for r in raw], pa.binary())],
                    ["vec_id", "copies", "home", "visits", "codes", "error", "x"],
                )

    indexed, path = written(distinct.select("vec_id", "x", "copies").mapInArrow(index, "vec_id long, copies long, home int, visits array<int>, codes binary, error double, x binary"))
    # parts of each list: rows of the order of MAX_LISTS
    members = indexed.groupBy(F.col("home").alias("list")).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("k"))
    visitors = indexed.select(F.explode("visits").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("v"))
    sizes = F.broadcast(members.join(visitors, "list", "left").select("list", "k", F.coalesce("v", F.lit(0)).alias("v")))
    keep = ["vec_id", "copies", "codes", "error", "x"]
    spot = lambda n: F.pmod(F.xxhash64("vec_id"), F.greatest(n, F.lit(1))).cast("int")
    cell = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(role).alias("role"))
    home = indexed.select(*keep, F.col("home").alias("list")).join(sizes, "list").withColumn("p", spot(F.col("k")))
    own = F.array(cell(F.col("p"), F.col("p"), 2))
    as_left = F.transform(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda j: j > F.col("p")), lambda j: cell(F.col("p"), j, 0))
    as_right = F.transform(F.filter(F.sequence(F.lit(0), F.col("k") + F.col("v") - 1), lambda i: (i < F.col("p")) | (i >= F.col("k"))), lambda i: cell(i, F.col("p"), 1))
    home = home.select("list", *keep, F.explode(F.concat(own, as_left, as_right)).alias("c"))
    away = indexed.select(*keep, F.explode("visits").alias("list")).join(sizes, "list").withColumn("p", F.col("k") + spot(F.col("v")))
    away = away.select("list", *keep, F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: cell(F.col("p"), j, 0))).alias("c"))
    cells = home.unionByName(away).select("list", "c.i", "c.j", "c.role", *keep)
    found, _ = written(compare_cells(cells, quantiser, cosine))
    delete(spark, path)
    return found


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    Links: other rows with cosine >= `cosine`, equal ones included; rows of one id count as so many vectors that share the
    id's component. Vectors that are null, zero or hold null or non-finite components, and null ids, link with nothing, and
    vectors of different dimension do not link. Only vec_id and embedding are read; a table without valid rows gives rows
    without links.
    """
    valid = _valid(vectors)
    distinct, path = written(valid.groupBy("x", "dimension").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    found = None
    for row in sorted(distinct.groupBy("dimension").count().collect()):  # one row for each dimension
        part = links(distinct.where(F.col("dimension") == row["dimension"]), row["count"], cosine)
        found = part if found is None else found.unionByName(part)
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    if found is None:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    known = distinct.select(F.col("x").alias("_x"), F.col("vec_id").alias("first"), "copies")
    members = valid.join(known, F.col("x") == F.col("_x")).select("vec_id", "first", "copies")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("n"))
    members = members.join(counts, "first", "left").select("vec_id", "first", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    members, _ = written(members)
    edges = found.where("kind = 1").select("a", "b").unionByName(members.where("vec_id <> first").select(F.col("vec_id").alias("a"), F.col("first").alias("b")))
    out = members.select("vec_id", "n_links").join(components(edges), F.col("vec_id") == F.col("node"), "left").select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
    rest = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    fine = F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("x", lambda v: v != 0)
    rest = rest.where(F.col("vec_id").isNull() | ~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    delete(vectors.sparkSession, path)
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
