"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A sentence's score is a logistic function of the hashed words and word beginnings in it. A document is toxic if any of its
sentences is: P = 1 - prod(1 - p). Training maximises the likelihood of document labels, weighted so that the sample has
the class shares of all labelled rows; a document that is found toxic comes with its offending sentences.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Words, crc_fold, mix, sampled, slices, small_batches

BUCKETS = 1 << 20
#: Beginnings of words, in bytes, that are features besides the whole word.
PREFIXES = (4, 5, 6, 7)
#: About so many labelled rows of each class at most are fitted, chosen by a hash of the id.
MAX_TRAINING_ROWS = 2_500
#: Of a text's sentences so many at most are fitted, evenly spread over the text, so that the sample is bounded in bytes too. All are scored.
MAX_TRAINING_SENTENCES = 1_000
EPOCHS = 250
#: Weight decay, and the pull to zero that makes the weights sparse.
DECAY, SPARSITY = 0.3, 0.5
_SLICE = 1 << 19
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[10, 33, 46, 63]] = True


def sentences(text: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the rows; the features, word by word; the first word of each sentence; sentences before each row."""
    words = Words(text, _INSIDE)
    n = len(words.start)
    c = words.sums()
    length = words.end - words.start
    feats = np.zeros((n, 1 + len(PREFIXES)), np.int32)
    for j, size in enumerate((0, *PREFIXES)):
        h = c[words.start + np.minimum(length, size)] if size else c[words.end]
        h = (h - c[words.start]) * words.down[words.start]
        feats[:, j] = (mix(h + np.uint64(size)) >> np.uint64(44)).astype(np.int32)
        if size:
            feats[length <= size, j] = -1
    part = np.cumsum(_BREAK[words.data])[words.start] if n else np.zeros(0, np.int64)
    new = np.ones(n, bool)
    if n:
        new[1:] = part[1:] != part[:-1]
        new[words.rows[:-1][words.rows[:-1] < n]] = True
    first = np.flatnonzero(new)
    return words, feats, first, np.searchsorted(first, words.rows)


def _sums(weights: np.ndarray, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the weights of each sentence's features (features may repeat)."""
    if not len(first):
        return np.zeros(0)
    return np.add.reduceat(np.where(feats < 0, np.float32(0), weights[feats]).sum(1, dtype=np.float64), first)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 5, rest: int = 0, max_rows: int = MAX_TRAINING_ROWS) -> np.ndarray | None:
    """Weights (BUCKETS of them, then the bias), or None, with a warning, if not both classes occur among labelled texts.

    Ids of the held-out fold (crc32 modulo `mod` is `rest`), null ids and null labels are left out; an id that is labelled
    more than once counts as toxic if any of its labels is 1.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % mod != rest)
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return _nothing(sizes)
    sample = sampled(known.where("y = 1"), "doc_id", max_rows, sizes[1]).unionByName(sampled(known.where("y = 0"), "doc_id", max_rows, sizes[0]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=_SLICE):
                words, feats, first, at = sentences(part.column("text"))
                out_feats, out_sizes, out_y = [], [], []
                for i, y in enumerate(part.column("y").to_pylist()):
                    lo, hi = words.rows[i], words.rows[i + 1]
                    edges = np.append(first[at[i] : at[i + 1]], hi)
                    spans = list(zip(edges[:-1], edges[1:], strict=True)) if hi > lo else []
                    if len(spans) > MAX_TRAINING_SENTENCES:
                        spans = [spans[k] for k in np.linspace(0, len(spans) - 1, MAX_TRAINING_SENTENCES).astype(int)]
                    per = [np.unique(f[f >= 0]) for f in (feats[a:b] for a, b in spans)]
                    out_feats.append(np.concatenate(per) if per else np.zeros(0, np.int32))
                    out_sizes.append(np.array([len(p) for p in per], np.int32))
                    out_y.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(out_y, pa.int32()), pa.array(out_sizes, pa.list_(pa.int32())), pa.array(out_feats, pa.list_(pa.int32()))], ["y", "sizes", "feats"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.join(F.broadcast(sample), "doc_id").select("text", "y").mapInArrow(run, "y int, sizes array<int>, feats array<int>").toArrow()  # at most about 2 * max_rows texts
    parts = {c: [x.values.to_numpy() for x in found[c]] for c in ("sizes", "feats")}
    bags = sorted((y, len(f), int(f[:50].sum()), i) for i, (y, f) in enumerate(zip(found["y"].to_pylist(), parts["feats"], strict=True)) if len(f))  # one order whatever the partitions were
    if len(classes := {b[0] for b in bags}) < 2:
        return _nothing(classes)
    return _fit(np.array([b[0] for b in bags], float), *([parts[c][b[-1]] for b in bags] for c in ("sizes", "feats")), sizes)


def _nothing(classes) -> None:
    if classes:  # without any label there is nothing to say
        warnings.warn(f"labelled texts are all of class {sorted(classes)}: every text will score 0", stacklevel=3)


def _fit(y: np.ndarray, sizes: list, feats: list, labelled: dict) -> np.ndarray:
    used, feat = np.unique(np.concatenate(feats), return_inverse=True)
    docs_with = np.bincount(feat, minlength=len(used))
    feat = np.where(docs_with >= 3, np.arange(len(used)), -1)[feat]  # seen in fewer sentences: no evidence
    keep = feat >= 0
    size = np.concatenate(sizes)
    owner = np.repeat(np.arange(len(size)), size)[keep]
    feat = feat[keep]
    doc = np.repeat(np.arange(len(y)), [len(s) for s in sizes])
    total = labelled[0] + labelled[1]
    weight = np.where(y > 0, labelled[1] / total / y.sum(), labelled[0] / total / (1 - y).sum()) * len(y)
    bias, gw, gb = -6.0, np.full(len(used), 1e-8), 1e-8
    pair = np.unique(np.stack((feat, doc[owner])), axis=1)
    toxic, other = (np.bincount(pair[0], of[pair[1]], len(used)) for of in (y, 1 - y))
    w = np.maximum(0, np.log((toxic + 0.1) / (y.sum() + 0.2)) - np.log((other + 0.1) / ((1 - y).sum() + 0.2))) / 2
    w[toxic + other < 3] = 0
    for _ in range(EPOCHS):
        z = bias + np.bincount(owner, w[feat], len(size))
        clean = np.bincount(doc, _softplus(z), len(y))  # -log(1 - P)
        odds = 1 / np.maximum(np.expm1(np.minimum(clean, 700)), 1e-12)  # (1 - P) / P
        p = 1 / (1 + np.exp(-z))
        g = p * (weight * np.where(y > 0, odds, -1.0))[doc]
        step = np.bincount(feat, g[owner], len(used)) - DECAY * w - SPARSITY * np.sign(w)
        gw += step**2
        w += 0.5 * step / np.sqrt(gw)
        gb += (b := g.sum()) ** 2
        bias += 0.5 * b / np.sqrt(gb)
    out = np.zeros(BUCKETS + 1, np.float32)
    out[used] = w
    out[-1] = bias
    return out


def score(docs: DataFrame, weights: np.ndarray | None, mod: int = 5, rest: int = 0) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted, offending.

    offending: start and end (code points, the end exclusive) and score of each sentence that scores 0.5 or more. Null and
    empty texts, and every text where there was nothing to learn from, score 0. Repeated rows and null ids are kept; only
    doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS floats
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        weights = shared.value
        for batch in batches:
            for part in slices(batch, most=_SLICE):
                n = part.num_rows
                out, found = np.zeros(n), [[] for _ in range(n)]
                if weights is not None:
                    words, feats, first, at = sentences(part.column("text"))
                    z = weights[-1] + _sums(weights, feats, first)
                    row = np.repeat(np.arange(n), np.diff(at))
                    out = -np.expm1(-np.bincount(row, _softplus(z), n))
                    if len(hot := np.flatnonzero(z >= 0)):
                        point = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
                        ends = np.append(first[1:], len(words.start))
                        for s in hot:
                            zero = point[words.ends[row[s]]]
                            found[row[s]].append({"start": int(point[words.start[first[s]]] - zero), "end": int(point[words.end[ends[s] - 1]] - zero), "score": float(1 / (1 + np.exp(-z[s])))})
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(crc_fold(part.column("doc_id"), mod) == rest), pa.array(out), pa.array((out >= 0.5).astype(np.int32)), pa.array(found, kind)],
                    ["doc_id", "held_out", "score", "predicted", "offending"],
                )

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int, offending array<struct<start: long, end: long, score: double>>"
    )
