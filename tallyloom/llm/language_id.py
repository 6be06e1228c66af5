"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import crc_fold, sampled, slices, small_batches

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: The model is fitted on about so many labelled rows at most, chosen by a hash of the id.
MAX_TRAINING_ROWS = 20_000
_SLICE = 1 << 18
_letter: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, 1 if it is a letter."""
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letter[0]


def ngrams(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each row, row offsets into them, and whether a row has a letter.

    Case is folded; runs of anything but letters count as one space, and each text stands between spaces.
    """
    whole = "\n".join(("" if t is None else t).replace("\n", " ").lower() for t in text.to_pylist())
    code = np.frombuffer(f"\n{whole}\n".encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[code]
    row_end = code == 10
    keep = is_letter | row_end
    keep[1:] |= is_letter[:-1]  # one mark after each word; before the first, the row's own
    code = np.where(is_letter, code, np.uint32(32))[keep]
    row_end = row_end[keep]
    row = np.cumsum(row_end)[:-1]
    n = len(text)
    has = np.bincount(row[(code[:-1] != 32)] - 1, minlength=n)[:n] > 0
    parts, owners = [], []
    for k in ORDERS:
        if len(code) < k:
            continue
        h = np.full(len(code) - k + 1, k, np.uint32)
        for j in range(k):
            h = (h ^ code[j : len(code) - k + 1 + j]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        own = np.cumsum(row_end)[: len(h)] - 1
        crossing = np.zeros(len(h), bool)
        for j in range(1, k - 1):  # a row's end may begin or end an n-gram but not lie inside it
            crossing |= row_end[j : len(h) + j]
        good = ~crossing & (own < n)
        if k == 1:
            good &= code != 32
        parts.append((h >> np.uint32(16))[good])
        owners.append(own[good])
    bucket = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(n + 1)), has


def train(labelled: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability matrix (bucket x language; the last row holds the priors).

    labelled: doc_id, text, lang. Rows without text or lang don't count. Above `max_rows` rows, those are taken whose
    hashed id falls below a bound that leaves about `max_rows`. No labelled row: no languages.
    """
    rows = small_batches(labelled).where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    total = rows.count()
    rows = sampled(rows, "doc_id", max_rows, total)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, most=_SLICE):
                bucket, at, _ = ngrams(part.column("text"))
                for i, lang in enumerate(part.column("lang").to_pylist()):
                    np.add.at(sums.setdefault(lang, np.zeros(BUCKETS, np.int64)), bucket[at[i] : at[i + 1]], 1)
                    docs[lang] = docs.get(lang, 0) + 1
        for lang, s in sums.items():
            hit = np.flatnonzero(s)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * (len(hit) + 1), pa.string()),
                "bucket": pa.array(np.append(hit, BUCKETS), pa.int64()),
                "n": pa.array(np.append(s[hit], docs[lang]), pa.int64()),
            })

    found = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    if total and not langs:
        raise RuntimeError(f"a sample of about {max_rows} of {total} labelled rows is empty")
    counts = np.zeros((BUCKETS + 1, len(langs)))
    counts[found["bucket"].to_numpy(int), np.searchsorted(langs, found["lang"])] = found["n"]
    grams = counts[:-1] + 0.1
    model = np.vstack((np.log(grams / grams.sum(0)), np.log((counts[-1] + 1) / (counts[-1] + 1).sum()))) if langs else np.zeros((BUCKETS + 1, 0))
    return langs, model.astype(np.float32)


def _predict(text: pa.Array, langs: list[str], model: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and posterior of each text, and whether it has a letter: the sparse rows of n-gram counts times the matrix."""
    bucket, at, has = ngrams(text)
    n, best, post = len(text), np.zeros(len(text), int), np.zeros(len(text))
    if langs:
        sums = np.tile(model[-1].astype(float), (n, 1))
        full = np.flatnonzero(np.diff(at))
        if len(full):
            for j in range(len(langs)):
                sums[full, j] += np.add.reduceat(model[bucket, j], at[full], dtype=np.float64)
        best = sums.argmax(1)
        post = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
    known = has & bool(langs)
    return [langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, post, 0.0), has


def detect(docs: DataFrame, langs: list[str], model: np.ndarray, held_out_mod: int = 4, held_out_rest: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score.

    score is the posterior of lang_pred. Null text, text without a letter, or no languages: `und` with score 0. Ties go
    to the first language by name. Repeated ids are scored row by row; a null id stays null. Only doc_id and text are
    read, so further columns of any name do no harm.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))  # BUCKETS x languages floats

    def score(batches):
        langs, model = shared.value
        for batch in batches:
            for part in slices(batch, most=_SLICE):
                named, post, _ = _predict(part.column("text"), langs, model)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    "held_out": pa.array(crc_fold(part.column("doc_id"), held_out_mod) == held_out_rest),
                    "lang_pred": pa.array(named, pa.string()),
                    "score": pa.array(post),
                })

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def in_training(doc_id="doc_id", mod: int = 4, rest: int = 2):
    """Column: the row may be learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % mod != rest


def identify(docs: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Fit on the rows of docs outside the held-out fold, then predict every row."""
    langs, model = train(docs.where(in_training()), max_rows)
    return detect(docs, langs, model)


def keep_identified(docs: DataFrame, langs: list[str], model: np.ndarray, least_score: float = 0.5) -> DataFrame:
    """The rows of docs whose language is told with a score of `least_score` or more, with all columns; a null lang is filled.

    Rows of null text, without a letter, or of a lower score go. Without languages to tell (nothing was learned), only texts
    without a letter go.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))

    def run(batches):
        langs, model = shared.value
        for batch in batches:
            for part in slices(batch, most=_SLICE):
                named, post, has = _predict(part.column("text"), langs, model)
                keep = has & (post >= least_score) if langs else has
                out = part
                if langs and "lang" in part.schema.names and part.column("lang").null_count:
                    at = part.schema.get_field_index("lang")
                    out = part.set_column(at, part.schema.field(at), pa.array([a if a is not None else b for a, b in zip(part.column("lang").to_pylist(), named, strict=True)], part.schema.field(at).type))
                yield out.filter(pa.array(keep))

    return small_batches(docs).mapInArrow(run, docs.schema)
