"""Small numpy helpers that work on one Arrow batch of texts at a time inside a Spark task.

Words are hashed from prefix sums: with ``C[i] = sum(T[byte j] * p**j for j < i)`` the value
``(C[end] - C[start]) * p**-start`` (all modulo 2**64, p odd) depends on the bytes of the word alone, so
every word of a batch is hashed by a handful of array operations. ``T`` holds fixed random 64-bit values; folding
A-Z happens in ``T``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are hashed together; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
TABLE_LOWER = _TABLE[_LOWER]
#: space and \x09-\x0D
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i for i <= n; kept between batches while small."""
    if len(_powers[0]) > n:
        return _powers[0], _powers[1]
    size = max(n, SLICE_BYTES + 1) + 1
    made = []
    for base in (_P, _P_INV):
        a = np.full(size, base, np.uint64)
        a[0] = 1
        made.append(np.multiply.accumulate(a))
    if size <= 4 * SLICE_BYTES:
        _powers[:] = made
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Bytes of an Arrow batch that goes to a Python worker. Both sides hold a batch whole, and what comes of it.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session's Arrow batches are limited to BATCH_BYTES from now on, unless they are smaller already."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)\s*([kmg]?)b?", conf.get(key).strip().lower())
    if not now or int(now[1]) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[now[2]] > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def sample_bound(most: int, total: int) -> int:
    """Of `total` rows with hashes of 63 bits, about `most` lie below this; exact integers, so no total is too large for it."""
    return min(1 << 63, (most << 63) // max(1, total))


def sampled(rows: DataFrame, key: str, most: int, total: int) -> DataFrame:
    """All of `total` rows, or about `most` of them by a hash of the key."""
    if total <= most:
        return rows
    return rows.where(F.shiftrightunsigned(F.xxhash64(key), 1) < sample_bound(most, total))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have at most `most` bytes together, one row at least."""
    if not batch.num_rows:
        return
    text = batch.column(column)
    data = text.cast(pa.large_string()) if not pa.types.is_large_string(text.type) else text
    ends = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1 + data.offset)[data.offset :] if len(data) else np.zeros(1, np.int64)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] + most, "right")) - 1
        to = max(at + 1, min(to, batch.num_rows))
        yield batch.slice(at, to - at)
        at = to


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0) of a string column; null rows are empty."""
    text = text.cast(pa.large_string())
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if text.null_count:
        text = text.fill_null("")
    raw = text.buffers()
    ends = np.frombuffer(raw[1], np.int64, len(text) + 1 + text.offset)[text.offset :]
    if raw[2] is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    return np.frombuffer(raw[2], np.uint8, int(ends[-1] - ends[0]), int(ends[0])), ends - ends[0]


class Words:
    """Words of the rows of a string column: byte start and end of each, row offsets into them, 64-bit hashes.

    `inside`: which bytes belong to words; by default all but ASCII white space.
    """

    def __init__(self, text: pa.Array, inside: np.ndarray | None = None):
        data, ends = buffers(text)
        n = len(data)
        keep = np.zeros(n + 2, bool)
        keep[1:-1] = (~WHITE if inside is None else inside)[data]
        first = keep[1:] & ~keep[:-1]  # a word begins at byte i
        last = keep[:-1] & ~keep[1:]  # a word ends before byte i
        edge = ends[1:-1]
        joined = edge[(edge > 0) & (edge < n)]
        joined = joined[keep[joined] & keep[joined + 1]]  # two rows meet inside what looks like one word
        first[joined] = True
        last[joined] = True
        self.data, self.ends = data, ends
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last)
        self.rows = np.searchsorted(self.start, ends)  # words before each row

    def sums(self) -> np.ndarray:
        up, self.down = powers(len(self.data))
        c = np.zeros(len(self.data) + 1, np.uint64)
        np.multiply(TABLE_LOWER[self.data], up[: len(self.data)], out=c[1:])
        np.cumsum(c[1:], out=c[1:])
        return c

    def hashes(self) -> np.ndarray:
        c = self.sums()
        h = c[self.end]
        h -= c[self.start]
        h *= self.down[self.start]
        return mix(h)


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and row offsets; a row with 1 to k-1 words has one for them all."""
    w, rows = words.hashes(), words.rows
    count = np.diff(rows)
    many = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.concatenate(([0], np.cumsum(many)))
    total = int(at[-1])
    begin = np.repeat(rows[:-1] - at[:-1], many) + np.arange(total)
    out = np.zeros(total, np.uint64)
    padded = np.concatenate((w, np.zeros(k, np.uint64)))
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += padded[begin + j]
    short = np.flatnonzero((count > 0) & (count < k))
    for r in short:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in w[rows[r] : rows[r + 1]]:
                h = h * np.uint64(0xD6E8FEB86659FD93) + x
            out[at[r]] = h * np.uint64(0xA24BAED4963EE407) + np.uint64(count[r])
    return mix(out), at


def crc_fold(doc_id: pa.Array, n: int) -> np.ndarray:
    """crc32 of the id as decimal text, modulo n; a null id counts as empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % n for x in doc_id.to_pylist()], np.int64)
