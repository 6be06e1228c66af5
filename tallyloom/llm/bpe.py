"""Byte-level BPE encoding by a bounded-lookahead streaming transducer, and streaming decoding.

A token at the left of a buffer is stable once no byte to come can change it. `Merges.lookahead` bounds, from the merge
list alone, how far a change at the right end of a buffer can reach to the left: a change reaches on only through a chain
of merges of falling priority, each of which wants as its right half a token that begins with the left half of the one
before. The longest such chain, in bytes, is a sufficient lookahead. Bytes are pushed into a Transducer; whenever it holds a
window, all tokens that end a lookahead before the window's end are emitted, and the window moves on to the last emitted boundary
(merges never cross a boundary of the final encoding, so starting afresh there is exact). The end of a pretoken makes all that is
left stable. Texts are taken segment by segment and long pretokens piece by piece, so working memory is a segment, a window and
the bounded cache of short pretokens, whatever the length of the text and whether it has spaces or not.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import slices, small_batches

#: Entries kept of the cache from text unit to encoding, and the longest unit (characters) kept.
CACHE_UNITS = 300_000
CACHE_CHARS = 40
#: Characters that are looked at together for pretokens.
SEGMENT = 1 << 16
#: Bytes from which on a buffer is merged over a heap.
LONG_BUFFER = 64


def byte_characters() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Merges:
    """A merge list over byte strings, with the lookahead that suffices for it."""

    def __init__(self, vocab: dict[str, int], merges: list, special: dict[str, int]):
        to_byte = byte_characters()
        raw = lambda t: bytes(to_byte[c] for c in t)
        pairs = [(raw(a), raw(b)) for a, b in (m.split(" ") if isinstance(m, str) else m for m in merges)]
        self.ids = {raw(t): i for t, i in vocab.items() if all(c in to_byte for c in t) and t not in special}
        self.bytes = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in special.items()}
        #: by a pair of ids: priority (lowest first) and the id that the pair makes
        self.rank = {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.first = [self.ids.get(bytes([b]), -1) for b in range(256)]
        self.special = special
        self.lookahead = self._reach(pairs)

    @staticmethod
    def _reach(pairs: list[tuple[bytes, bytes]]) -> int:
        halves = {a + b: (a, b) for a, b in reversed(pairs)}
        reach: dict[bytes, int] = {}  # by a token: longest chain that goes on at a merge whose right half begins with it
        most = 1
        for left, right in reversed(pairs):
            chain = len(left) + reach.get(left, 0)
            most = max(most, len(right) + chain)
            token = right
            while True:
                if reach.get(token, 0) < chain:
                    reach[token] = chain
                if token not in halves:
                    break
                token = halves[token][0]
        return most + max(len(a) + len(b) for a, b in pairs)

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same over a heap of pairs and a linked list, for buffers in which looking for the least pair anew takes long."""
        n, rank = len(parts), self.rank.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(found[0], i, parts[i], parts[i + 1], found[1]) for i in range(n - 1) if (found := rank((parts[i], parts[i + 1])))]
        heapify(heap)
        while heap:
            _, i, a, b, made = heappop(heap)
            j = right[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two is gone
            parts[i], parts[j] = made, -2
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if found := rank((made, parts[k])):
                    heappush(heap, (found[0], i, made, parts[k], found[1]))
            if (h := left[i]) >= 0 and (found := rank((parts[h], made))):
                heappush(heap, (found[0], h, parts[h], made, found[1]))
        return [p for p in parts if p != -2]

    def merge(self, data: bytes) -> list[int]:
        """Ids of one buffer: the pair of highest priority first, from the left."""
        parts = [self.first[b] for b in data]
        if len(parts) > LONG_BUFFER:
            return self._merge_long(parts)
        rank, none = self.rank.get, (len(self.rank), 0)
        ranks = [rank((a, b), none) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while ranks:
            best = min(ranks)
            if best is none or best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [best[1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
        return parts


class Transducer:
    """Bytes of one pretoken in, ids out as soon as they are stable; holds a window of bytes at most."""

    def __init__(self, merges: Merges):
        self.merges, self.window, self.held = merges, 4 * merges.lookahead, b""

    def push(self, data: bytes) -> Iterator[int]:
        """Ids that are stable now."""
        self.held += data
        stable = self.window - self.merges.lookahead
        at = 0
        while len(self.held) - at > self.window:
            end = 0
            for i in self.merges.merge(self.held[at : at + self.window]):
                if end + len(self.merges.bytes[i]) > stable:
                    break
                end += len(self.merges.bytes[i])
                yield i
            at += end
        self.held = self.held[at:]

    def finish(self) -> list[int]:
        """The rest, at the end of a pretoken."""
        held, self.held = self.held, b""
        return self.merges.merge(held)


def checked(spec: dict) -> dict:
    """A tokenizer's settings, if they are those that are encoded here; others are an error."""
    pre, model, decoder = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("decoder") or {}
    wrong = [name for name, bad in (
        ("normalizer", spec.get("normalizer") is not None), ("pre_tokenizer", pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)), ("decoder", decoder.get("type") != "ByteLevel"),
        ("model", model.get("type", "BPE") != "BPE"), ("model settings", any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))),
        ("added tokens", any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))),
    ) if bad]
    if wrong:
        raise ValueError(f"not a plain byte-level BPE tokenizer: {', '.join(wrong)}")
    return spec


class Encoder:
    """Texts to ids as text: the tokenizer file's special strings, pretokens, merges."""

    def __init__(self, file: str, cache_units: int = CACHE_UNITS):
        self.cache_units = cache_units
        spec = checked(json.loads(file))
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.merges = Merges(spec["model"]["vocab"], spec["model"]["merges"], special)
        self.transducer = Transducer(self.merges)
        #: fixed value: the public byte-level pretoken pattern
        self.pretoken = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        #: white space before a space: a cut between the two would not be a cut between pretokens
        self.tight = [f"{chr(c)} " for c in range(0x3001) if chr(c).isspace()]
        #: runs that a pretoken of the pattern may be: letters, numbers, others, white space
        self.kinds = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")]
        self.loose = regex.compile(r"(?<=\S)(?= \S)")
        self.cache: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def unit(self, unit: str) -> tuple[str, tuple[int, ...]]:
        """Ids of a unit, also joined by commas."""
        out: list[int] = []
        for t in self.pretoken.findall(unit):
            ids = self.words.get(t)
            if ids is None:
                ids = (*self.transducer.push(t.encode("utf-8", "replace")), *self.transducer.finish())
                if len(t) <= CACHE_CHARS:
                    if len(self.words) >= self.cache_units:
                        self.words.clear()
                    self.words[t] = ids
            out += ids
        found = (",".join(map(str, out)), tuple(out))
        if len(unit) <= CACHE_CHARS:
            if len(self.cache) >= self.cache_units:
                self.cache.clear()
            self.cache[unit] = found
        return found

    def units(self, text: str) -> Iterable[str]:
        """Parts of a text between which no pretoken lies: mostly a word with the space before it."""
        if text[:1] != " " and text[-1:] != " " and not any(t in text for t in self.tight):
            first, *rest = text.split(" ")
            return [first, *[" " + w for w in rest]]
        return self.loose.split(text)

    def blocks(self, text: str) -> Iterator[list[tuple[str, tuple[int, ...]]]]:
        """For each segment of the text, (ids joined by commas, ids) of its units in order."""
        get, unit = self.cache.get, self.unit
        for k, plain in enumerate(self.split.split(text) if any(t in text for t in self.merges.special) else [text]):
            if k % 2:
                i = self.merges.special[plain]
                yield [(str(i), (i,))]
                continue
            for segment, loose in self.segments(plain):
                if not loose:
                    yield from self.tight_blocks(segment)
                elif found := [f for u in self.units(segment) if (f := get(u) or unit(u))[1]]:
                    yield found

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of about SEGMENT characters, cut between a non-space and a space before a non-space; and whether a part has such a
        cut near enough. One that has none is as long as it has to be."""
        at = 0
        while at < len(text):
            cut = self.loose.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
            end = cut.start() if cut else len(text)
            yield (text[at:end] if at or end < len(text) else text), end - at <= 4 * SEGMENT
            at = end

    def tight_blocks(self, text: str) -> Iterator[list[tuple[str, tuple[int, ...]]]]:
        """Blocks of a long part without near cuts: pretoken by pretoken, and long pretokens piece by piece."""
        block, size = [], 0
        for start, end in self.spans(text):
            if end - start <= SEGMENT:
                found = self.words.get(text[start:end])
                found = self.unit(text[start:end]) if found is None else (",".join(map(str, found)), found)
                block.append(found)
                size += end - start
            else:
                if block:
                    yield block
                block, size = [], 0
                for at in range(start, end, SEGMENT):
                    if ids := tuple(self.transducer.push(text[at : min(end, at + SEGMENT)].encode("utf-8", "replace"))):
                        yield [(",".join(map(str, ids)), ids)]
                ids = tuple(self.transducer.finish())
                block = [(",".join(map(str, ids)), ids)] if ids else []
            if size >= SEGMENT:
                yield block
                block, size = [], 0
        if block:
            yield block

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Where pretokens begin and end. Long runs of one kind of character are measured by chunks, as a pattern that matches
        millions of characters at once keeps a state for each."""
        at = 0
        while at < len(text):
            m = self.pretoken.match(text, at, min(len(text), at + 2 * SEGMENT))
            end = m.end()
            if end - at == 2 * SEGMENT and end < len(text):
                kind = self.kinds[[bool(k.match(text, end - 1)) for k in self.kinds].index(True)]
                while end < len(text) and (more := kind.match(text, end, min(len(text), end + SEGMENT))):
                    end = more.end()
                if kind is self.kinds[-1] and end < len(text):  # white space leaves its last character to what follows
                    end -= 1
            yield at, end
            at = end

    def encode(self, text: str) -> list[int]:
        return [i for block in self.blocks(text) for _, ids in block for i in ids]


class Decoder:
    """Ids to text: bytes go through an incremental UTF-8 state machine, so a character may span tokens."""

    def __init__(self, merges: Merges):
        self.bytes = merges.bytes

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if text := state.decode(self.bytes.get(i, b"")):
                yield text
        if text := state.decode(b"", True):
            yield text


def digest(encoder: Encoder, text: str, keep: list[int] | None = None) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids joined by commas and of the decoded text, a block of ids at a time.

    keep: a list that the ids are added to.
    """
    count, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
    state = codecs.getincrementaldecoder("utf-8")("replace")
    spell = encoder.merges.bytes.__getitem__
    for block in encoder.blocks(text):
        joined = ",".join([b[0] for b in block])
        ids = list(chain.from_iterable([b[1] for b in block]))
        ids_hash.update(("," + joined if count else joined).encode())
        count += len(ids)
        if keep is not None:
            keep += ids
        text_hash.update(state.decode(b"".join(map(spell, ids))).encode())
    text_hash.update(state.decode(b"", True).encode())
    return count, ids_hash.hexdigest(), text_hash.hexdigest()


def _load(file: str) -> str:
    with open(file, encoding="utf-8") as f:
        return f.read()


_encoders: dict[str, Encoder] = {}


def _encoder(key: str, spec, cache_units: int = CACHE_UNITS) -> Encoder:
    """One encoder for each Python worker and tokenizer, kept between tasks."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec.value, cache_units)
    return _encoders[key]


def _shared(df: DataFrame, file: str) -> tuple:
    """A key and the broadcast content of a tokenizer file (a vocabulary, of fixed size)."""
    content = _load(file)
    return hashlib.sha256(content.encode()).hexdigest(), df.sparkSession.sparkContext.broadcast(content)


def encode(docs: DataFrame, file: str) -> DataFrame:
    """One row for each row of docs: doc_id and ids (array of int; null text: null).

    file: path of a byte-level BPE tokenizer in JSON, read by the driver and broadcast (a vocabulary is of fixed size).
    Empty text has no ids. Only doc_id and text are read; repeated rows and null ids are kept as they are.
    """
    shared = _shared(docs, file)

    def run(batches):
        encoder = _encoder(*shared)
        for batch in batches:
            for part in slices(batch):
                ids = [None if t is None else encoder.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, file: str) -> DataFrame:
    """One row for each row of encoded (doc_id, ids): doc_id and text; null ids give null, unknown ids nothing."""
    shared = _shared(encoded, file)

    def run(batches):
        decoder = Decoder(_encoder(*shared).merges)
        for batch in batches:
            for ids, i in zip(batch.column("ids"), batch.column("doc_id"), strict=True):
                text = None if not ids.is_valid else "".join(decoder.decode(x for x in ids.as_py() if x is not None))
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.int64()), pa.array([text], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def _texts(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def round_trip(docs: DataFrame, file: str) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; null text counts as empty.

    The ids are decoded again from their numbers. Neither ids nor text leave the task.
    """
    shared = _shared(docs, file)

    def run(batches):
        encoder = _encoder(*shared)
        for batch in batches:
            for part in slices(batch):
                found = [digest(encoder, t or "") for t in part.column("text").to_pylist()]
                n, a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenize(docs: DataFrame, file: str, cache_units: int = CACHE_UNITS // 2) -> DataFrame:
    """The rows of docs but for their text: their other columns, n_tokens, ids, and whole (the decoded ids are the text again).

    Null text is empty. Columns of docs that are called as the new ones are replaced. cache_units bounds what a worker keeps; the ids
    themselves take memory here.
    """
    shared = _shared(docs, file)
    new = [("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("whole", pa.bool_())]
    kept = [c for c in docs.columns if c != "text" and c not in dict(new)]

    def run(batches):
        encoder = _encoder(*shared, cache_units)
        for batch in batches:
            for part in slices(batch):
                ids, n, whole = [], [], []
                for t in part.column("text").to_pylist():
                    held: list[int] = []
                    count, _, decoded = digest(encoder, t or "", held)
                    ids.append(held)
                    n.append(count)
                    whole.append(decoded == hashlib.sha256((t or "").encode()).hexdigest())
                made = [pa.array(x, kind) for x, (_, kind) in zip((n, ids, whole), new, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *made], [*kept, *[c for c, _ in new]])

    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("whole", T.BooleanType())])
    return small_batches(docs).select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
