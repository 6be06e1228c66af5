"""SentencePiece encoding and decoding of BPE models with byte fallback, with the source span of every piece.

A text is normalised by the longest prefix that the model's compiled character map holds at each place (a double-array trie over UTF-8
bytes and a block of replacements). For every byte of the normalised text the byte of the source that it came from is recorded, so a
piece, which is a run of normalised bytes, projects to a span of source bytes, whatever was replaced, dropped or put in. Pieces are
merged by score, best first, the leftmost of equals. Where no piece of the vocabulary holds a space sign after another character, no
merge crosses the beginning of a word: then words are encoded one by one, and short ones kept; so are characters in no longer piece. Decoding undoes the space signs and
puts byte pieces together to characters.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import slices, small_batches

SPACE = "▁"
#: Entries of each half of the cache from word to encoding, and the longest word (characters) kept.
CACHE_WORDS = 300_000
CACHE_CHARS = 40
#: Words that are put together before they are hashed.
BLOCK_WORDS = 1 << 14
#: Characters from which on a word is merged over a heap.
LONG_WORD = 48
#: Characters of a text up to which its words are held in a list; new words from which on they are merged together.
TEXT_CHARS = 1 << 20
FEW_WORDS = 64
#: Cost of a pair that makes no piece.
NEVER = float("inf")
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a serialised message: integers as such, anything else as bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
            yield key >> 3, value
            continue
        size, at = {1: (8, at), 5: (4, at)}.get(key & 7) or number(at)
        yield key >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """The compiled map: longest prefix of UTF-8 bytes to its replacement."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :]

    @staticmethod
    def _below(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes taken from `at` and what stands for them, or None where no prefix is in the map."""
        units, found = self.units, None
        if not units:
            return None
        node = self._below(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._below(unit)
            if unit & 0x100:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.replacements[found[1] : self.replacements.index(b"\0", found[1])]


class Pairs:
    """Which two symbols make which, as arrays, and the merging of many words at once.

    Symbols are the pieces of a vocabulary and the single characters in them, by number. Costs are numbered by their order.
    """

    def __init__(self, rank: dict[str, tuple[float, int]]):
        symbols = sorted({*rank, *(c for p in rank for c in p)})
        number = {s: i for i, s in enumerate(symbols)}
        self.count = len(symbols)
        costs = {c: i for i, c in enumerate(sorted({cost for cost, _ in rank.values()}))}
        made = [(number[p[:i]] * self.count + number[p[i:]], costs[cost], number[p]) for p, (cost, _) in rank.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        table = np.array(sorted(made) or [(-1, 0, 0)], np.int64)
        self.keys, self.costs, self.made = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()
        self.never = len(costs)
        #: by code point: the character's symbol, or -1
        self.of = np.full(0x110000, -1, np.int64)
        for s in symbols:
            if len(s) == 1:
                self.of[ord(s)] = number[s]
        #: by symbol: id of its piece, or -1
        self.piece = np.array([rank[s][1] if s in rank else -1 for s in symbols], np.int64)

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and symbol of each pair."""
        key = left * self.count + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.costs[at], self.never), self.made[at]

    def merged(self, words: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Of words whose merging ended in pieces only: their places in the list; ids of all, and how many each has.

        In each round the cheapest pair of every word is merged, the leftmost of equals; only pairs beside it are looked up again.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        symbol = self.of[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        known = np.ones(len(words), bool)
        known[word[symbol < 0]] = False
        keep = known[word]
        symbol, word = symbol[keep], word[keep]
        cost, made = np.full(len(symbol), self.never), np.zeros(len(symbol), np.int64)  # of the pair that begins here
        inner = np.flatnonzero(word[1:] == word[:-1])
        cost[inner], made[inner] = self.looked_up(symbol[inner], symbol[inner + 1])
        while len(symbol):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(cost, first)
            going = least < self.never
            size = np.diff(np.append(first, len(word)))
            if not going.all():
                ended = np.repeat(~going, size)
                done.append((word[ended], symbol[ended]))
                symbol, word, cost, made = (x[~ended] for x in (symbol, word, cost, made))
                least, size = least[going], size[going]
            if not len(symbol):
                break
            at = np.flatnonzero(cost == np.repeat(least, size))
            at = at[np.append(True, word[at[1:]] != word[at[:-1]])]  # the leftmost of each word
            symbol[at] = made[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, word, cost, made = (x[keep] for x in (symbol, word, cost, made))
            at -= np.arange(len(at))
            changed = np.concatenate((at[at > 0] - 1, at))
            inner = changed[(changed + 1 < len(word)) & (word[np.minimum(changed + 1, len(word) - 1)] == word[changed])]
            cost[changed] = self.never
            cost[inner], made[inner] = self.looked_up(symbol[inner], symbol[inner + 1])
        if not done:
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        word, ids = word[order], self.piece[symbol[order]]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        whole = np.minimum.reduceat(ids, first) >= 0
        size = np.diff(np.append(first, len(word)))
        return word[first][whole].tolist(), ids[np.repeat(whole, size)], size[whole]


class Model:
    """What a model file says, and its encoder and decoder. Unigram models, user-defined or unused pieces and denormalisers are refused."""

    def __init__(self, content: bytes, cache_words: int = CACHE_WORDS):
        pieces, trainer, normaliser = [], {}, {}
        for number, value in fields(content):
            if number == 1:
                piece = dict(fields(value))
                pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0" * 4))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
            elif number == 5 and dict(fields(value)).get(2):
                raise ValueError("models with a denormaliser are not supported")
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or any(kind in (USER_DEFINED, UNUSED) for _, _, kind in pieces):
            raise ValueError("only BPE models without user-defined or unused pieces are supported")
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
        self.surface = trainer.get(44, " ⁇ ".encode()).decode()
        self.map = CharacterMap(normaliser.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        #: by piece: what sorts it (best first) and its id
        self.rank = {p: (-score, i) for i, (p, score, kind) in enumerate(pieces) if kind == NORMAL}
        self.cost = {p: cost for p, (cost, _) in self.rank.items()}
        self.ids = {p: i for p, (_, i) in self.rank.items()}
        self.pairs = Pairs(self.rank)
        self.decimal = list(map(str, range(len(pieces))))
        self.bytes = [-1] * 256
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(p[1:-1], 16)] = i
        #: by id: its byte, or -1
        self.byte = np.full(len(pieces), -1, np.int64)
        self.byte[[i for i in self.bytes if i >= 0]] = [b for b, i in enumerate(self.bytes) if i >= 0]
        self.fallback = bool(trainer.get(35, 0)) and min(self.bytes) >= 0
        self.kind = [p[2] for p in pieces]
        self.piece = [p[0] for p in pieces]
        #: bytes that a piece stands for in a text, with spaces for space signs
        self.spelled = [bytes([int(p[1:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else self.surface.encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, kind in pieces]
        #: bytes of the normalised text that a piece covers
        self.width = np.array([1 if kind == BYTE else len(p.encode()) for p, _, kind in pieces], np.int64)
        apart = not any(SPACE in p.lstrip(SPACE) for p in self.rank)
        # a character that is in no longer piece is a word of its own
        joint = "".join(map(re.escape, sorted({c for p in self.rank if len(p) > 1 for c in p} - {SPACE})))
        self.words = re.compile(f"{SPACE}+[{joint}]*|[{joint}]+|[^{joint}{SPACE}]" if apart and joint else "(?s:.+)")
        #: encodings of words: those met since the last change, and those met before it
        self.cache: dict[str, tuple[str, tuple[int, ...], list[int] | None]] = {}
        self.before: dict[str, tuple[str, tuple[int, ...], list[int] | None]] = {}
        self.cache_words = cache_words

    # normalising

    def plain(self) -> bool:
        """Nothing is replaced but spaces."""
        return not self.map.units and self.escape and not self.squeeze

    def normalised(self, text: str) -> str:
        if not text:
            return ""
        return (SPACE if self.dummy else "") + text.replace(" ", SPACE) if self.plain() else self.aligned(text)[0]

    def aligned(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the place in the source's bytes of each of its bytes and of its end."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if self.plain():
            widths = np.where(np.frombuffer(data, np.uint8) == 32, len(SPACE.encode()), 1)
            places = np.concatenate((np.zeros(3 * self.dummy, np.int64), np.repeat(np.arange(len(data)), widths), [len(data)]))
            return self.normalised(text), places
        sign = SPACE.encode() if self.escape else b" "
        steps, at, seen = [], 0, {}
        while at < len(data):  # (bytes taken, what stands for them)
            size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            steps.append(self.map.longest(data, at) or seen.setdefault(data[at : at + size], (size, data[at : at + size])))
            at += steps[-1][0]
        first = at = 0
        if self.squeeze:
            while first < len(steps) and steps[first][1] == b" ":
                at += steps[first][0]
                first += 1
        if first == len(steps):
            return "", np.array([at])
        out, places = bytearray(), []

        def put(what: bytes, place: int) -> None:
            what = what.replace(b" ", sign)
            out.extend(what)
            places.extend([place] * len(what))

        if self.dummy:
            put(b" ", at)
        after_space = self.squeeze
        for size, what in steps[first:]:
            while after_space and what.startswith(b" "):
                what = what[1:]
            if what:
                put(what, at)
                after_space = self.squeeze and what.endswith(b" ")
            at += size
        if self.squeeze:
            while out.endswith(sign):
                at = places[len(out) - len(sign)]
                del out[-len(sign) :], places[-len(sign) :]
        return out.decode(), np.array([*places, at])

    # encoding

    def merged(self, word: str) -> list[str]:
        """The pieces of a word: pairs are merged best first, the leftmost of equals first."""
        rank, parts = self.rank, list(word)
        if len(parts) < LONG_WORD:
            cost = self.cost.get
            costs = list(map(cost, map(add, parts, parts[1:]), repeat(NEVER)))
            while costs and (best := min(costs)) != NEVER:
                at = costs.index(best)
                parts[at] += parts.pop(at + 1)
                del costs[at]
                if at:
                    costs[at - 1] = cost(parts[at - 1] + parts[at], NEVER)
                if at < len(costs):
                    costs[at] = cost(parts[at] + parts[at + 1], NEVER)
            return parts
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(found[0], i, i + 1, parts[i] + parts[i + 1]) for i in range(n - 1) if (found := rank.get(parts[i] + parts[i + 1]))]
        heapify(heap)
        while heap:
            _, left, right, made = heappop(heap)
            if after[left] != right or not parts[right] or len(parts[left]) + len(parts[right]) != len(made) or not parts[left]:
                continue
            parts[left], parts[right] = made, ""
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            for a, b in ((before[left], left), (left, after[left])):
                if a >= 0 and b >= 0 and (found := rank.get(parts[a] + parts[b])):
                    heappush(heap, (found[0], a, b, parts[a] + parts[b]))
        return [p for p in parts if p]

    def word(self, word: str) -> tuple[str, tuple[int, ...], list[int] | None]:
        """The word's ids joined by commas, the ids, and the bytes that each covers where the vocabulary does not say so."""
        kept = self.before.get(word)
        if kept is None:
            pieces, widths = self.merged(word), None
            ids = list(map(self.ids.get, pieces))
            if None in ids:
                ids, widths = self._unknown(pieces)
            kept = ",".join(map(self.decimal.__getitem__, ids)), tuple(ids), widths
        if len(word) <= CACHE_CHARS:
            if len(self.cache) >= self.cache_words:
                self.before, self.cache = self.cache, {}
            self.cache[word] = kept
        return kept

    def learned(self, texts: list[str]) -> list[list[str] | None]:
        """Words of each text once normalised, None for long ones; those that are new are merged together and kept."""
        listed = [self.words.findall(self.normalised(t)) if len(t) <= TEXT_CHARS else None for t in texts]
        held, before = self.cache, self.before
        new = [w for w in {w for words in listed if words for w in words if w not in held} if len(w) <= CACHE_CHARS and w not in before]
        if len(new) >= FEW_WORDS:
            which, ids, sizes = self.pairs.merged(new)
            if len(held) + len(which) > self.cache_words:
                self.before, self.cache = held, {}
            ids, cache, decimal, at = ids.tolist(), self.cache, self.decimal.__getitem__, 0
            for i, size in zip(which, sizes.tolist(), strict=True):
                own = tuple(ids[at : at + size])  # what holds no containers is nothing for the garbage collector
                cache[new[i]] = (",".join(map(decimal, own)), own, None)
                at += size
        return listed

    def _unknown(self, pieces: list[str]) -> tuple[list[int], list[int] | None]:
        """Ids of pieces some of which are not in the vocabulary; without byte fallback also the bytes that each covers."""
        if self.fallback:
            return [i for p in pieces for i in ([self.ids[p]] if p in self.ids else map(self.bytes.__getitem__, p.encode()))], None
        return [self.ids.get(p, self.unknown) for p in pieces], [len(p.encode()) for p in pieces]

    def blocks(self, normalised: str, words: list[str] | None = None) -> Iterator[list[tuple[str, tuple[int, ...], list[int] | None]]]:
        """The words of a normalised text, a block at a time; words: these words, where they are known."""
        words = iter(words) if words is not None else map(re.Match.group, self.words.finditer(normalised))
        while True:
            get, make = self.cache.get, self.word
            block = [get(w) or make(w) for w in islice(words, BLOCK_WORDS)]
            if not block:
                return
            yield block

    def pieces(self, text: str, words: list[str] | None = None) -> tuple[list[str], list[int], np.ndarray, np.ndarray]:
        """Ids of each word joined by commas, all ids, and where in the source's bytes each begins and ends."""
        normalised, places = self.aligned(text)
        joined: list[str] = []
        ids: list[int] = []
        other: list[tuple[int, list[int]]] = []  # bytes of the pieces of words with unknown ones
        for block in self.blocks(normalised, words):
            joined += [b[0] for b in block]
            if self.fallback:
                ids += chain.from_iterable([b[1] for b in block])
                continue
            for _, new, widths in block:
                if widths is not None:
                    other.append((len(ids), widths))
                ids += new
        at = np.array(ids, np.int64)
        wide = self.width[at]
        for first, widths in other:
            wide[first : first + len(widths)] = widths
        ends = np.cumsum(wide)
        return joined, ids, *self._characters(at, places[ends - wide], places[ends])

    def _characters(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the byte pieces of one character, the last gets the character's span and the others an empty one at its beginning."""
        at = np.flatnonzero(self.byte[ids] >= 0) if self.fallback else ids[:0]
        if len(at):
            byte = self.byte[ids[at]]
            lead = np.maximum.accumulate(np.where((byte < 0x80) | (byte >= 0xC0), np.arange(len(at)), 0))
            size = np.select([byte[lead] < 0x80, byte[lead] < 0xE0, byte[lead] < 0xF0], [1, 2, 3], 4)
            begin[at] = begin[at[lead]]
            end[at] = np.where(np.arange(len(at)) - lead == size - 1, end[at], begin[at])
        return begin, end

    def encode(self, text: str, words: list[str] | None = None) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids of a text, and where in its bytes each begins and ends.

        Of the bytes that one character falls back to, the last has the character's span and the others an empty one at its beginning.
        """
        _, ids, begin, end = self.pieces(text, words)
        return (ids, begin, end) if self.fallback else self._joined(ids, begin, end)

    def _joined(self, ids: list[int], begin: np.ndarray, end: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Unknown pieces in a row are one."""
        at = np.array(ids, np.int64)
        again = np.flatnonzero((at[1:] == self.unknown) & (at[:-1] == self.unknown)) + 1 if len(at) else np.zeros(0, np.int64)
        keep = np.ones(len(at), bool)
        keep[again] = False
        last = np.append(np.flatnonzero(keep)[1:], len(at)) - 1 if len(at) else np.zeros(0, np.int64)
        return at[keep].tolist(), begin[keep], end[last]

    # decoding

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids. Runs of byte pieces are read as UTF-8, each byte that is part of no character as U+FFFD."""
        strip = self.dummy or self.squeeze
        out: list[str] = []
        run = bytearray()
        start = True  # a space sign at the beginning is still to be dropped

        def flush() -> None:
            at = 0
            while at < len(run):
                size = 1 if run[at] < 0x80 else 2 if run[at] < 0xE0 else 3 if run[at] < 0xF0 else 4
                try:
                    out.append(run[at : at + size].decode())
                    at += size
                except UnicodeDecodeError:
                    out.append("�")
                    at += 1
            run.clear()

        seen = False
        for i in ids:
            kind = self.kind[i]
            if kind == BYTE:
                run += self.spelled[i]
                continue
            flush()
            if seen or any(out):
                start = False
            seen = False
            text = self.spelled[i].decode()
            if kind == NORMAL and start and strip and self.piece[i].startswith(SPACE):
                text, seen = text[1:], not self.squeeze
            out.append(text)
        flush()
        return "".join(out)

    def decoded(self, ids: list[int]) -> str:
        """As decode(): where the bytes of all pieces in a row are characters throughout, they are the text but for the first space."""
        if self.squeeze or not self.dummy or not ids or self.kind[ids[0]] != NORMAL:
            return self.decode(ids)
        try:
            text = b"".join(map(self.spelled.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            return self.decode(ids)
        return text[1:] if self.piece[ids[0]].startswith(SPACE) else text

    def digest(self, text: str, words: list[str] | None = None) -> tuple[int, str, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, of the text decoded from them, and of the spans (begin:end, by commas)."""
        said, ids, begin, end = self.pieces(text, words)
        if not self.fallback:
            ids, begin, end = self._joined(ids, begin, end)
            said = map(str, ids)
        joined = ",".join(said)
        spans = np.stack((begin, end), 1).astype("<i8").tobytes()
        hashed = [hashlib.sha256(x).hexdigest() for x in (joined.encode(), self.decoded(ids).encode(), spans)]
        return len(ids), *hashed


_models: dict[str, Model] = {}


def _model(key: str, spec) -> Model:
    """One model for each Python worker, kept between tasks."""
    if key not in _models:
        _models.clear()
        _models[key] = Model(spec.value)
    return _models[key]


def _shared(df: DataFrame, file: str) -> tuple:
    """A key and the broadcast content of a model file (a vocabulary, of fixed size)."""
    with open(file, "rb") as f:
        content = f.read()
    Model(content)  # settings that are not supported are told by the driver
    return hashlib.sha256(content).hexdigest(), df.sparkSession.sparkContext.broadcast(content)


def _texts(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, file: str) -> DataFrame:
    """One row for each row of docs: doc_id, ids, and begins and ends of each id in the UTF-8 bytes of the text.

    file: path of a model file, read by the driver and broadcast. A null text has null arrays, an empty one empty arrays. Only doc_id and
    text are read; repeated rows and null ids are kept as they are.
    """
    shared = _shared(docs, file)
    kinds = [("ids", pa.int32()), ("begins", pa.int64()), ("ends", pa.int64())]

    def run(batches):
        model = _model(*shared)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                rows = [(None,) * 3 if t is None else model.encode(t, w) for t, w in zip(texts, model.learned([t or "" for t in texts]), strict=True)]
                made = [pa.array(x, pa.list_(kind)) for x, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], ["doc_id", *[c for c, _ in kinds]])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, begins array<long>, ends array<long>")


def decode(encoded: DataFrame, file: str) -> DataFrame:
    """One row for each row of encoded (doc_id, ids): doc_id and text; null ids give null, ids that the model lacks nothing."""
    shared = _shared(encoded, file)

    def run(batches):
        model = _model(*shared)
        known = range(len(model.piece))
        for batch in batches:
            texts = [None if ids is None else model.decode([i for i in ids if i in known]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return small_batches(encoded).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, file: str) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256; null text counts as empty.

    spans_sha256 is over begin and end of every id as little-endian 64-bit numbers. Neither ids nor texts leave the task.
    """
    shared = _shared(docs, file)

    def run(batches):
        model = _model(*shared)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                n, a, b, c = zip(*[model.digest(t, w) for t, w in zip(texts, model.learned(texts), strict=True)], strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(c)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
