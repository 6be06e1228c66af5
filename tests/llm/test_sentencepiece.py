"""Encoding, spans and decoding equal those of the library, for the given model and for models with a compiled character map."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tallyloom.llm.queries import PIECES, op13_sentencepiece, tokenizer_file
from tallyloom.llm.sentencepiece import Model, decode, encode, round_trip

PARTS = [" ", "  ", "▁", "\n", "\t", "a", "the", "é", "日", "本", "\U0001f600", "\x00", "<s>", "</s>", "<unk>", "<0x41>", "́", "�", "⁇", "1", "\r", "　", "​", "﻿", "ﬁ", "㍿", "x" * 60, "Ｈｅllo", "①"]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["", " ", "  ", "▁", " a", "a ", "日", "ab" * 3000, " " * 300, "日本語" * 500] + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(key, value):
    """A field of a serialised message."""
    return number(key << 3) + number(value) if isinstance(value, int) else number(key << 3 | 2) + number(len(value)) + value


def model_with(map_blob=b"", dummy=1, squeeze=1, fallback=True):
    """A small model: pieces of the given vocabulary under another normaliser."""
    given = Model(open(public_tokenizers.path(PIECES), "rb").read())
    pieces = [p for p in given.rank if given.rank[p][1] < 3000]
    pieces += sorted({c for p in pieces for c in p} - set(pieces))
    out = b""
    for i, (p, kind) in enumerate([("<unk>", 2), ("<s>", 3), ("</s>", 3), *[(f"<0x{b:02X}>", 6) for b in range(256 * fallback)], *[(p, 1) for p in pieces]]):
        out += field(1, field(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", -i if kind == 1 else 0) + field(3, kind))
    out += field(2, field(3, 2) + field(35, int(fallback)) + field(40, 0) + field(41, 1) + field(42, 2))
    return out + field(3, field(1, b"own") + (field(2, map_blob) if map_blob else b"") + field(3, dummy) + field(4, squeeze) + field(5, 1))


def compiled_map(rule):
    from tallyloom.llm.sentencepiece import fields

    content = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    return dict(fields(dict(fields(content))[3]))[2]


def check(content, texts):
    own, library = Model(content, 500), sentencepiece.SentencePieceProcessor(model_proto=content)
    own.learned(texts[: len(texts) // 2])  # words of the first half are merged together, the others one by one
    for t in texts:
        ids, begin, end = own.encode(t)
        assert ids == library.encode(t), t
        assert own.decode(ids) == own.decoded(ids) == library.decode(ids), t
        data = t.encode()
        told = library.encode(t, return_type="proto").pieces
        assert [data[a:b].decode() for a, b in zip(begin, end, strict=True)] == [p.surface for p in told], t


def test_given_model():
    check(open(public_tokenizers.path(PIECES), "rb").read(), odd_texts(2000) + ["".join(chr(c) for c in range(b, b + 500) if not 0xD800 <= c < 0xE000) for b in range(0, 0x11000, 500)])


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf"])
@pytest.mark.parametrize("dummy, squeeze", [(1, 1), (1, 0), (0, 1), (0, 0)])
def test_compiled_maps(rule, dummy, squeeze):
    check(model_with(compiled_map(rule), dummy, squeeze), odd_texts(400))


def test_without_byte_fallback():
    check(model_with(fallback=False), odd_texts(400))
    check(model_with(compiled_map("nfkc"), fallback=False), odd_texts(400))


def test_any_ids_decode_as_the_library_does():
    path, rng = public_tokenizers.path(PIECES), random.Random(5)
    own, library = Model(open(path, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=path)
    for _ in range(2000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randrange(1, 12))]
        assert own.decode(ids) == library.decode(ids)


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        Model(model_with() + field(5, field(2, b"xxxx")))
    with pytest.raises(ValueError):
        Model(model_with() + field(1, field(1, b"own") + field(3, 4)))


def test_query_equals_the_library(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    found = op13_sentencepiece(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_odd_rows(spark, odd, nothing):
    file = tokenizer_file(PIECES)
    rows = encode(odd, file).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].ids is None and by_id[2].ids == [] and len(by_id[4].ids) == len(by_id[4].begins) > 30_000
    back = {r.doc_id: r.text for r in decode(encode(odd, file), file).collect()}
    for r in odd.collect():
        assert back[r.doc_id] == r.text
    assert round_trip(odd, file).where("doc_id = 3").first().n_tokens == 0
    assert round_trip(nothing, file).count() == encode(nothing, file).count() == decode(encode(nothing, file), file).count() == 0
    assert decode(spark.createDataFrame([(1, [0, 400, 99999, -1])], "doc_id long, ids array<int>"), file).first().text is not None
    assert encode(odd.withColumn("text", F.lit(None).cast("string")), file).where("ids is not null").count() == 0
