import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import bpe
from tallyloom.llm.queries import tokenizer_file

tokenizers = pytest.importorskip("tokenizers")
FILE = tokenizer_file()
ENCODER = bpe.Encoder(bpe._load(FILE))
LIBRARY = tokenizers.Tokenizer.from_file(FILE)


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    decoded = LIBRARY.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_documents_as_the_library(documents):
    out = {r["doc_id"]: r for r in bpe.round_trip(documents, FILE).collect()}
    for r in documents.collect():
        assert tuple(out[r["doc_id"]])[1:] == expected(r["text"])


def test_odd_rows(odd, nothing):
    texts = [r["text"] for r in odd.collect()]
    out = bpe.round_trip(odd, FILE).collect()
    assert sorted(map(str, ((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out))) == sorted(map(str, map(expected, texts)))
    assert bpe.round_trip(nothing, FILE).count() == 0


def test_ids_decode_to_the_texts(odd):
    encoded = bpe.encode(odd, FILE)
    texts = sorted(str(r["text"]) for r in odd.collect())
    assert sorted(str(r["text"]) for r in bpe.decode(encoded, FILE).collect()) == texts


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "'s", "'LL", "a", "The", "é", "ß", "漢", "😀", "12", "!", "...", "<|endoftext|>", "\r\n", "İ", "​", "१"]), max_size=30))
def test_any_text(parts):
    text = "".join(parts)
    assert bpe.digest(ENCODER, text) == expected(text)


def test_long_pretokens_are_streamed_in_windows():
    random.seed(1)
    words = [t.decode() for t in ENCODER.merges.ids if t.isalpha()]
    for text in ("".join(random.choice(words) for _ in range(3000)), "a" * 20_000, "ab" * 8_000, "-" * 9_000, "é" * 6_000):
        assert bpe.digest(ENCODER, text) == expected(text)


def test_texts_without_spaces_are_taken_piece_by_piece(monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 40)
    random.seed(2)
    encoder = bpe.Encoder(bpe._load(FILE))
    parts = ["漢字" * 30, "a" * 500, "x-y", " ", "  ", "\n\n", "12345678901234567890" * 9, "-" * 300, " " * 400, "\t" * 90, "'s", "é" * 100, "<|endoftext|>", "don't", "z" * 79, "z" * 80, "z" * 81, " " * 80, " " * 81]
    for _ in range(200):
        text = "".join(random.choice(parts) for _ in range(random.randint(1, 6)))
        assert bpe.digest(encoder, text) == expected(text), text


def test_memory_does_not_grow_with_a_text_without_spaces(monkeypatch):
    """Peak of what one long text takes besides itself, for kinds of text that have no cut anywhere."""
    import tracemalloc

    monkeypatch.setattr(bpe, "SEGMENT", 1 << 11)
    encoder = bpe.Encoder(bpe._load(FILE), cache_units=1000)
    for unit in ("x9,漢", "q", "漢字"):
        text = unit * (150_000 // len(unit))
        tracemalloc.start()
        count = sum(len(ids) for block in encoder.blocks(text) for _, ids in block)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert count > 5_000 and peak < 2 << 20, (unit, count, peak)


def test_other_tokenizers_are_refused():
    import json

    spec = json.loads(bpe._load(FILE))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {**spec["model"], "byte_fallback": True}}, {"added_tokens": [{**spec["added_tokens"][0], "lstrip": True}]}):
        with pytest.raises(ValueError, match="plain byte-level"):
            bpe.Encoder(json.dumps({**spec, **change}))


def test_decoder_spans_tokens():
    ids = ENCODER.encode("漢😀")
    assert len(ids) > 2
    assert "".join(bpe.Decoder(ENCODER.merges).decode(ids)) == "漢😀"
    assert "".join(bpe.Decoder(ENCODER.merges).decode(ids[:1])) == "�"


def test_lookahead_is_bounded_and_small():
    assert 1 < ENCODER.merges.lookahead < 2000
