import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from medloom.llm import bpe

CODER = bpe.Transducer()
LIB = Tokenizer.from_file(bpe.VOCABULARY)
LIB.no_truncation()
LIB.no_padding()
DECODER = bpe.TokenDecoder(CODER.tokens)


def ids(text):
    return np.frombuffer(b"".join(CODER.encode(text)), "<u4").tolist()


def same(text):
    want = LIB.encode(text, add_special_tokens=False).ids
    assert ids(text) == want, repr(text[:60])
    DECODER.reset()
    assert DECODER.feed(want).decode() == LIB.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "Hello wörld's ΣΑΣ ΟΔΟΣ", "<|endoftext|>a<|startoftext|> b", "don't WE'LL 's 'S", "123 4.5", "日本語 🙂👍🏽", "İSTANBUL ẞ ǅ ﬁ ½ ²", "x\x1cy \x1d z", "a\u00a0b\u2028c\u3000d\x85e", "e\u0301 \u0301x", "\ufeffz\u200bq", "a" * 2000, "ab" * 900 + "c", "ÄÖ" * 300, "don't" * 200])
def test_like_the_library(text):
    same(text)


def test_documents(documents):
    for r in documents.limit(120).collect():
        same(r.text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F, exclude_categories=("Cs", "Cn")), max_size=60))
def test_latin(text):
    same(text)


def test_streaming_equals_whole_words():
    rng = random.Random(5)
    for alphabet in ("ab", "thein", "aeiourstln", "é日x"):
        word = "".join(rng.choice(alphabet) for _ in range(3000))
        raw = word.encode()
        symbols = [CODER.single[b] for b in raw]
        symbols[-1] = CODER.last[raw[-1]]
        assert list(CODER.stream(iter(symbols))) == CODER._merge(symbols.copy())


def test_lookahead():
    assert 1 < CODER.lookahead < 1000
    assert bpe.sufficient_lookahead([("a", "b"), ("c", "ab"), ("d", "cab")]) == 4
    assert bpe.sufficient_lookahead([]) == 1


def test_text_decoder_is_incremental():
    text = "grüße 日本 🙂"
    decoder = bpe.TextDecoder(CODER.tokens, CODER.suffix)
    assert "".join(decoder.feed([i]) for i in ids(text)) + decoder.end() == "grüße 日本 🙂 "


def test_query(spark, odd_documents):
    rows = {r.doc_id: r for r in bpe.encode_digest(odd_documents).collect()}
    assert rows[1].n_tokens == rows[2].n_tokens == rows[3].n_tokens == 0 and rows[1].ids_sha256 == hashlib.sha256().hexdigest()
    want = LIB.encode("one two", add_special_tokens=False).ids
    assert rows[4].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert rows[4].decoded_sha256 == hashlib.sha256(LIB.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_digest(odd_documents.limit(0)).count() == 0
    assert bpe.encode(odd_documents.where("doc_id = 4")).first().ids == want


def test_bounded_reads(monkeypatch):
    monkeypatch.setattr(bpe, "READ", 7)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "PIECE", 5)
    same("some words of which none is remembered for long\nand another line")
    same(" averyveryverylongword  withblanks around\nthem ")


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'sltrevmdé\u0301\u0327Σσ1٣!?-日\x1c\u00a0\u1100\u1161\u11a8"), max_size=60), st.integers(1, 9))
def test_slices_change_nothing(text, read):
    want = LIB.encode(text, add_special_tokens=False).ids
    kept = bpe.READ, bpe.PIECE
    bpe.READ, bpe.PIECE = read, 3
    try:
        assert ids(text) == want
    finally:
        bpe.READ, bpe.PIECE = kept


def test_memory_does_not_grow_with_a_word():
    def peak(n):
        text = "".join(random.Random(n).choices("abcdefghijklmnopqrstuvwxyz", k=n))
        tracemalloc.start()
        count = sum(len(piece) // 4 for piece in CODER.encode(text))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, count

    peak(50_000)
    (small, a), (large, b) = peak(300_000), peak(1_200_000)
    assert b > 3 * a and large <= 1.2 * small


def test_decode(spark, documents):
    rows = bpe.encode(documents.limit(20))
    texts = {r.doc_id: r.text for r in documents.limit(20).collect()}
    for r in bpe.decode(rows).collect():
        assert "".join(r.text.split()) == "".join((texts[r.doc_id] or "").lower().split())
