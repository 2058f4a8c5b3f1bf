"""Tree reduction against the library's encoding, on documents, odd strings and every tree shape."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from medloom.llm import queries, treebpe

ATOMS = ["a", "b", "'s", "'", "r", "e", "l", "  ", " ", "\n", "\t", "é", "日", "👩", "1", "!", "_", "\x1c", "́", "aaaa", "abab", "the", "ing", "ſ", "　", "\x85", "\r\n", "000", "'ll", "'re", "<|endoftext|>"]


@pytest.fixture(scope="module")
def coder():
    return treebpe.TreeBpe()


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def ids(coder, text):
    return np.frombuffer(coder.encode(text), "=u4").tolist()


@pytest.mark.parametrize(("leaf", "short"), [(1, 2), (2, 3), (3, 4), (7, 8), (16, 5), (512, 48)])
def test_random_strings_in_small_leaves(coder, library, monkeypatch, leaf, short):
    monkeypatch.setattr(treebpe, "LEAF", leaf)
    monkeypatch.setattr(treebpe, "SHORT", short)
    rng = random.Random(leaf)
    for _ in range(1500):
        text = "".join(rng.choices(ATOMS if rng.random() < 0.7 else ["a", "b", " ", "'", "l", "aaaa"], k=rng.randrange(60)))
        coder.known.clear()
        assert ids(coder, text) == library.encode_ordinary(text), text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=6))
def test_join_is_associative(coder, library, parts):
    left = right = treebpe.Piece("", [], [])
    for p in parts:
        left = coder.join(left, coder.leaf(p))
    for p in reversed(parts):
        right = coder.join(coder.leaf(p), right)
    assert (left.text, left.lengths, left.ids) == (right.text, right.lengths, right.ids)
    assert np.frombuffer(b"".join(left.ids), "=u4").tolist() == library.encode_ordinary("".join(parts))


@settings(max_examples=300, deadline=None)
@given(st.text("abcdefgh", max_size=30), st.text("abcdefgh", max_size=30))
def test_window_join_equals_encoding_whole(coder, a, b):
    assert coder.join_ids(coder.merge(a.encode()), coder.merge(b.encode())).tolist() == coder.merge((a + b).encode())


def test_stable_pairs_are_what_stabilises(coder):
    """Rows of tokens whose neighbours encode to themselves encode to themselves, and only these do."""
    rng = random.Random(5)
    tokens = [coder.ranks[t.encode()] for t in ("a", "aa", "ab", "ba", "b", "the", "th", "he", "e", "in", "ing", "g")]
    seen = set()
    for _ in range(4000):
        row = rng.choices(tokens, k=rng.randrange(2, 6))
        good = all(coder.stable(x, y) for x, y in zip(row, row[1:], strict=False))
        assert good == (coder.merge(coder.decode_bytes(row)) == row)
        seen.add(good)
    assert seen == {True, False}


def test_heap_merges_alike(coder):
    rng = random.Random(3)
    for _ in range(300):
        raw = "".join(rng.choices("abth e'", k=rng.randrange(2, 150))).encode()
        assert coder._merge_long(raw) == coder.merge(raw)


@pytest.mark.parametrize("text", ["a" * 100_001, " " * 50_000 + "x", "ab" * 30_000, "\n" * 30_000 + " x", "日本語" * 20_000, "1 " * 30_000, "'" * 9_999 + "s"])
def test_long_runs(coder, library, text):
    got = ids(coder, text)
    assert got == library.encode_ordinary(text)
    assert coder.decode_bytes(got) == text.encode()


def test_documents_odd_rows_and_round_trip(spark, coder, library, odd_documents):
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in treebpe.encode_digest(odd_documents).collect()}
    texts = [(r.doc_id, r.text or "") for r in odd_documents.collect()]
    want = {(i, len(x := library.encode_ordinary(t)), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts}
    assert rows == want
    back = treebpe.decode(treebpe.encode(odd_documents))
    assert sorted((str(r.doc_id), bytes(r.raw).decode()) for r in back.collect()) == sorted((str(i), t) for i, t in texts)
    assert treebpe.encode_digest(odd_documents.limit(0)).count() == 0
    no_ids = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<long>")
    assert [bytes(r.raw) for r in treebpe.decode(no_ids).collect()] == [b"", b""]


def test_query_equals_library(spark, documents, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op12_tree_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        x = library.encode_ordinary(r.text)
        assert got[r.doc_id] == (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    assert len(got) == documents.count()
