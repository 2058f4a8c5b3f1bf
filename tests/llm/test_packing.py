import zlib

import numpy as np
from tokenizers import Tokenizer

from medloom.llm import packing

TEXTS = ["", "plain words, here.", " a  b \n c\t d ", "x\n\n y", "<|endoftext|> is special <|endoftext|>", "don't WE'LL it's", "naïve façade größe", "日本語 text 🙂 Ελλάδα", "a\u00a0b\u2003c", "12 345 6,7", "\n", " ", "tab\tand\x0bvt", "a\0b c", "ÀÉ õ\u0301x", "it’s “quoted” — dash"]


def reference():
    t = Tokenizer.from_file(packing.TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return t


def test_chunks_are_the_tokenizers_ids(documents):
    lib, own = reference(), packing.ChunkTokenizer(packing.TOKENIZER)
    for text in TEXTS + [r.text for r in documents.limit(80).collect()]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text[:80])
    slow = packing.ChunkTokenizer(packing.TOKENIZER, None)
    assert [slow.encode(t) for t in TEXTS] == [own.encode(t) for t in TEXTS]


def check(rows, docs, width=2048):
    """Every id of every document in one piece; sequences without gaps and not longer than the width."""
    lib = reference()
    want = sorted((d, lib.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in docs)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, ids in want:
        own = [r for r in by_doc[d] if r.doc_tokens == len(ids)]
        for start in range(0, len(ids), width):
            piece = ids[start : start + width]
            assert any(r.start == start and r.length == len(piece) and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes()) for r in own)
    assert sum(r.length for r in rows) == sum(len(i) for _, i in want)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width
    return len(seqs)


def test_pack(documents):
    rows = packing.pack(documents).collect()
    n = check(rows, [(r.doc_id, r.text) for r in documents.collect()])
    assert n * 2048 <= 1.08 * sum(r.length for r in rows) + 2048


def test_odd_rows(odd_documents):
    some = odd_documents.where("doc_id IS NOT NULL")
    check(packing.pack(some).collect(), [(r.doc_id, r.text) for r in some.collect()])
    assert packing.pack(odd_documents.limit(0)).count() == 0


def test_small_width(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "repeat('word ', CAST(id % 37 AS INT)) AS text").repartition(7)
    check(packing.pack(docs, width=16).collect(), [(r.doc_id, r.text) for r in docs.collect()], 16)


def test_patterns():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 20_000):
        lengths, counts = np.unique(rng.integers(1, 257, n), return_counts=True)
        hist = {int(a): int(b) for a, b in zip(lengths, counts, strict=True)}
        found = packing.shortest_pack_first(dict(hist), 256)
        back = {}
        for pattern, count in found:
            assert sum(pattern) <= 256 and count > 0
            for x in pattern:
                back[x] = back.get(x, 0) + count
        assert back == hist
        if n > 1000:
            assert sum(c for _, c in found) * 256 < 1.02 * sum(a * b for a, b in hist.items())
    assert packing.shortest_pack_first({3: 5}, 10) in ([([3, 3, 3], 1), ([3, 3], 1)], [([3, 3, 3], 2)]) or sum(c for _, c in packing.shortest_pack_first({3: 5}, 10)) <= 5
