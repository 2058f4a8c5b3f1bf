"""Alignment by segments against the alignment of whole texts, token by token."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from medloom.llm import align, queries

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def both():
    return align.Tokenizers()


def slow(both, rows):
    """Whole texts: all pairs of overlapping spans, groups cut where both have an end."""
    found, count = [], Counter()
    for i, text in rows:
        text = text or ""
        a = both.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        want = (" " + text).encode()
        if not text or b"".join(both.a_bytes[x] for x in a) != want or b"".join(both.b_bytes[x] for x in b) != want:
            found.append((i, [], [], [], ""))
            continue
        spans = []
        for ids, raw in ((a, both.a_bytes), (b, both.b_bytes)):
            at, out = 0, []
            for x in ids:
                out.append((at, at + len(raw[x]), x))
                at = out[-1][1]
            spans.append(out)
        # a token's partners lie side by side
        links = [(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if s < f and t < e]
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = ";".join("|".join(",".join(str(x) for s, e, x in side if low <= s and e <= high) for side in spans) for low, high in zip([0, *cuts], cuts, strict=False))
        count.update(links)
        found.append((i, a, b, links, groups))
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted(
        (str(i), len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for i, a, b, links, groups in found
    )


def fast(frame):
    return sorted((str(r.doc_id), *r[1:]) for r in frame.select(*COLUMNS).collect())


def test_vocabularies_never_merge_across_cuts(both):
    assert both.joined == ()
    assert align._last_character("aé".encode()) == "é".encode() and align._last_character(b"\xa9") == b"\xa9"
    with pytest.raises(ValueError):
        align.Tokenizers(align.public_tokenizers.path("word_bpe_49k.json"))


def test_segments_give_the_tokens_of_the_whole(both):
    rng = random.Random(1)
    atoms = ["a", "b", " ", "  ", "\n", "\t", "é", "日本", "👩", "1", "'s", "the", "ing", "\x1c", "\x85", "　", "▁", "<s>", "</s>", "<|endoftext|>", "<0x41>", "\0", "́", "ﬁ", "\xa0", "\x7f", "٣", "ﷺ"]
    for _ in range(6000):
        text = "".join(rng.choices(atoms, k=rng.randrange(1, 30)))
        parts = both.segments(text)
        assert "".join(parts) == " " + text
        a, b = zip(*map(both.tokens, parts), strict=True)
        assert sum(a, []) == both.a.encode(" " + text, add_special_tokens=False).ids, text
        if "▁" not in text:
            assert sum(b, []) == both.b.encode(text), text


def test_a_vocabulary_that_could_merge_across_joins_segments(both):
    both.joined = (b"b",)
    try:
        assert both.segments("ab ab c  d") == [" ab ab c", "  d"]
        assert both.segments("x y b") == [" x", " y", " b"]
    finally:
        both.joined = ()
    assert both.segments("ab ab c  d ") == [" ab", " ab", " c", "  d "]


def whole(both, text):
    """The walk over a text as one segment: groups and links."""
    ((_, (groups,), _, _, links),) = both.aligned([" " + text])
    return groups, [(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in links]


def test_walk_equals_all_pairs(both):
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choices(["a", "ing", " ", "é", "日", "tion", "7", "\n", "ous"], k=rng.randrange(1, 12)))
        (row,) = slow(both, [(1, text)])
        groups, links = whole(both, text)
        assert (groups.count(";") + 1, len(links), hashlib.sha256(groups.encode()).hexdigest()) == (row[3], row[4], row[7])


def test_runs_of_segments_equal_single_ones(both):
    """Also with segments among them that tokens do not spell, or that end in white space."""
    rng = random.Random(4)
    for _ in range(200):
        segments = [" " + "".join(rng.choices(["a", "ing", "é", "日", "tion", "7", "\n", "ous", "▁", " "], [5, 5, 5, 5, 5, 5, 2, 5, 0.2, 0.5], k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 30))]
        single, together = ([x for part in parts for x in both.aligned(part)] for parts in ([[s] for s in segments], [segments]))
        for k in (1, 2, 3, 4):
            assert [v for x in single for v in x[k]] == [v for x in together for v in x[k]]


def test_odd_rows(spark, both, odd_documents, monkeypatch):
    """Nulls, blank and long texts, repeated rows, texts that tokens do not spell (their uses do not count)."""
    more = [(20, "one ▁two three"), (21, "▁"), (22, "one two <s> three"), (23, "one  two \n three "), (24, " one"), (25, "ends "), (26, "a\0b \x1c c"), (27, "three ▁"), (28, "one"), (29, " ")]
    frame = odd_documents.where(F.col("doc_id").isNull() | (F.col("doc_id") < 6)).select("doc_id", "text", F.lit(1).alias("block"), F.lit("x").alias("n"))
    frame = frame.unionByName(spark.createDataFrame([(*r, 1, "x") for r in more], "doc_id long, text string, block int, n string"))
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    want = slow(both, rows)
    assert fast(align.align(frame)) == want
    zeros = {i for i, n, *_ in want if not n}
    assert zeros == {"1", "2", "20", "21", "27"}


def test_blocks_and_pair_joins_do_not_matter(spark, both, documents, monkeypatch):
    some = documents.where("doc_id < 60").unionByName(documents.where("doc_id < 3").withColumn("text", F.concat("text", F.lit(" ▁ "), "text")))
    want = slow(both, [(r.doc_id, r.text) for r in some.where(F.length("text") < 4000).collect()])
    some = some.where(F.length("text") < 4000).coalesce(1)
    assert fast(align.align(some)) == want
    monkeypatch.setattr(align, "PAIRS", 0)
    assert fast(align.align(some.repartition(5))) == want


def test_empty_table(spark, documents):
    assert align.align(documents.limit(0)).count() == 0
    assert fast(align.align(documents.limit(1).withColumn("text", F.lit(None).cast("string"))))[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_one_segment_in_a_third_of_all_rows(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same words here")).otherwise(F.concat(F.lit("word "), F.col("id").cast("string"))).alias("text"))
    found = align.align(rows)
    assert found.where("doc_id % 3 = 0").select(*COLUMNS[1:]).distinct().count() == 1
    assert found.count() == 3000


def test_query(spark, both, documents):
    """The whole smallest table."""
    got = fast(queries.op11_token_alignment(spark, "/root/testdata/sf0.001"))
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    assert len(got) == len(texts)
    # pairs of whole texts are slow: the walk takes their place, compared with all pairs above
    count, found = Counter(), []
    for i, text in texts:
        a, b = both.tokens(" " + text)
        groups, links = whole(both, text)
        count.update(links)
        found.append((i, a, b, groups, links))
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    assert got == sorted((str(i), len(a), len(b), groups.count(";") + 1, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(groups.encode()).hexdigest()) for i, a, b, groups, links in found)
