import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from medloom.llm import simhash


def brute_fingerprint(text, k=3):
    words = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r " else " " for c in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, budget=3):
    """(id, fingerprint) pairs to the least id in reach."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= budget:
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(rows))]


@pytest.mark.parametrize("text", [None, "", "  ", "a", "A b", "x\x1cy z", "é È ß\x0bé", "the cat sat on the cat sat on the mat " * 300])
def test_fingerprint(text):
    assert int.from_bytes(simhash.fingerprint(text)) == brute_fingerprint(text)


def test_hash_is_sparks(spark):
    got = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest("a b c", simhash.SEED)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("near", [0, 2, 5])
def test_trie_join_against_all_pairs(seed, near):
    rng = np.random.default_rng(seed)
    keys = []
    for centre in rng.integers(0, 2**63, 40, dtype=np.uint64):
        for _ in range(6):
            x = int(centre)
            for b in rng.integers(0, 64, rng.integers(0, near + 1)):
                x ^= 1 << int(b)
            keys.append(x)
    keys = np.unique(np.array(keys, np.uint64))
    want = brute_components([(i, int(k)) for i, k in enumerate(keys)])
    assert simhash.trie_self_join(keys, 0, 3).tolist() == want


def test_trie_join_of_a_dense_ball(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    ball = np.unique(np.array([sum(1 << b for b in bits) for bits in [(), *[(i,) for i in range(64)], *[(i, j) for i in range(20) for j in range(i)]]], np.uint64))
    assert set(simhash.trie_self_join(ball, 0, 3).tolist()) == {0}
    assert simhash.trie_self_join(ball[:1], 0, 3).tolist() == [0] and len(simhash.trie_self_join(ball[:0], 0, 3)) == 0


def test_components_of_a_chain(spark):
    edges = spark.range(200).selectExpr("(id * 7919) % 201 AS u", "((id + 1) * 7919) % 201 AS v")
    assert {r.root for r in simhash.components(edges).collect()} == {0}
    assert simhash.components(edges.limit(0)).count() == 0


def test_near_duplicates(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in rows]), strict=True))
    got = simhash.near_duplicates(documents).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.fingerprint == f"{brute_fingerprint(t.text):016x}" for r, t in zip(sorted(got, key=lambda r: r.doc_id), sorted(rows, key=lambda r: r.doc_id), strict=True))


def test_odd_rows(odd_documents):
    got = simhash.near_duplicates(odd_documents).collect()
    assert len(got) == 9 and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1} and sum(r.component_id == 4 for r in got) >= 3
    assert simhash.near_duplicates(odd_documents.limit(0)).count() == 0


def test_one_of_each_group_stays(odd_documents):
    kept = simhash.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids in (["1", "4", "6", "None"], ["1", "4", "6"])  # blanks, repeats and near copies are one each
    assert simhash.keep_one(odd_documents.limit(0)).count() == 0


def test_near_copies_are_caught(spark):
    """Texts with a few changed words lose against their source; unrelated texts stay."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        rows.append((i, " ".join(words)))
        for j in range(3):  # about one changed word of a hundred: five-word shingles agree to nine tenths
            copy = list(words)
            for at in rng.integers(0, 300, 3):
                copy[at] = f"new{rng.integers(0, 10**9)}"
            rows.append((1000 * (j + 1) + i, " ".join(copy)))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(40)) <= kept and len(kept) <= 42


def test_hot_group(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('same words in every copy ', IF(id % 3 = 0, 'here', concat('x', id, ' y', id * 7, ' z', id * 13))) AS text")
    got = simhash.near_duplicates(docs)
    assert got.where("component_id = 0").count() >= 1000 and got.count() == 3000


def _jaccard(a: str, b: str) -> float:
    one, two = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(one & two) / len(one | two)


@pytest.mark.parametrize("seed", range(4))
def test_similar_components_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 30))).astype(np.uint64) for _ in range(60)]
    sets += [np.setdiff1d(sets[k], sets[k][: rng.integers(0, 5)]) for k in rng.integers(0, 60, 60)]
    known = [set(x.tolist()) for x in sets]
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if want[i] != want[j] and 5 * len(known[i] & known[j]) >= 4 * len(known[i] | known[j]):
                want = [min(want[i], want[j]) if g in (want[i], want[j]) else g for g in want]
    assert simhash.similar_components(sets).tolist() == want


@pytest.mark.parametrize("group, most", [(300, 4000), (7, 4000), (7, 2)])
def test_only_texts_alike_to_four_fifths_go(spark, monkeypatch, group, most):
    """The same words in another order, and copies with many changed words, are candidates but no near copies."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "MOST", most)
    monkeypatch.setattr(simhash, "CHUNKS", 32 if most == 4000 else 1)
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in range(400)]
    rows = [(0, " ".join(words)), (1, " ".join(rng.permutation(words))), (2, "  ".join(words).upper())]
    rows += [(10 + k, " ".join(w if i not in (7 * k, 7 * k + 1) else f"n{k}x{i}" for i, w in enumerate(words))) for k in range(30)]
    rows += [(100 + k, " ".join(f"m{k}" if i % 20 == k else w for i, w in enumerate(words))) for k in range(5)]  # each shingle around every twentieth word
    assert all(_jaccard(rows[0][1], t) >= 0.8 for d, t in rows if 10 <= d < 100) and all(_jaccard(rows[0][1], t) < 0.8 for d, t in rows if d == 1 or d >= 100)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {0, 1, 100, 101, 102, 103, 104} <= kept and 2 not in kept and len(kept) <= 9


@pytest.mark.parametrize("dense, at_once", [(100_000, 1 << 16), (0, 7), (0, 1 << 16)])
def test_edges_of_dense_blocks(spark, monkeypatch, dense, at_once):
    """Blocks that are cut again, and blocks searched a few rows at a time, give the components of all pairs."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    rng = np.random.default_rng(8)
    keys = set()
    for centre in rng.integers(0, 2**63, 15, dtype=np.uint64):
        for _ in range(8):
            x = int(centre) << 1 & 2**64 - 1
            for b in rng.integers(0, 64, 2):
                x ^= 1 << int(b)
            keys.add(x)
    keys = sorted(keys)
    rows = [(i, 0, k - 2**64 if k >= 2**63 else k) for i, k in enumerate(keys)]
    marks = spark.createDataFrame(rows, "node long, k int, fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.near_edges(marks)).collect()}
    want = brute_components(list(enumerate(keys)))
    assert len(set(want)) < len(keys) and [roots.get(i, i) for i in range(len(keys))] == want


def test_turning_the_tail():
    keys = np.array([0x1234_5678_9ABC_DEF0, 2**64 - 1], np.uint64)
    assert [hex(int(x)) for x in simhash._turn_tail(keys, 16, 12)] == ["0x123489abcdef0567", "0xffffffffffffffff"]


def near_copy(rng, words, kind):
    """A copy whose five-word shingles agree to between 0.8 and 0.9, roughly."""
    n, out = len(words), list(words)
    if kind == "scattered":
        for at in rng.choice(n, max(1, n // 60), replace=False):
            out[at] = f"new{rng.integers(0, 10**9)}"
    elif kind == "appended":
        out += [f"new{x}" for x in rng.integers(0, 10**9, n // 6)]
    elif kind == "cut":
        out = out[: n - n // 6]
    else:
        at = rng.integers(0, n - n // 11)
        out[at : at + n // 12] = [f"new{x}" for x in rng.integers(0, 10**9, n // 12)]
    return out


@pytest.mark.parametrize("kind", ["scattered", "appended", "cut", "replaced"])
def test_recall_of_near_copies(spark, kind):
    rng = np.random.default_rng(11)
    texts = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 20 = 3").orderBy("doc_id").collect()]
    texts = [w for w in texts if 50 <= len(w) <= 1500 and len(set(w)) > len(w) // 3][:200]
    rows, pairs = [], []
    for i, words in enumerate(texts):
        copy = near_copy(rng, words, kind)
        if _jaccard(" ".join(words).lower(), " ".join(copy).lower()) >= 0.8:
            pairs.append(i)
            rows.append((100_000 + i, " ".join(copy)))
        rows.append((i, " ".join(words)))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(pairs) >= 100
    assert sum(100_000 + i not in kept for i in pairs) >= 0.95 * len(pairs)


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_no_text_is_shuffled_for_small_tables(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", limit)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i % 30) * 100 + k}" for k in range(60))) for i in range(60)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_one(docs)
        assert {r.doc_id for r in kept.collect()} == set(range(30))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("BroadcastHashJoin" in kept._jdf.queryExecution().executedPlan().toString()) == bool(limit)
