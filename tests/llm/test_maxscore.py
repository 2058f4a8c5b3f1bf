import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from medloom.llm import maxscore
from medloom.llm.queries import ORACLES, op6_top_k


def brute(rows, every, k=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), d) for d, b in ok if d != q)[:k]
            out |= {(q, r, d, -s) for r, (s, d) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("seed, n, spread", [(0, 300, 1.0), (1, 600, 0.01), (2, 4, 1.0), (3, 1, 1.0)])
def test_against_brute_force(spark, seed, n, spread):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, spread, 8), 2).astype(np.float32)]) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {tuple(r) for r in maxscore.top_k(df, F.col("vec_id") % 10 == 0).collect()}
    assert got == brute(rows, 10)


def test_small_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", 16)
    monkeypatch.setattr(maxscore, "CHUNK", 3)
    rng = np.random.default_rng(9)
    values, ids = np.floor(rng.normal(0, 40, (200, 12))), np.arange(200)
    best = maxscore.Best(ids[:20], 5)
    for at in range(0, 200, 16):
        maxscore.search_shard(best, values[:20], values[at : at + 16], ids[at : at + 16])
    scores = values[:20] @ values.T
    for q in range(20):
        want = sorted((-scores[q, d], d) for d in range(200) if d != q)[:5]
        assert [(-s, d) for s, d in want] == list(zip(best.scores[q], best.docs[q], strict=True))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values / 256)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in maxscore.top_k(df, F.col("vec_id") % 10 == 0, block=6).collect()} == brute(rows, 10)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (10, None), (20, [nan, 1.0]), (30, [inf, 0.0]), (40, [None, 1.0]), (50, [1.0]), (60, []), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [9.0, 9.0]), (3, [-1.0, 0.5]), (70, [1e6, -1e6]), (4, [1e6, 1e6])]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "vec_id long, embedding array<float>, query_id string, score int")
    assert {tuple(r) for r in maxscore.top_k(df, F.col("vec_id") % 10 == 0).collect()} == brute(rows, 10)
    assert maxscore.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_numbers_beyond_doubles():
    best = maxscore.Best(np.array([0]), 2)
    big = float(1 << 30)
    maxscore.search_shard(best, np.array([[big, 1.0]]), np.array([[big, 1.0], [big, 2.0], [0.0, 5.0]]), np.array([1, 2, 3]))
    assert best.docs[0].tolist() == [2, 1] and best.scores[0].tolist() == [(1 << 60) + 2, (1 << 60) + 1]


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    want = {tuple(map(int, r)) for r in con.sql(ORACLES["op6_top_k"]).fetchall()}
    assert {tuple(r) for r in op6_top_k(spark, "/root/testdata/sf0.001").collect()} == want


def test_repeated_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 1, 6), 2).astype(np.float32)]) for i in range(60)]
    every = spark.createDataFrame([*rows, rows[7]], "vec_id long, embedding array<float>")  # no query: a candidate twice
    assert sorted(tuple(r) for r in maxscore.top_k(every, F.col("vec_id") % 10 == 0).collect()) == sorted(brute([*rows, rows[7]], 10))
    doubled = spark.createDataFrame([*rows, rows[0]], "vec_id long, embedding array<float>")
    mine = sorted(tuple(r) for r in maxscore.top_k(doubled, F.col("vec_id") == 0).collect())
    assert mine == sorted(r for r in brute(rows, 10) if r[0] == 0)


def test_postings_are_skipped():
    rng = np.random.default_rng(5)
    values = np.floor(rng.normal(0, 1, (4000, 32)) * np.geomspace(100, 1, 32))
    ids = np.arange(4000)
    best = maxscore.Best(ids[:20], 5, maxscore.first_thresholds(ids[:20], values[:20], 5))
    skipped = sum(maxscore.search_shard(best, values[:20], values[at : at + 500], ids[at : at + 500]) for at in range(0, 4000, 500))
    assert skipped > 0.3 * 20 * 4000 * 32
    scores = values[:20] @ values.T
    for q in range(20):
        assert [d for _, d in sorted((-scores[q, d], d) for d in range(4000) if d != q)[:5]] == best.docs[q].tolist()


def test_scores_beyond_a_long_are_refused():
    with pytest.raises(OverflowError):
        maxscore.search_shard(maxscore.Best(np.array([0]), 2), np.array([[2.0**40]]), np.array([[2.0**40]]), np.array([1]))
