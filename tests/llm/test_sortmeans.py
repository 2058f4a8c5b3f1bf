"""Sort-means against plain rounds over all centroids, in numpy and in SQL."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from medloom.llm import queries, sortmeans

SCHEMA = "vec_id long, embedding array<float>, cluster int, vector string"


def plain(values, before, centroids):
    d = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for v in values])
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("seed", range(6))
def test_assign_equals_full_scan(seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(-4, 5, (300, 3))
    centroids = rng.integers(-4, 5, (12, 3))
    centroids[5] = centroids[2]  # equal centroids tie
    order, quarter = sortmeans.centroid_order(centroids)
    for before in (np.zeros(300, np.int64), rng.integers(0, 12, 300)):
        cluster, distance, _ = sortmeans.assign(values, before, centroids, order, quarter)
        want, least = plain(values, before, centroids)
        assert cluster.tolist() == want.tolist() and distance.tolist() == least.tolist()


def test_scan_stops_early_and_not_at_equality():
    centroids = np.array([[0], [4], [100], [200]])
    order, quarter = sortmeans.centroid_order(centroids)
    cluster, distance, computed = sortmeans.assign(np.array([[2], [1], [150]]), np.array([1, 0, 3]), centroids, order, quarter)
    assert cluster.tolist() == [0, 0, 2] and distance.tolist() == [4, 1, 2500]  # 2 lies between both; 150 between 100 and 200
    assert computed == 5  # two, one and two distances instead of twelve


def test_numbers_beyond_longs_squares():
    centroids = np.array([[1 << 31], [-(1 << 31)]], object)
    order, quarter = sortmeans.centroid_order(centroids)
    cluster, distance, _ = sortmeans.assign(np.array([[-(1 << 31) + 5], [1 << 31]], object), np.array([0, 0]), centroids, order, quarter)
    assert cluster.tolist() == [1, 0] and distance.tolist() == [25, 0]


def run(spark, rows, **kw):
    return sortmeans.cluster(spark.createDataFrame(rows, SCHEMA), **kw).collect()


def test_odd_rows(spark):
    """Nulls everywhere, wrong widths, non-finite numbers, ties, repeated rows, columns with names used inside."""
    good = [(i, [float(i % 3), float(i % 5)], 1, "x") for i in range(40)]
    odd = [(None, [0.0, 0.0], None, None), (50, None, 1, "x"), (51, [1.0, None], 1, "x"), (52, [1.0, float("nan")], 1, "x"), (53, [float("-inf"), 1.0], 1, "x"), (54, [1.0], 1, "x"), (55, [], 1, "x"), (7, [9.0, 9.0], 1, "x"), (7, [9.0, 9.0], 1, "x")]
    found = run(spark, good + odd, k=6, rounds=3, width=2)
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in found) == sorted([(False, i) for i in range(40)] + [(False, 7)] * 2 + [(True, 0)])
    assert {r.inertia for r in found} == {sum(r.distance for r in found)}
    # plain rounds over the same rows
    rows = [(i, [int(256 * x) for x in v]) for i, v, *_ in good + odd[:1] + odd[-2:]]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)
    centroids = [v for _, v in named[:6]]
    for no in range(4):
        where, least = plain([v for _, v in rows], None, centroids)
        if no < 3:
            for c in range(6):
                mine = [v for (_, v), w in zip(rows, where, strict=True) if w == c]
                if mine:
                    centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    want = sorted((str(i), int(w), int(d), hashlib.sha256(",".join(map(str, centroids[w])).encode()).hexdigest()) for (i, _), w, d in zip(rows, where, least, strict=True))
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.centroid_sha256) for r in found) == want


def test_few_and_no_vectors(spark):
    assert run(spark, [], width=2) == []
    assert run(spark, [(1, None, 1, "x"), (None, [1.0, 1.0], 1, "x")], width=2) == []  # no id, no first centroid
    one = run(spark, [(1, [-0.001, 0.5], 1, "x")] * 3, width=2)
    assert [(r.vec_id, r.cluster, r.distance) for r in one] == [(1, 0, 0)] * 3
    assert one[0].centroid_sha256 == hashlib.sha256(b"-1,128").hexdigest()


def test_large_numbers_are_exact_or_an_error(spark):
    far = [(i, [float(1 << 20) * (i % 2), 0.0], 1, "x") for i in range(20)]
    found = run(spark, far, k=3, rounds=2, width=2)
    assert {r.vec_id for r in found if r.distance == 0} == set(range(20))
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, [(1, [1e30, 0.0], 1, "x")], width=2)


def test_one_value_for_a_third_of_all_rows(spark):
    rows = spark.range(6000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(0.5), F.lit(0.5))).otherwise(F.array((F.col("id") % 97) / 97.0, (F.col("id") % 89) / 89.0)).alias("embedding"))
    found = sortmeans.cluster(rows, k=8, rounds=2, width=2)
    assert found.count() == 6000
    assert found.where("vec_id % 3 = 0").select("cluster", "distance").distinct().count() == 1


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    cols = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = con.sql(queries.ORACLES["op13_sort_means"]).df()[cols]
    got = queries.op13_sort_means(spark, sf).toPandas()[cols]
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))
