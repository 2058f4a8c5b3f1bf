"""Quantiles, entropy and histograms of groups against numpy."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from medloom.operators import distribution


def test_quantiles(spark):
    """A group of most rows, one of a single value, null keys, nulls, names with dots."""
    rng = np.random.default_rng(2)
    rows = [("hot", None, float(x)) for x in rng.normal(0, 100, 3000).round(1)]
    rows += [(str(k), "b", float(x)) for k in range(40) for x in rng.integers(0, 5, rng.integers(1, 8))]
    rows += [(None, "b", 1.5), (None, "b", 2.0), (None, None, -7.0), ("one", "c", 3.25), ("none", "c", None)] + [("same", "c", 4.0)] * 50
    frame = spark.createDataFrame(rows, "`a.b` string, k string, x double").repartition(6)
    wanted = {"low": 0.0, "p10": 0.1, "half": 0.5, "again": 0.5, "top": 1.0}
    got = {(r["a.b"], r["k"]): r for r in distribution.quantiles(frame, ["a.b", "k"], "x", wanted).collect()}
    held = {}
    for a, k, x in rows:
        if x is not None:
            held.setdefault((a, k), []).append(x)
    assert set(got) == set(held)
    for key, values in held.items():
        assert np.allclose([got[key][n] for n in wanted], np.quantile(values, list(wanted.values())))


def test_no_keys_no_rows_infinities(spark):
    frame = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),), (float("inf"),)], "k double")
    assert tuple(distribution.quantiles(frame, [], "k", {"a": 0.0, "b": 0.9}).first()) == (float("-inf"), float("inf"))
    empty = frame.where("false")
    assert distribution.quantiles(empty, [], "k", {"a": 0.5}).count() == 0
    assert distribution.entropy(empty, ["k"], "k").count() == 0 and distribution.histogram(empty, ["k"], "k").count() == 0


def test_entropy_and_histogram(spark):
    rows = [("a", v) for v in "xxyz"] + [(None, "x"), (None, None), ("b", None)] + [("c", "same")] * 9
    frame = spark.createDataFrame(rows, "g string, v string")
    got = {r.g: (r.n, r.n_values, r.entropy) for r in distribution.entropy(frame, ["g"], "v").collect()}
    assert got == {"a": (4, 3, 1.5), None: (1, 1, 0.0), "c": (9, 1, 0.0)}
    assert {tuple(r) for r in distribution.histogram(frame, ["g"], "v").collect()} == {(g, v, n) for (g, v), n in Counter(rows).items() if v is not None}


def test_a_million_distinct_values(spark):
    frame = spark.range(1_000_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"))
    for r in distribution.entropy(frame, ["g"], "x").collect():
        assert (r.n, r.n_values) == (500_000, 500_000) and abs(r.entropy - math.log2(500_000)) < 1e-9
    for r in distribution.quantiles(frame, ["g"], "x", {"half": 0.5, "p1": 0.01}).collect():
        assert (r.half, r.p1) == (r.g + 2 * (499_999 / 2), r.g + 2 * 4999.99)
