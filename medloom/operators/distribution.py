"""Exact quantiles, entropy and histograms for all groups at once, without a task that holds a group.

Values are counted first, with partial counts before the shuffle, so a value that fills a group is one row.
Quantiles are picked by place: counted values are range-partitioned by (group, value), parts report their
sums for each group, and only the parts that a wanted place falls into are summed value by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medloom.session import settled


def counted(rows: DataFrame, keys: Sequence[str], x: Column) -> DataFrame:
    """(k, x, n): how often each value stands in each group, nulls left out; ``k`` is a struct of the keys, so null keys are groups, too."""
    named = F.struct(*[F.col(f"`{c}`").alias(c) for c in keys]) if keys else F.struct(F.lit(0).alias("all"))
    return rows.select(named.alias("k"), x.alias("x")).where("x IS NOT NULL").groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))


def _unkeyed(rows: DataFrame, keys: Sequence[str], *more: str | Column) -> DataFrame:
    return rows.select(*[F.col(f"k.`{c}`").alias(c) for c in keys], *more)


def places(counts: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """(k, q, low, high, between) from settled counts: the values beside each quantile's place, and how far between them it lies."""
    dealt = settled(counts.repartitionByRange("k", "x").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("k", "part").agg(F.sum("n").alias("all"))
    upto = F.sum("all").over(Window.partitionBy("k").orderBy("part"))  # a row for each part that a group reaches
    sums = sums.select("k", "part", (upto - F.col("all")).alias("ahead"), upto.alias("upto"))
    wanted = sums.groupBy("k").agg(F.max("upto").alias("total")).withColumn("q", F.explode(F.array(*map(F.lit, quantiles))))
    place = F.col("q") * (F.col("total") - 1)
    wanted = wanted.select("k", "q", F.floor(place).alias("low"), F.ceil(place).alias("high"), (place - F.floor(place)).alias("between"))
    # the parts with a wanted place, each with its places: at most one for each quantile
    found = sums.join(wanted, "k").where((F.col("low") < F.col("upto")) & (F.col("high") >= F.col("ahead")))
    held = found.groupBy("k", "part", "ahead").agg(F.collect_list(F.struct("q", "low", "high", "between")).alias("w"))
    near = dealt.join(held, ["k", "part"])
    after = F.col("ahead") + F.sum("n").over(Window.partitionBy("k", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("after", after)
    has = lambda c: (c < F.col("after")) & (c >= F.col("after") - F.col("n"))
    hit = near.select("k", "x", "n", "after", F.explode(F.filter("w", lambda w: has(w["low"]) | has(w["high"]))).alias("w"))
    at = lambda c: F.max(F.when(has(F.col(c)), F.col("x")))
    return hit.groupBy("k", F.col("w.q").alias("q")).agg(at("w.low").alias("low"), at("w.high").alias("high"), F.first("w.between").alias("between"))


def interpolated(low: Column, high: Column, between: Column) -> Column:
    return F.when(low == high, low).otherwise(low + (high - low) * between)


def quantiles(rows: DataFrame, keys: Sequence[str], column: str, wanted: dict[str, float]) -> DataFrame:
    """(keys, a column for each wanted name): continuous quantiles of each group, as double.

    Nulls are left out; a group without values has no row.  NaN is larger than all numbers.
    """
    counts = settled(counted(rows, keys, F.col(f"`{column}`").cast("double")))
    found = places(counts, sorted(set(wanted.values())))
    value = interpolated(F.col("low"), F.col("high"), F.col("between"))
    return _unkeyed(found.groupBy("k").agg(*[F.max(F.when(F.col("q") == q, value)).alias(name) for name, q in wanted.items()]), keys, *wanted)


def histogram(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, value, n): a row for each distinct value of a group, however many there are."""
    return _unkeyed(counted(rows, keys, F.col(f"`{column}`")), keys, F.col("x").alias("value"), "n")


def entropy(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, n, n_values, entropy) in bits over a group's distinct values; groups without values have no row."""
    n = F.sum("n")
    bits = F.greatest(F.lit(0.0), F.log2(n) - F.sum(F.col("n") * F.log2("n")) / n)
    sums = counted(rows, keys, F.col(f"`{column}`")).groupBy("k").agg(n.alias("n"), F.count(F.lit(1)).alias("n_values"), bits.alias("entropy"))
    return _unkeyed(sums, keys, "n", "n_values", "entropy")
