"""Joins and aggregates that SQL engines have and Spark spells differently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the last right row of its keys at or before its time (left join).

    Both sides are merged into one ordered stream per key, so the work is a sort, not a product.
    """
    keys = list(on)
    l = left.select(*[F.col(c) for c in keys], F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_r"))
    r = right.select(*[F.col(c) for c in keys], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), F.struct(*values).alias("_r"))
    seen = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    merged = l.unionByName(r).withColumn("_r", F.last("_r", ignorenulls=True).over(seen)).where("_side = 1")
    return merged.select("_l.*", *[F.col("_r")[v].alias(f"asof_{v}") for v in values])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points within [low, high] by buckets of ``width``: an equi-join and a filter instead of a product."""
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "_b").where(F.col(point).between(F.col(low), F.col(high))).drop("_b")


def sample_skewness(x: Column) -> Column:
    n = F.count(x)
    return F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x))


def sample_kurtosis(x: Column) -> Column:
    n = F.count(x)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def entropy(rows: DataFrame, column: str) -> DataFrame:
    """Entropy in bits of a column's values: counts first, then one row."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    total, weighted = F.sum("_n"), F.sum(F.col("_n") * F.log2("_n"))
    return counts.agg((F.log2(total) - weighted / total).alias("entropy"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """(value, n) of a column's distinct values."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def mode(rows: DataFrame, by: str, column: str) -> DataFrame:
    """The most frequent value of each group, ties to the smallest."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(by).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))).alias("_m")).select(by, F.col("_m.v").alias("mode"))
