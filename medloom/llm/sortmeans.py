"""Centroid clustering of whole-number vectors by sort-means.

Each round orders, for every centroid, the other centroids by their distance from it (at most ``k`` x
``k`` numbers).  A vector starts at the centroid that it was assigned to before and scans the others in that
order.  By the triangle inequality a centroid that lies more than twice the vector's current distance away
from the current centroid is farther from the vector, so the scan stops strictly beyond that: at exactly
twice the distance a centroid may still tie, and ties go to the smaller number.  Squares are compared
(D > 4 d), so everything is exact.

Rounds are narrow: a task reads vectors with their last assignment and writes them with the new one, without a
shuffle, and adds at most ``k`` rows with the sums of its clusters; only these are aggregated, and the
driver holds ``k`` x ``width`` numbers whatever the table's size.  Vectors of one value, however
common, are dealt like any others, as no key is grouped before it is summed.

Vectors that are null, hold null or non-finite components or have another width take no part.  Repeated
rows are vectors each.  A null vec_id is assigned, but begins no centroid; equal hashes begin in the order of their vectors.
With fewer vectors than ``k`` there are fewer centroids; an empty table gives no rows.  Components
that do not fit a long, and distances that do not, are an error: clipped they would be false ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from medloom.llm.common import remove_table, written
from medloom.llm.maxscore import usable

#: Components below this give squared distances (of up to 2^12 components) and sums of a batch that fit a long.
_SMALL = 1 << 24
#: Vectors whose distances are held at once.
_SLICE = 16_384


def whole(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def kept_vectors(vectors: DataFrame, width: int = 64, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vector (array of long) of the rows that take part."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")).where((F.size("vector") == width) & usable("vector"))
    fits = ~F.exists("vector", lambda x: F.abs(x.cast("double") * F.lit(float(scale))) >= F.lit(2.0**63))
    return rows.select("vec_id", F.when(fits, whole("vector", scale)).otherwise(F.raise_error(F.lit("a component does not fit a long; scale the vectors down"))).alias("vector"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors with the least sha256 of ``seed:vec_id``, in that order: k rows."""
    named = vectors.where(F.col("vec_id").isNotNull()).withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    rows = named.orderBy("hash", "vector").limit(k).select("vector").collect()
    return _exact(np.array([r.vector for r in rows], np.int64))


def _exact(values: np.ndarray) -> np.ndarray:
    """The numbers as longs where squares of their differences fit, otherwise as numbers of any size."""
    return values.astype(np.int64) if not values.size or max(int(values.max()), -int(values.min())) < _SMALL else values.astype(object)


def distances(values: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances of rows from one centroid."""
    apart = values - centroid
    return (apart * apart).sum(axis=1) if apart.dtype == object else np.einsum("ij,ij->i", apart, apart)


def centroid_order(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid all centroids by distance (itself first), and a quarter of these squared distances, rounded up.

    D > 4 d for a whole d exactly if the rounded quarter is larger than d.
    """
    apart = np.array([distances(centroids, c) for c in centroids])
    quarter = -(-apart // 4)
    for i in range(len(centroids)):
        quarter[i, i] = -1  # itself first, also before equal centroids
    order = np.argsort(quarter, axis=1, kind="stable")
    return order, np.take_along_axis(quarter, order, axis=1)


def assign(values: np.ndarray, before: np.ndarray, centroids: np.ndarray, order: np.ndarray, quarter: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row, its squared distance, and how many distances were computed."""
    cluster, least, computed = before.copy(), np.zeros(len(values), values.dtype), 0
    for a in np.unique(before):
        rows = np.flatnonzero(before == a)
        mine = values[rows]
        start = distances(mine, centroids[a])
        far = np.argsort(-start, kind="stable")  # the first rows are those that scan on the longest
        rows, mine, start = rows[far], mine[far], start[far]
        best, where = start.copy(), np.full(len(rows), a)
        computed += len(rows)
        for other, bound in zip(order[a, 1:], quarter[a, 1:], strict=True):
            active = int(np.searchsorted(-start, -bound, "right")) if start.dtype != object else int((start >= bound).sum())
            if not active:
                break
            d = distances(mine[:active], centroids[other])
            computed += active
            nearer = (d < best[:active]) | ((d == best[:active]) & (other < where[:active]))
            best[:active][nearer], where[:active][nearer] = d[nearer], other
        cluster[rows], least[rows] = where, best
    return cluster, least, computed


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, width)


def _assigned(vectors: DataFrame, centroids: np.ndarray, last: bool = False) -> DataFrame:
    """vec_id, vector, cluster, distance of every row; ``vectors`` may hold the assignment before.

    Beside them each task gives a row of ``sums`` and ``n`` for each of its clusters, whose other columns are null.
    The last assignment has neither vectors nor sums.
    """
    spark, (k, width) = vectors.sparkSession, centroids.shape
    handed = spark.sparkContext.broadcast((centroids, *centroid_order(centroids)))  # k x width and k x k numbers
    has_before = "cluster" in vectors.columns
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, " + ("" if last else "vector array<long>, ") + "cluster int, distance long" + ("" if last else ", sums array<decimal(38,0)>, n long")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batch_of(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, order, quarter = handed.value
        total, count = np.zeros((k, width), object), np.zeros(k, np.int64)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, _SLICE):
                batch = whole_batch.slice(at, _SLICE)
                values = _exact(batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, width))
                mixed = object if object in (values.dtype, centroids.dtype) else np.int64
                before = batch.column("cluster").to_numpy().astype(np.int64) if has_before else np.zeros(batch.num_rows, np.int64)
                cluster, distance, _ = assign(values.astype(mixed), before, centroids.astype(mixed), order, quarter)
                if mixed is object and len(distance) and max(distance) >= 1 << 63:
                    raise OverflowError("a distance does not fit a long; scale the vectors down")
                yield batch_of(batch.num_rows, vec_id=batch.column("vec_id"), vector=batch.column("vector"), cluster=pa.array(cluster), distance=pa.array(distance.astype(np.int64)))
                for c in () if last else np.unique(cluster):
                    mine = cluster == c
                    total[c] += values[mine].sum(axis=0)
                    count[c] += int(mine.sum())
        used = np.flatnonzero(count)
        if len(used):
            sums = pa.array([[Decimal(int(x)) for x in total[c]] for c in used], pa.list_(pa.decimal128(38)))
            yield batch_of(len(used), cluster=pa.array(used), sums=sums, n=pa.array(count[used]))

    return vectors.select("vec_id", "vector", *(["cluster"] if has_before else [])).mapInArrow(run, schema)


def _moved(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """The mean of each cluster, rounded down exactly; empty ones stay."""
    parts = sums.select("cluster", "n", F.posexplode("sums").alias("place", "s"))
    means = parts.groupBy("cluster", "place").agg(F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("n").alias("n"))
    out = centroids.astype(object)
    for r in means.collect():  # k x width rows at most
        out[r.cluster, r.place] = int(r.s) // r.n
    return _exact(out)


def fit(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2") -> tuple[np.ndarray | None, DataFrame]:
    """The centroids after ``rounds`` rounds, and the vectors with their last assignment (None and the vectors without any)."""
    spark = vectors.sparkSession
    rows = written(vectors, "vectors")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return None, rows
    for no in range(rounds):
        found = written(_assigned(rows, centroids), f"round-{no}")
        remove_table(spark, rows)
        centroids = _moved(centroids, found.where(F.col("sums").isNotNull()))
        rows = found.where(F.col("sums").isNull()).select("vec_id", "vector", "cluster")
    return centroids, rows


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: str = "2", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    centroids, rows = fit(kept_vectors(vectors, width, scale, vec_id, vector), k, rounds, seed)
    if centroids is None:
        none = rows.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(n) for n in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
        return none.where(F.lit(False))
    last = written(_assigned(rows, centroids, last=True), "assigned")
    remove_table(spark, rows)
    sums = last.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows at most
    digest = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    all_of_them = sum(r.cluster_inertia for r in sums)
    table = spark.createDataFrame([(r.cluster, r.cluster_inertia, all_of_them, digest[r.cluster]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows
    return last.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
