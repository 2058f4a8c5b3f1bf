"""Exact top-k inner products by MaxScore over shards of postings.

A term is a dimension.  A shard keeps its postings by dimension (one contiguous row of values per
dimension) with the largest and smallest value of each, which bound what a dimension can add to a
query's score.  For each query the dimensions are ordered by their bounds; the non-essential ones are
the longest tail whose summed bounds stay below the query's current k-th score, so no document can
get there by them alone.  Essential postings are traversed for all documents of the shard; only
documents that stay competitive (score so far + bounds of the rest >= threshold; equality stays, for
ties) are probed in the other dimensions, largest bound first.  Thresholds start from the scores among
the first queries themselves, which are rows of the table, too.  Shards of all tasks are merged by score, then id.

Queries come in blocks of at most about ``block`` rows; one block is broadcast at a time (its size is
bound by ``block`` and the number of dimensions), so neither queries nor candidates ever have to fit
the driver.  Scores that do not fit a long raise ``OverflowError``: clipped they would be false ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medloom.llm.common import written

BLOCK, SHARD, CHUNK, SEEDS = 8192, 4096, 256, 1024
_EXACT = float(1 << 53)


def usable(vector: str) -> Column:
    """Not null, and without null or non-finite components."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ~bad


def matrix(vectors: pa.Array, scale: int) -> np.ndarray:
    """Rows of floor(scale * x); shorter vectors are filled with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy()).astype(np.int64)
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, k: int, seed: np.ndarray | None = None):
        self.ids, self.k = ids, k
        self.none = np.iinfo(np.int64).min
        self.scores = np.full((len(ids), k), self.none)
        self.docs = np.zeros((len(ids), k), np.int64)
        self.seed = np.full(len(ids), self.none) if seed is None else seed

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """Candidates of some queries, in any order."""
        who = np.unique(query)
        if not len(who):
            return
        q = np.concatenate([query, np.repeat(who, self.k)])
        s = np.concatenate([score, self.scores[who].ravel()])
        d = np.concatenate([doc, self.docs[who].ravel()])
        order = np.lexsort((d, ~s, q))  # ~ falls as s grows, and cannot overflow
        q, s, d = q[order], s[order], d[order]
        starts = np.searchsorted(q, who)
        at = starts[:, None] + np.arange(self.k)
        self.scores[who], self.docs[who] = s[at], d[at]

    def threshold(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.seed)


def _exact_scores(query: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers of any size."""
    whole = [int(a) for a in query]
    scores = [sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in values]
    if any(not -(2**63) < x < 2**63 for x in scores):
        raise OverflowError("an inner product does not fit a long; scale the vectors down")
    return np.array(scores, np.int64)


def search_shard(best: Best, queries: np.ndarray, values: np.ndarray, docs: np.ndarray) -> int:
    """MaxScore of every query over one shard: ``values`` holds a row per document.  The number of postings skipped."""
    width = max(queries.shape[1], values.shape[1])
    queries, values = _wide(queries, width), _wide(values, width)
    large = np.abs(queries).max(initial=0) * np.abs(values).max(initial=0) * max(width, 1) >= _EXACT  # beyond exact doubles
    if large or not width:
        for i, q in enumerate(queries):
            other = np.flatnonzero(docs != best.ids[i])
            best.add(np.full(len(other), i), _exact_scores(q, values[other]), docs[other])
        return 0
    top, low = values.max(axis=0), values.min(axis=0)
    postings = np.ascontiguousarray(values.T)
    need = best.threshold()
    skipped, found = 0, []
    for i, q in enumerate(queries):
        bound = np.maximum(q * top, q * low)
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0.0)  # what the dimensions from here on can add
        # a dimension may only take away, so a tail counts by its largest sum from any of its places on
        reach = np.maximum.accumulate(rest[::-1])[::-1]
        essential = width if need[i] == best.none else int(np.argmax(reach < need[i])) if (reach < need[i]).any() else width
        dims = order[:essential]
        score = q[dims] @ postings[dims]
        at = np.flatnonzero((score + rest[essential] >= need[i]) & (docs != best.ids[i]))
        if need[i] == best.none and len(at) > best.k:  # every dimension is traversed: the k best of this shard
            at = at[score[at] >= np.partition(score[at], -best.k)[-best.k]]
        score = score[at]
        skipped += (len(docs) - len(at)) * (width - essential)
        for k in range(essential, width):
            if not len(at):
                break
            score = score + q[order[k]] * postings[order[k]][at]
            keep = score + rest[k + 1] >= need[i]
            skipped += int((~keep).sum()) * (width - k - 1)
            at, score = at[keep], score[keep]
        found.append((np.full(len(at), i), score.astype(np.int64), docs[at]))
        if len(found) == CHUNK:
            best.add(*map(np.concatenate, zip(*found, strict=True)))
            found = []
    if found:
        best.add(*map(np.concatenate, zip(*found, strict=True)))
    return skipped


def first_thresholds(ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that its k-th best reaches: that among the first ``SEEDS`` queries."""
    best = Best(ids, k)
    seeds = queries[:SEEDS]
    if len(seeds) <= k or not seeds.shape[1] or np.abs(queries).max(initial=0) ** 2 * queries.shape[1] >= _EXACT:
        return best.seed
    for at in range(0, len(queries), CHUNK):
        score = queries[at : at + CHUNK] @ seeds.T
        score[ids[at : at + CHUNK, None] == ids[None, :SEEDS]] = -np.inf
        kth = np.partition(score, -k, axis=1)[:, -k]
        best.seed[at : at + CHUNK] = np.where(np.isfinite(kth), np.where(np.isfinite(kth), kth, 0).astype(np.int64), best.none)
    return best.seed


def _search_block(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, scale: int, vec_id: str, vector: str) -> DataFrame:
    handed = vectors.sparkSession.sparkContext.broadcast((ids, queries, first_thresholds(ids, queries, k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, seed = handed.value
        best = Best(ids, k, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                part = batch.slice(at, SHARD)
                search_shard(best, queries, matrix(part.column(1), scale), part.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        q, r = np.nonzero(best.scores != best.none)
        for at in range(0, len(q), 100_000):
            s = (q[at : at + 100_000], r[at : at + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(ids[s[0]]), pa.array(best.docs[s]), pa.array(best.scores[s])], ["query_id", "vec_id", "score"])

    return vectors.select(vec_id, vector).mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block: int = BLOCK, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row with ``is_query``, itself left out.

    Rows with a null id, or with a null vector or null or non-finite components, take no part.  Equal
    scores rank by id.  Rows that repeat an id are candidates each, but none for a query of that id.
    Equal query rows are one query; different vectors of one id are searched each, and what they find
    is ranked together under the id.
    """
    rows = vectors.select(vec_id, vector).where(F.col(vec_id).isNotNull() & usable(vector))
    asked = rows.where(is_query).dropDuplicates([vec_id, vector])
    n = asked.count()
    blocks = max(1, -(-n // block))
    parts = []
    for no in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(vec_id, vector), F.lit(blocks)) == no)
        got = mine.select(vec_id, vector).toArrow().combine_chunks()
        if not got.num_rows:
            continue
        vecs = got.column(1).combine_chunks() if isinstance(got.column(1), pa.ChunkedArray) else got.column(1)
        found = _search_block(rows, got.column(0).to_numpy().astype(np.int64), matrix(vecs, scale), k, scale, vec_id, vector)
        parts.append(found if blocks == 1 else written(found, f"top-{no}"))
    if not parts:
        return rows.select(F.col(vec_id).alias("query_id"), F.lit(0).alias("rank"), F.col(vec_id).alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
