"""Contiguous shards of near-equal size from global prefix sums.

Rows are ordered by doc_id (then by arrival) by range partitioning; each partition reports its total,
the totals are summed up once (one row per partition), and every row learns how many bytes lie before
it in the whole table.  A row goes to the shard in which the middle of its bytes falls.  Only ids,
sizes and checksums move; a hot doc_id is spread, since the arrival number is part of the sort key.
Null texts count one byte.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medloom.llm.common import written


def with_prefix_sums(rows: DataFrame, size: str, order: list[str], name: str = "placed") -> DataFrame:
    """rows (slim) with ``before`` (sum of ``size`` over the rows ahead) and ``row_no``, both over the whole table."""
    fields = [f.simpleString().split(":", 1) for f in rows.schema]
    schema = ", ".join(f"`{n}` {t}" for n, t in fields) + ", part int, before_here long, row_here long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, seen = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            sizes = batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes) + total
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(ends - sizes), pa.array(np.arange(seen, seen + n))],
                [*batch.schema.names, "part", "before_here", "row_here"],
            )
            total, seen = int(ends[-1]) if n else total, seen + n

    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(parted.mapInArrow(run, schema), name)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum(size).alias("t"), F.count(F.lit(1)).alias("c"))
    starts = totals.select("part", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("t"), F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("c"))
    # one row per partition
    return placed.join(F.broadcast(starts), "part").select(*rows.columns, (F.col("before_here") + F.col("t")).alias("before"), (F.col("row_here") + F.col("c")).alias("row_no"))


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("arrival"))
    rows = with_prefix_sums(written(slim, "sizes"), "size", ["doc_id", "arrival"])
    total = rows.agg(F.sum("size").alias("total"))
    # one row: the total
    cut = rows.join(F.broadcast(total)).withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"((2 * before + size) * {shards}) div (2 * total)")).cast("int"))
    first = cut.groupBy("shard").agg(F.min("row_no").alias("first"))
    # at most one row per shard
    return cut.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row_no") - F.col("first")).alias("slot"))
