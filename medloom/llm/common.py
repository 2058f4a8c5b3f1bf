"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: list[str] = []
#: Folders of the tables written by this process: one for all, or those of the scratches that are open.
_FOLDERS: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none (local tests) a temporary folder of this process is used.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_ROOT:
        folder = tempfile.TemporaryDirectory(prefix="medloom-")
        atexit.register(folder.cleanup)
        _LOCAL_ROOT.append(folder.name)
    return _LOCAL_ROOT[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can reach it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at the end; results must have been stored by then."""
    folder = f"{shared_root(spark)}/scratch-{uuid.uuid4().hex}"
    _FOLDERS.append(folder)
    try:
        yield
    finally:
        _FOLDERS.remove(folder)
        remove(spark, folder)


def release(spark: SparkSession) -> None:
    """Delete what queries of this process have written outside of a scratch: their results can't be read any more."""
    for folder in list(_FOLDERS):
        remove(spark, folder)
        _FOLDERS.remove(folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back: cuts the lineage, survives lost executors.

    The table stays until its scratch ends, or until ``release`` or the end of the process, as a lazy
    result may need it.
    """
    spark = df.sparkSession
    if not _FOLDERS:
        _FOLDERS.append(f"{shared_root(spark)}/run-{uuid.uuid4().hex}")
        atexit.register(_at_exit)
    path = f"{_FOLDERS[-1]}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_table(spark: SparkSession, rows: DataFrame) -> None:
    """Delete the table that ``written`` gave, once nothing reads it any more."""
    files = rows.inputFiles()
    if files:
        remove(spark, files[0].rsplit("/", 1)[0])


def _at_exit() -> None:
    with suppress(Exception):  # the session may have ended before
        if spark := SparkSession.getActiveSession():
            release(spark)


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str
) -> DataFrame:
    """mapInArrow with state per task: make() is called once in each task and returns the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            yield from work(batch)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str, rows: int = 64, size: int = 4 << 20) -> Iterator[list[str | None]]:
    """A column's strings in slices of at most ``rows`` rows and about ``size`` bytes, so that few long texts are held twice."""
    values = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(values):
        before = ends[at - 1] if at else 0
        n = max(1, min(rows, int(np.searchsorted(ends[at : at + rows], before + size, "right"))))
        yield values.slice(at, n).to_pylist()
        at += n


def fraction_hash(column: Column, salt: str) -> Column:
    """A uniform number in [0, 1) that depends on the value alone."""
    return F.pmod(F.xxhash64(F.lit(salt), column), F.lit(1 << 30)) / F.lit(float(1 << 30))
