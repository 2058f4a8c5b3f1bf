"""Sessions, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

#: What the library relies on; the cluster's own settings win elsewhere.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.runSQLOnFiles": "false",  # SELECT ... FROM parquet.`path` must not reach files
}
_LOCAL: list[str] = []
_RUN: list[str] = []


def build_session(name: str = "medloom", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode without one, a temporary folder of this process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        folder = tempfile.TemporaryDirectory(prefix="medloom-")
        atexit.register(folder.cleanup)
        _LOCAL.append(folder.name)
    return _LOCAL[0]


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a scan, dealt out evenly if it is read in fewer than two parts for each core.

    Only small tables are, where one row group may hold all rows whatever the number of parts: a large
    table has parts enough, and its rows stay where they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < 2 * cores else rows


def settled(rows: DataFrame, by: str | None = None) -> DataFrame:
    """rows, written once into the shared folder and read back: fixed content, no lineage.

    ``by`` stores them by that column.  The tables stay until ``release`` or the end of the process, as
    lazy results may need them.
    """
    spark = rows.sparkSession
    if not _RUN:
        _RUN.append(f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}")
        atexit.register(_at_exit)
    path = f"{_RUN[0]}/{uuid.uuid4().hex}"
    (rows.write.partitionBy(by) if by else rows.write).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that this process has settled: results made of them can't be read any more."""
    for folder in _RUN:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _RUN.clear()


def _at_exit() -> None:
    with suppress(Exception):  # the session may have ended before
        if spark := SparkSession.getActiveSession():
            release(spark)
