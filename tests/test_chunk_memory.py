"""Chunks of long texts: Python holds few of them at a time, however many a task has."""

import resource
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from medloom.operators import longnotes, notes

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def held_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * resource.getpagesize() / 1e6


class Watched:
    """One token for each text; fails once its process has grown by 80 MB."""

    def __init__(self):
        self.before = held_mb()

    def ends(self, text):
        if held_mb() - self.before > 80:
            raise MemoryError("too many texts are held")
        return [len(text)] if text else []


def long_texts(spark, n=2500, words=20_000):
    return spark.range(n, numPartitions=1).select(F.col("id").alias("patient_id"), F.concat(F.repeat(F.lit("word "), words), F.col("id").cast("string")).alias("text"))


def test_chunks_of_whole_texts(spark):
    rows = long_texts(spark).withColumnRenamed("text", "notes")
    got = notes.chunk_notes(rows, 100, 10, Watched).agg(F.count(F.lit(1)), F.max("total_chunks"), F.sum(F.length("chunk_text"))).first()
    assert tuple(got) == (2500, 1, rows.agg(F.sum(F.length("notes"))).first()[0])


def test_chunks_note_by_note(spark):
    rows = long_texts(spark, 5000)
    got = longnotes.chunk_patients(rows, 100, 10, Watched).agg(F.count(F.lit(1)), F.max("total_chunks"), F.sum(F.length("chunk_text"))).first()
    header = len("--- unknown |  ---\n")
    assert tuple(got) == (5000, 1, rows.agg(F.sum(F.length("text") + header)).first()[0])


def test_null_and_empty_texts_have_no_chunks(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a b c")], "patient_id long, notes string")
    assert [tuple(r) for r in notes.chunk_notes(rows, 2, 0).orderBy("chunk_index").collect()] == [("3", 0, 2, "a b"), ("3", 1, 2, " c")]
