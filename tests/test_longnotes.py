"""Chunks made note by note against chunks of whole texts."""

import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from medloom.operators import longnotes, notes

SCHEMA = "patient_id string, text string, date string, note_type string, file_no int, row_no long"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def some_notes(spark, spaced=True):
    rng = np.random.default_rng(5)
    words = ["word ", "x ", "\n--- n ---\n", "long-word ", "é　ß ", "\n\n", "--- "]
    rows = []
    for p in ["1", "2", "3", None, "hot"]:
        for k in range(200 if p == "hot" else int(rng.integers(1, 9))):
            text = "".join(rng.choice(words, rng.integers(0, 60))) + str(rng.choice(["", " ", "\n--- ", "\n \n"]))
            date = [None, "2020-01-02", "2020-02-02", "", "2019-05-05"][rng.integers(0, 5)]
            rows.append((p, text if spaced else text.strip() + ".", date, [None, "a", "b"][rng.integers(0, 3)], k % 2, k // 3))
    rows += [("short", "too short", None, None, 0, 0), ("none", None, None, None, 0, 0), ("long", "many words here " * 3000, None, "x", 0, 0)]
    rows += [("twice", "the same note again", "2020-01-01", "x", 0, 0)] * 3
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def by_hand(rows, tokenizer, size, overlap, window):
    out = []
    for r in notes.concatenate(rows).collect():
        chunks = notes.chunk_text(r.notes, tokenizer, size, overlap, window=window)
        out += [(r.patient_id, k, len(chunks), c) for k, c in enumerate(chunks)]
    return sorted(out, key=str)


def made(rows, size, overlap, window, tokenizer=notes.PieceTokenizer):
    return sorted((tuple(r) for r in longnotes.chunk_patients(rows, size, overlap, tokenizer, window=window).collect()), key=str)


@pytest.mark.parametrize("size, overlap, window", [(50, 5, 20), (7, 2, 30), (2500, 200, 500), (10**6, 200, 500), (1, 0, 1)])
def test_as_from_whole_texts(spark, size, overlap, window):
    rows = some_notes(spark)
    assert made(rows, size, overlap, window) == by_hand(rows, notes.PieceTokenizer(), size, overlap, window)


def test_with_a_vocabulary(spark):
    rows = some_notes(spark, spaced=False)
    load = functools.partial(notes.FileTokenizer, VOCABULARY)
    assert made(rows, 60, 7, 20, load) == by_hand(rows, load(), 60, 7, 20)


def test_a_patient_with_a_thousand_times_the_notes(spark):
    few = spark.range(6).select(F.lit("p").alias("patient_id"), F.format_string("note %d says so and so", "id").alias("text"), F.col("id").alias("row_no"))
    many = few.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(999)))).withColumn("row_no", F.col("copy") * 6 + F.col("row_no"))
    assert made(many, 400, 20, 30) == by_hand(many, notes.PieceTokenizer(), 400, 20, 30)
    # the patient's notes are dealt to several parts, and no value is larger than a chunk
    longest = longnotes.chunk_patients(many, 400, 20).agg(F.max(F.length("chunk_text"))).first()[0]
    assert longest < 400 * 8


def test_no_notes_and_other_names(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert made(none, 10, 1, 5) == []
    other = spark.createDataFrame([(7, "a note of some words", "kept out")], "key long, body string, chunk string")
    got = longnotes.chunk_patients(other, 4, 0, pid="key", text="body")
    assert [tuple(r) for r in got.orderBy("chunk_index").collect()] == [("7", 0, 3, "--- unknown |  ---"), ("7", 1, 3, "\na note of some"), ("7", 2, 3, " words")] and got.columns[0] == "key"
