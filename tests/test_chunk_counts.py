"""Counts of chunks on odd documents: against the query's SQL, and against the chunks that are cut."""

from collections import Counter

import duckdb
import pytest

from medloom import queries
from medloom.operators import notes

WORDS = " ".join("w" * 300)


def words(n):
    return WORDS[: max(2 * n - 1, 0)]


#: Around a border of chunks, so that one word more or less shows.
ODD = {
    "null and without words": [(1, None), (2, ""), (3, " \n\t ")],
    "white space at the ends": [(1, words(100) + " "), (2, words(190) + "\n\n"), (3, "\n " + words(100)), (4, words(101) + " ")],
    "markers of notes": [(1, words(60) + "\n--- note\n" + words(118)), (2, "\n--- a" * 200)],
    "repeated and null ids": [(1, words(300)), (1, words(5)), (1, words(5)), (None, words(200)), (None, None), (None, words(200))],
    "white space beyond ASCII": [(ord(c), c.join("w" * 150)) for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"],
    "borders": [(n, words(n)) for n in (1, 99, 100, 101, 189, 190, 191, 279, 280, 281)],
}


@pytest.mark.parametrize("rows", ODD.values(), ids=ODD)
def test_query_equals_sql(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = Counter(tuple(r) for r in queries.QUERIES["chunk_counts"](spark, str(tmp_path)).collect())
    assert got == Counter(con.sql(queries.ORACLES["chunk_counts"]).fetchall())


@pytest.mark.parametrize("tokenizer", [notes.PieceTokenizer, notes.WordTokenizer])
def test_counts_are_of_the_chunks_cut(spark, tokenizer):
    texts = {"a": "v " * 30 + "\n--- note\n" + "w " * 45, "b": "one", "c": " x\n" * 60, "d": "\n--- a" * 40}
    want = {k: len(notes.chunk_text(t, tokenizer(), 20, 3, window=8)) for k, t in texts.items()}
    rows = spark.createDataFrame(list(texts.items()), "patient_id string, notes string")
    assert {r.patient_id: r.n_chunks for r in notes.count_chunks(rows, 20, 3, tokenizer, window=8).collect()} == want
    assert want["a"] > 4


def test_words_keep_all_white_space():
    ends = notes.WordTokenizer().ends
    assert ends(" a  b\n") == [2, 6] and ends("a\xa0b c") == [3, 5] and ends("") == ends(" \n") == []
