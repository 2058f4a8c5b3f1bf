"""Notes: consolidation of files, one text per patient, chunks by tokens."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.functions.dates import find_date_column, is_blank

MIN_NOTE_CHARS = 10
MARKER = "\n--- "


class Tokenizer(Protocol):
    def ends(self, text: str) -> Sequence[int]:
        """Where each token of the text ends, in characters."""


class PieceTokenizer:
    """Runs of visible characters with the white space before them; needs no vocabulary."""

    _PIECE = re.compile(r"\s*\S+|\s+$")

    def ends(self, text: str) -> Sequence[int]:
        return [m.end() for m in self._PIECE.finditer(text)]


class WordTokenizer:
    """Words between ASCII white space, as ``\\S+`` of SQL engines finds them; white space belongs to the word behind it, at the end to the last one."""

    _WORD = re.compile(r"[^\t\n\f\r ]+")

    def ends(self, text: str) -> Sequence[int]:
        ends = [m.end() for m in self._WORD.finditer(text)]
        if ends:
            ends[-1] = len(text)
        return ends


class FileTokenizer:
    """A tokenizer from a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Loaded

        self.loaded = Loaded.from_file(path)
        self.loaded.no_truncation()
        self.loaded.no_padding()

    def ends(self, text: str) -> Sequence[int]:
        return [end for _, end in self.loaded.encode(text, add_special_tokens=False).offsets]


def chunk_spans(text: str, tokenizer: Tokenizer, size: int = 40_000, overlap: int = 200, marker: str = MARKER, window: int = 500) -> Iterator[tuple[int, int]]:
    """Where the chunks of a text begin and end: at most ``size`` tokens each, cut at the last marker that
    lies within the last ``window`` of them, and begun ``overlap`` tokens before the end of the one before.

    Tokens and markers are found once; cuts are looked up by bisection.
    """
    ends = tokenizer.ends(text)
    begins = [0, *ends]  # of token k
    marks = [m.start() for m in re.finditer(re.escape(marker), text)]
    first, stop = 0, 0
    while stop < len(ends):
        stop = min(first + size, len(ends))
        if stop < len(ends):
            latest = bisect.bisect_right(marks, ends[stop - 1] - len(marker)) - 1
            if latest >= 0 and marks[latest] >= begins[max(first, stop - window)]:
                stop = bisect.bisect_right(ends, marks[latest])
        yield begins[first], begins[stop]
        first = max(first + 1, stop - overlap)


def chunk_text(text: str, tokenizer: Tokenizer, size: int = 40_000, overlap: int = 200, marker: str = MARKER, window: int = 500) -> list[str]:
    return [text[a:b] for a, b in chunk_spans(text, tokenizer, size, overlap, marker, window)]


def standard_notes(source: DataFrame, file_no: int, pid_column: str, pid: str = "patient_id", text: str = "text", date: str = "date", kind: str = "note_type") -> DataFrame | None:
    """One file's notes with standard names and their place; None if it lacks ids or texts.

    A source without the wanted date column uses the first alias that it has.
    """
    if pid_column != pid and pid_column in source.columns and pid not in source.columns:
        source = source.withColumnRenamed(pid_column, pid)
    if pid not in source.columns or text not in source.columns:
        return None
    found = find_date_column(source.columns, date)
    if found and found != date:
        source = source.withColumnRenamed(found, date)
    rows = source.withColumn(pid, F.col(pid).cast("string")).withColumn(text, F.col(text).cast("string"))
    if date in rows.columns:
        rows = rows.withColumn(date, F.col(date).cast("string"))
        rows = rows.withColumn(text, F.when(~is_blank(F.col(date)), F.concat(F.lit("Note date: "), F.col(date), F.lit("\n"), F.coalesce(text, F.lit("")))).otherwise(F.col(text)))
    if kind in rows.columns:
        rows = rows.withColumn(kind, F.col(kind).cast("string"))
    return rows.withColumn("file_no", F.lit(file_no)).withColumn("row_no", F.monotonically_increasing_id())


def consolidate(sources: Sequence[DataFrame], cohort_ids: DataFrame | None = None, pid: str = "patient_id") -> DataFrame:
    """All notes under the union of their columns, those of the cohort only (an empty cohort keeps none)."""
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows.join(cohort_ids.select(F.col(cohort_ids.columns[0]).cast("string").alias(pid)), pid, "left_semi") if cohort_ids is not None else rows


def sorted_notes(notes: DataFrame, pid: str = "patient_id", date: str = "date") -> DataFrame:
    """By patient, then date (nulls last), then place: a range sort, no single task."""
    order = [F.col(pid), *([F.col(date).asc_nulls_last()] if date in notes.columns else []), *[F.col(c) for c in ("file_no", "row_no") if c in notes.columns]]
    return notes.orderBy(*order)


def entries(notes: DataFrame, text: str, date: str, kind: str, key: Column) -> DataFrame:
    """Notes under their headers (``entry``) with the columns that order them; short and null texts are left out."""
    kinds = F.coalesce(F.col(kind).cast("string"), F.lit("unknown")) if kind in notes.columns else F.lit("unknown")
    dates = F.coalesce(F.col(date).cast("string"), F.lit("")) if date in notes.columns else F.lit("")
    place = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("file_no", "row_no") if c in notes.columns]
    entry = F.concat(F.lit("--- "), kinds, F.lit(" | "), dates, F.lit(" ---\n"), F.col(text))
    no_date = F.col(date).isNull() if date in notes.columns else F.lit(True)
    rows = notes.where(F.length(F.coalesce(F.col(text), F.lit("nan"))) >= MIN_NOTE_CHARS)
    return rows.select(key, no_date.alias("none"), dates.alias("date"), *place, entry.alias("entry"))


def concatenate(notes: DataFrame, pid: str = "patient_id", text: str = "text", date: str = "date", kind: str = "note_type") -> DataFrame:
    """(patient, notes): each patient's notes in order under headers; short and null texts are left out.

    A patient's whole text is one value here; ``longnotes.chunk_patients`` makes chunks without it.
    """
    rows = entries(notes, text, date, kind, F.col(pid).alias("key"))
    held = F.struct(*[c for c in rows.columns if c != "key"])
    grouped = rows.groupBy("key").agg(F.array_sort(F.collect_list(held)).alias("_all"))
    return grouped.select(F.col("key").alias(pid), F.array_join(F.transform("_all", lambda x: x["entry"]), "\n\n").alias("notes"))


def chunk_notes(texts: DataFrame, size: int = 40_000, overlap: int = 200, tokenizer: Callable[[], Tokenizer] | None = PieceTokenizer, pid: str = "patient_id", text: str = "notes") -> DataFrame:
    """(patient, chunk_index, total_chunks, chunk_text); without a tokenizer a text is one chunk.

    Texts go to Python in Spark's small batches of pickled rows (100), as 10,000 texts of an Arrow batch and their chunks have no bound in bytes.
    """
    patient = F.col(pid).cast("string").alias(pid)
    if not tokenizer:
        return texts.select(patient, F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), F.col(text).alias("chunk_text"))
    made: list[Tokenizer] = []

    def cut(whole: str | None) -> list[str]:
        if not made:  # once in each task
            made.append(tokenizer())
        return [] if whole is None else chunk_text(whole, made[0], size, overlap)

    # as if not deterministic: the filter that explode brings along would tokenise each text a second time
    chunks = F.udf(cut, "array<string>", useArrow=False).asNondeterministic()(text).alias("chunks")
    return texts.select(patient, chunks).select(pid, F.posexplode("chunks").alias("chunk_index", "chunk_text"), F.size("chunks").alias("total_chunks")).select(pid, "chunk_index", "total_chunks", "chunk_text")


def chunk_counts(chunks: DataFrame, pid: str = "patient_id") -> DataFrame:
    return chunks.groupBy(pid).agg((F.max("chunk_index") + 1).alias("n_chunks"))


def count_chunks(texts: DataFrame, size: int = 40_000, overlap: int = 200, tokenizer: Callable[[], Tokenizer] = PieceTokenizer, pid: str = "patient_id", text: str = "notes", window: int = 500) -> DataFrame:
    """(patient, n_chunks) for each text, even if a patient has several: chunks are counted where they are cut, so nothing is shuffled.

    A text without tokens counts as one chunk, a null text has no count.  ``window`` 0 cuts at no markers.
    """
    made: list[Tokenizer] = []

    def count(whole: str | None) -> int | None:
        if not made:  # once in each task
            made.append(tokenizer())
        return None if whole is None else max(1, sum(1 for _ in chunk_spans(whole, made[0], size, overlap, window=window)))

    return texts.select(F.col(pid).cast("string").alias(pid), F.udf(count, "int", useArrow=False)(text).alias("n_chunks"))
