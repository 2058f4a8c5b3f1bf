"""Chunks of patients whose notes are too many for one task.

The same chunks as ``chunk_notes(concatenate(...))`` gives, but no task ever holds a patient's text.
Notes are dealt out by range in their order and tokenised one by one; a note's place among its
patient's tokens is a segmented prefix sum: what came before in its part, plus the sums of the parts
before.  Borders of chunks follow from numbers alone (tokens, and where markers lie); each chunk then
collects the pieces of notes that lie inside.

What one task does for one patient is to read two numbers for each marker, one after the other, as each chunk begins
where the one before has ended.  Memory stays constant there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from medloom.operators.notes import MARKER, PieceTokenizer, Tokenizer, entries
from medloom.session import settled

#: Tokens of a piece of a note, the unit that is moved to chunks.
PIECE = 1024
#: Chunks' sizes in a stretch: pieces are dealt to tasks by patient and stretch.
STRETCH = 8
BETWEEN = "\n\n"
_HEAD = "--- "
#: Rows of numbers given back at a time.
ROWS = 10_000
_PIECES = "key string, part int, i long, at long, n int, text string, lengths binary, first boolean, tail_n int, head int, marks array<struct<s: long, e: long>>"


def _packed(lengths: np.ndarray) -> bytes:
    """A byte for each token, or four where one is too long for that."""
    return lengths.astype(np.uint8 if lengths.max() < 256 else np.uint32).tobytes()


def _begins(packed: bytes, n: int) -> np.ndarray:
    """Where the tokens of a piece begin, and where the last one ends."""
    lengths = np.frombuffer(packed, np.uint8 if len(packed) == n else np.uint32)
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _gap(tokenizer: Tokenizer) -> list[int]:
    """Where the tokens end that white space between notes has for itself (none, if it belongs to the token behind it)."""
    ends = [e for e in tokenizer.ends(BETWEEN + _HEAD.strip()) if e <= len(BETWEEN)]
    return [*ends[:-1], len(BETWEEN)] if ends else []


def _pieces(tokenizer: Callable[[], Tokenizer], most: int) -> Callable[[str, str], list[tuple]]:
    """A note as pieces of at most so many tokens; ``at`` counts the patient's tokens before them in this part, whose sorted notes a task takes one by one.

    White space behind a note's last token stays with the text, but belongs to the token that follows.
    """
    made: list[Tokenizer] = []
    last, i, at = None, 0, 0

    def run(key: str, entry: str) -> list[tuple]:
        nonlocal last, i, at
        if not made:  # once in each task
            made.append(tokenizer())
        if key != last:
            last, i, at = key, 0, 0
        one, part, out = made[0], TaskContext.get().partitionId(), []
        ends = np.maximum.accumulate(np.asarray(one.ends(entry.rstrip()), dtype=np.int64))
        found = np.array([m.start() for m in re.finditer(re.escape(MARKER), entry)], dtype=np.int64)
        begun = at + np.searchsorted(ends, found, "right")
        inside = at + np.searchsorted(ends, found + len(MARKER), "left")
        marks = list(zip(begun.tolist(), inside.tolist(), strict=True))
        head = int(np.searchsorted(ends, len(_HEAD), "left"))
        begins = np.concatenate([[0], ends])
        lengths = np.diff(begins)
        for a in range(0, len(ends), most):
            b = min(a + most, len(ends))
            whole = b == len(ends)
            text = entry[begins[a] :] if whole else entry[begins[a] : begins[b]]
            tail = len(one.ends(entry[begins[b] :])) if whole and begins[b] < len(entry) else 0
            out.append((key, part, i, at + a, b - a, text, _packed(lengths[a:b]), a == 0, tail, head, marks if a == 0 else []))
        i, at = i + 1, at + len(ends)
        return out

    return run


def _borders(size: int, overlap: int, window: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(key, chunk, first, stop) from each key's number of tokens (a row with e = -1, ahead of the others) and its markers in order.

    ``s`` is the token that a marker begins, ``e`` the one it ends in.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        key, total, first, stop, mark, no = None, 0, 0, 0, -1, 0

        def cut() -> None:
            """One more chunk; none are left once one ends with the text."""
            nonlocal first, stop, no
            end = mark if stop < total and mark >= max(first, stop - window) else stop
            out.append((key, no, first, end))
            no += 1
            first = max(first + 1, end - overlap)
            stop = min(first + size, total) if end < total else -1

        def given() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=["key", "chunk", "first", "stop"])
            out.clear()
            return made

        for frame in frames:
            for k, s, e in zip(frame.key, frame.s.tolist(), frame.e.tolist(), strict=True):
                if e < 0:
                    while stop > 0:
                        cut()
                        if len(out) >= ROWS:
                            yield given()
                    key, total, first, stop, mark, no = k, s, 0, min(size, s), -1, 0
                    continue
                while 0 < stop <= e:
                    cut()
                    if len(out) >= ROWS:
                        yield given()
                mark = s
        while stop > 0:
            cut()
            if len(out) >= ROWS:
                yield given()
        yield given()

    return run


def _texts(gap: list[int]) -> Callable[[list[Row], int, int], str]:
    """A chunk's text from the pieces that it touches, in order: tokens inside, white space before a note, and white space behind the note before."""
    steps = [0, *gap]

    def part_of(place: int, n: int, between: bool, lengths: bytes, text: str, first: int, stop: int) -> str:
        begins = _begins(lengths, n)
        inside = lambda t: min(max(t - place, 0), n)
        taken = text[begins[inside(first)] : begins[inside(stop)]]
        if between and not gap:
            taken = (BETWEEN if first <= place < stop else "") + taken
        elif between:
            a, b = (min(max(t - (place - len(gap)), 0), len(gap)) for t in (first, stop))
            taken = BETWEEN[steps[a] : steps[b]] + taken
        return taken + (text[begins[n] :] if first <= place + n < stop else "")

    return lambda held, first, stop: "".join(part_of(*p, first, stop) for p in sorted(held, key=lambda p: p[0]))


def chunk_patients(
    notes: DataFrame,
    size: int = 40_000,
    overlap: int = 200,
    tokenizer: Callable[[], Tokenizer] = PieceTokenizer,
    pid: str = "patient_id",
    text: str = "text",
    date: str = "date",
    kind: str = "note_type",
    window: int = 500,
) -> DataFrame:
    """(patient, chunk_index, total_chunks, chunk_text) of each patient's notes in order, under headers.

    Short and null texts are left out, as ``concatenate`` does; a null patient is a patient like others; a note that is
    repeated counts each time.  Tokens do not reach across the beginning of a note.
    """
    # a null key would be lost in joins
    keyed = F.when(F.col(pid).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(pid).cast("string"))).alias("key")
    rows = entries(notes, text, date, kind, keyed)
    order = [c for c in rows.columns if c != "entry"]
    # a prefix of the entry keeps the order and shares out a patient without dates and places
    dealt = rows.repartitionByRange(*order, F.substring("entry", 1, 64)).sortWithinPartitions(*order, "entry")
    # Python takes pickled rows, 100 at a time: 10,000 notes of an Arrow batch have no bound in bytes.  Not deterministic, as it counts along the part
    cut = F.udf(_pieces(tokenizer, min(size, PIECE)), f"array<struct<{_PIECES}>>", useArrow=False).asNondeterministic()
    pieces = settled(dealt.select(cut("key", "entry").alias("pieces")).select(F.inline("pieces")))
    gap = _gap(tokenizer())

    # one row for each part that a patient has notes in
    sums = pieces.groupBy("key", "part").agg(F.sum("n").alias("tokens"), F.sum(F.col("first").cast("long")).alias("notes"), F.max_by("tail_n", F.struct("i", "at")).alias("tail_n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("key", "part", *[F.sum(c).over(before).alias(f"{c}_ahead") for c in ("tokens", "notes")]).where("notes_ahead IS NOT NULL")
    totals = sums.groupBy("key").agg((F.sum("tokens") + len(gap) * (F.sum("notes") - 1) + F.max_by("tail_n", "part")).alias("s"))

    # parts follow each other in the order of patients, so at most one patient of a part goes on from an earlier one:
    # no more rows than parts are broadcast
    placed = pieces.join(F.broadcast(ahead), ["key", "part"], "left").fillna(0, ["tokens_ahead", "notes_ahead"])
    nth = F.col("notes_ahead") + F.col("i")
    shift = F.col("tokens_ahead") + len(gap) * nth  # from tokens of the part to tokens of the patient
    between = F.col("first") & (nth > 0)
    placed = placed.select("key", "text", "lengths", "n", "first", "head", "marks", shift.alias("shift"), (F.col("at") + shift).alias("place"), between.alias("between"))

    own = F.struct((F.col("place") - len(gap) + sum(g <= 1 for g in gap)).alias("s"), (F.col("place") + F.col("head")).alias("e"))
    inner = F.transform("marks", lambda m: F.struct((m["s"] + F.col("shift")).alias("s"), (m["e"] + F.col("shift")).alias("e")))
    marks = placed.where("first").select("key", F.explode(F.concat(F.when(F.col("between"), F.array(own)).otherwise(F.array()), inner)).alias("m")).select("key", "m.s", "m.e")
    items = totals.select("key", "s", F.lit(-1).cast("long").alias("e")).unionByName(marks)
    borders = settled(items.repartition("key").sortWithinPartitions("key", "e", "s").mapInPandas(_borders(size, overlap, window), "key string, chunk int, first long, stop long"))
    numbered = borders.join(borders.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("total")), "key")

    # texts move once: to the stretch of tokens that their chunk begins in, and to the one before if a chunk may reach over
    stretch = lambda at: F.floor(at / F.lit(STRETCH * size).cast("long"))
    low = F.col("place") - F.when(F.col("between"), len(gap)).otherwise(0)
    high = F.col("place") + F.col("n") + 1
    dealt = placed.select("key", low.alias("low"), high.alias("high"), F.struct("place", "n", "between", "lengths", "text").alias("p"))
    dealt = dealt.withColumn("at", F.explode(F.sequence(stretch(F.greatest(F.col("low") - size, F.lit(0))), stretch(F.col("high") - 1))))
    reach = numbered.where("first < stop").withColumn("at", stretch(F.col("first")))
    met = dealt.join(reach, ["key", "at"]).where((F.col("low") < F.col("stop")) & (F.col("first") < F.col("high")))
    held = met.groupBy("key", "at", "chunk", "total", "first", "stop").agg(F.collect_list("p").alias("held"))
    # again 100 chunks at a time; after the grouping, as rows that come from Python would be shuffled for it
    whole = held.select("key", "chunk", "total", F.udf(_texts(gap), "string", useArrow=False)("held", "first", "stop").alias("chunk_text"))
    # a marker where a chunk begins leaves it empty
    whole = whole.unionByName(numbered.where("first = stop").select("key", "chunk", "total", F.lit("").alias("chunk_text")))
    patient = F.when(F.col("key") != "-", F.substring("key", 2, 2**31 - 1)).alias(pid)
    return whole.select(patient, F.col("chunk").alias("chunk_index"), F.col("total").alias("total_chunks"), "chunk_text")
