"""Shortest-pack-first packing over the histogram of lengths.

Documents are tokenised and cut into pieces of at most ``width`` ids.  Only the histogram of piece
lengths (at most ``width`` rows) reaches the driver, where lengths are placed longest first into the
pack with the most room left; whole groups of equal packs are handled as one pattern with a count.
Each pattern gets a run of sequence numbers, each of its slots a run of ranks within the slot's
length, and pieces, numbered within their length, are joined with the slots by rank.  A piece's
number comes from its place in its partition plus a prefix sum over the partitions' counts, so no
length, however common, is sorted or numbered by one task.

Null texts are empty documents (their only id is the end mark).  An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medloom.llm.common import texts_of, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary, for the second library.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Chunks of text whose ids a task remembers.
REMEMBERED = 300_000
#: A space between two visible ASCII characters begins a new pre-token whatever else the text holds.
_CUT = re.compile(r"(?<=[!-~])(?= [!-~])")
#: White space other than single blanks and line feeds between visible characters.
_ONE = frozenset(" ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_ODD = re.compile(r"[^\S \n]|[\x1c-\x1f]")


class ChunkTokenizer:
    """The tokenizer's ids of a whole text, chunk by chunk.

    The pre-tokenizer never joins a visible character with a following space, so a text falls into
    chunks that are encoded on their own; ids of recent chunks are remembered, for most recur.  New
    chunks in Latin letters take the same vocabulary's ranks in a second library, which encodes short
    strings several times as fast and gives the same ids (tested); all other chunks, and texts that
    hold a special token's string, go through the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None = RANKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.quick = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            # its core skips checks of the public call; a version without it only costs time
            core = getattr(encoding, "_core_bpe", encoding)
            self.quick = core.encode_ordinary
            self.piece = getattr(core, "encode_single_piece", None) or (lambda raw: encoding.encode_ordinary(raw.decode()))

    def _slow(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _new(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if not self.quick or not chunk.isascii() and max(chunk) >= "\u0250":
            return self._slow(chunk)
        if chunk[0] in _ONE and (len(chunk) == 1 or chunk[1:].isalpha()):  # a single pre-token
            return array("I", self.piece(chunk.encode())).tobytes()
        return array("I", self.quick(chunk)).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if "<|" in text and any(s in text for s in self.special):
            return self._slow(text)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        if "  " in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace() or _ODD.search(text):
            first, *chunks = _CUT.split(text)
        else:  # every blank begins a chunk
            first, *chunks = text.replace(" ", "\0 ").split("\0") if "\0" not in text else _CUT.split(text)
        for new in {c for c in chunks if c not in known}:
            known[new] = self._new(new)
        return b"".join([self._new(first), *map(known.__getitem__, chunks)])


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, width: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece, with its partition and its number there within its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunker, seen = TaskContext.get().partitionId(), ChunkTokenizer(tokenizer, RANKS if tokenizer == TOKENIZER else None), np.zeros(width + 1, np.int64)
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out, at = [], 0
            ids = batch.column("doc_id").to_pylist()
            for texts in texts_of(batch, "text"):
                for text in texts:
                    raw = chunker.encode(text) + last
                    n = len(raw) // 4
                    for start in range(0, n, width):
                        piece = raw[4 * start : 4 * (start + width)]
                        length = len(piece) // 4
                        out.append((ids[at], start, length, zlib.crc32(piece), n, part, int(seen[length])))
                        seen[length] += 1
                    at += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.int32(), pa.int64()], strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "no"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, no long")


def shortest_pack_first(histogram: dict[int, int], width: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in order, count of packs) for the histogram {length: count}."""
    room: dict[int, list[tuple[list[int], int]]] = {}
    done: list[tuple[list[int], int]] = []

    def put(pattern: list[int], count: int, left: int) -> None:
        if left:
            room.setdefault(left, []).append((pattern, count))
        else:
            done.append((pattern, count))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            widest = max(room, default=0)
            if widest < length:
                put([length], n, width - length)
                break
            pattern, count = room[widest].pop()
            if not room[widest]:
                del room[widest]
            # as many of this length as fill the packs alike
            each = max(1, min(n // count, (widest - _next(room)) // length, widest // length)) if n >= count else 1
            used = min(count, n)
            if used < count:
                put(pattern, count - used, widest)
            put(pattern + [length] * each, used, widest - each * length)
            n -= used * each
    return done + [x for xs in room.values() for x in xs]


def _next(room: dict[int, list]) -> int:
    return max(room, default=0)


def slots(spark: SparkSession, patterns: list[tuple[list[int], int]]) -> DataFrame:
    """(length, first rank, end rank, first sequence, offset) of every slot of every pattern."""
    rows, ranks, sequence = [], {}, 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = ranks.get(length, 0)
            rows.append((length, rank, rank + count, sequence, offset))
            ranks[length] = rank + count
            offset += length
        sequence += count
    return spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "slot_length long, rank_from long, rank_to long, first_sequence long, offset long")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, width: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    found = written(pieces(docs, tokenizer, width, end_id), "pieces")
    counts = found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # at most one row per length: bounded by the width
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # bounded by the width too: a pattern holds at most that many slots, and each step adds one pattern
    plan = slots(docs.sparkSession, shortest_pack_first(histogram, width))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    ranked = found.join(starts, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).withColumn("rank", F.col("no") + F.col("ahead"))
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")
