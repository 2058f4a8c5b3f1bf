"""Alignment of two tokenizers' tokens over a corpus, by distinct segments.

A text (with the space that one vocabulary puts before it) is split before runs of spaces that follow visible
characters.  There neither vocabulary can merge: no token of either holds a visible character before a space.
``Tokenizers`` verifies that over both vocabularies when it is made, and a character behind which some token goes on
with a space never ends a segment.  So the tokens of a text are those of its segments, and so are groups
and links, which never cross a place where both tokens end.

1. Documents are coded in blocks of bounded size: a block has a dictionary of its distinct segments, documents are
   lists of places in it.  One narrow pass writes both.
2. The dictionaries' segments meet once: each distinct one is tokenised and aligned, and keeps the places it came from.
3. An id pair's count is the sum over segments of occurrences times links, pre-aggregated before the shuffle.  Documents with a
   segment whose tokens do not spell it have no tokens, so their occurrences are taken off.
4. Each segment's sums over its links go back with its groups to its places; a task composes the documents of a block from
   the block's dictionary.

A segment that every text holds is one row for each block; no row per occurrence is ever shuffled.  A block ends at
``BLOCK`` characters or with the document that passes it, so a very long text is a block by itself.

Null and empty texts, and texts whose tokens of either kind do not spell them (such as those with U+2581), have zeros and an
empty string.  Repeated rows are documents each; further columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.llm.bpe import byte_characters
from medloom.llm.common import texts_of, written

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Characters of a block's documents, segments tokenised at once, id pairs that are broadcast at most, codes hashed at once.
BLOCK, BATCH, PAIRS, SLICE = 24 << 20, 4096, 400_000, 65_536
#: A run of spaces behind something visible, unless the text ends with white space alone.
_CUT = re.compile(r"(?<=\S)(?= )(?=\s*\S)")
#: White space other than single blanks: split with the pattern.
_ODD = re.compile(r"  |[^\S ] | [^\S ]|\s$|[\x1c-\x1f\x85]")
_SPACE = "▁"
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _last_character(raw: bytes) -> bytes:
    at = len(raw) - 1
    while at and raw[at] & 0xC0 == 0x80:
        at -= 1
    return raw[at:]


class Tokenizers:
    """Both vocabularies: ids and token bytes of segments, and where segments may end."""

    def __init__(self, a: str = BYTES, b: str = PIECES):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_file(a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        byte = {c: i for i, c in enumerate(byte_characters())}
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        words = self.a.get_vocab()
        self.a_bytes = [b""] * (max(words.values()) + 1)
        for token, i in words.items():
            self.a_bytes[i] = token.encode() if token in added else bytes(map(byte.__getitem__, token))
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_lengths, self.b_lengths = (np.array([len(t) for t in table]) for table in (self.a_bytes, self.b_bytes))
        #: The characters (or their last bytes) after which some token goes on with a space, so that a merge could cross.
        tails = {_last_character(t[:at]) for t in (*self.a_bytes, *self.b_bytes) for at in range(1, len(t)) if t[at] == 32 and t[at - 1] != 32}
        self.joined = tuple(sorted(t for t in tails if t.decode("utf-8", "replace").strip()))  # no segment ends in white space
        with open(a, encoding="utf-8") as file:
            splitter = json.load(file)["pre_tokenizer"]
        # segments begin with the space that the second vocabulary adds itself
        probe = self.b.encode("a  b", out_type=str)
        if not (splitter["type"] == "ByteLevel" and splitter.get("use_regex", True) and "".join(probe) == f"{_SPACE}a{_SPACE}{_SPACE}b"):
            raise ValueError("segments need a byte-level vocabulary and one that adds a space and keeps others")

    def segments(self, text: str) -> list[str]:
        """The text with a space before it, cut where neither vocabulary can merge across."""
        if not _ODD.search(text) and not text.startswith(" "):
            found = [" " + w for w in text.split(" ")]
        else:
            found = _CUT.split(" " + text)
        if not self.joined:
            return found
        out = found[:1]
        for s in found[1:]:
            if out[-1].encode().endswith(self.joined):
                out[-1] += s
            else:
                out.append(s)
        return out

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both kinds; the text begins with a space."""
        return self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])

    def aligned(self, segments: list[str]) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of segments: how many, their groups, numbers of first ids and of links, and the links' id pairs.

        A run is tokenised as one text, as nothing merges across its cuts; where tokens do not spell a run it is halved,
        and a segment that they do not spell has none.
        """
        lonely = [k for k, s in enumerate(segments) if self.joined or s[-1].isspace()]
        begin = 0
        for k in (*lonely, len(segments)):
            if begin < k:
                yield from self._run(segments[begin:k])
            if k < len(segments):
                yield from self._run(segments[k : k + 1])
            begin = k + 1

    def _run(self, segments: list[str]) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray, np.ndarray]]:
        text = "".join(segments)
        a, b = self.tokens(text)
        raw = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw:
            lengths = np.fromiter((len(s) for s in segments) if text.isascii() else (len(s.encode()) for s in segments), np.int64, len(segments))
            yield len(segments), *groups_and_links(np.array(a), np.array(b), self.a_lengths, self.b_lengths, np.cumsum(lengths))
        elif len(segments) > 1:
            middle = len(segments) // 2
            yield from self._run(segments[:middle])
            yield from self._run(segments[middle:])
        else:
            none = np.zeros(1, np.int64)
            yield 1, [""], none, none, none[:0]


def groups_and_links(a: np.ndarray, b: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of segments that end at the byte offsets ``ends``: groups as text, numbers of first ids and of links, and all links (first id << 32 | second id).

    Both kinds of tokens divide the same bytes.  Each stretch between two neighbouring ends of either kind is where just one token of
    each kind overlaps, and each overlap is one stretch; where both kinds end a group does.
    """
    ends_a, ends_b = np.cumsum(a_lengths[a]), np.cumsum(b_lengths[b])
    stretches = np.union1d(ends_a, ends_b)
    of_a, of_b = np.searchsorted(ends_a, stretches), np.searchsorted(ends_b, stretches)
    closes_a, closes_b = ends_a[of_a] == stretches, ends_b[of_b] == stretches
    names_a, names_b = a[of_a].tolist(), b[of_b].tolist()
    texts, held, first, second = [], [], [], []
    border = set(ends.tolist())
    for x, y, ends_x, ends_y, at in zip(names_a, names_b, closes_a.tolist(), closes_b.tolist(), stretches.tolist(), strict=True):
        if ends_x:
            first.append(str(x))
        if ends_y:
            second.append(str(y))
            if ends_x:
                held.append(",".join(first) + "|" + ",".join(second))
                first, second = [], []
                if at in border:
                    texts.append(";".join(held))
                    held = []
    n_links = np.diff(np.searchsorted(stretches, ends, "right"), prepend=0)
    return texts, np.diff(np.searchsorted(ends_a, ends, "right"), prepend=0), n_links, a[of_a].astype(np.int64) << 32 | b[of_b]


def coded(docs: DataFrame, a: str = BYTES, b: str = PIECES) -> DataFrame:
    """Rows of documents (block, doc_id, codes; code is null) and of dictionaries (block, code, segment, n)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, no, held = Tokenizers(a, b), TaskContext.get().partitionId() << 32, 0
        places: dict[str, int] = {}
        uses = array("q")

        def batch_of(**columns: pa.Array) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            kinds = {"block": pa.int64(), "doc_id": ids.type, "codes": pa.binary(), "code": pa.int32(), "segment": pa.string(), "n": pa.int64()}
            columns["block"] = pa.array(np.full(n, no))
            return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in kinds.items()], list(kinds))

        def dictionary() -> Iterator[pa.RecordBatch]:
            words = list(places)
            for at in range(0, len(words), BATCH):
                some = words[at : at + BATCH]
                yield batch_of(code=pa.array(np.arange(at, at + len(some), dtype=np.int32)), segment=pa.array(some, pa.string()), n=pa.array(uses[at : at + len(some)], pa.int64()))

        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for part in texts_of(batch, "text"):
                lists = []
                for text in part:
                    codes = array("i")
                    if text:
                        held += len(text)
                        for s, k in Counter(found := cutter.segments(text)).items():
                            if s in places:
                                uses[places[s]] += k
                            else:
                                places[s] = len(uses)
                                uses.append(k)
                        codes.extend(map(places.__getitem__, found))
                    lists.append(_packed(codes))
                yield batch_of(doc_id=ids.slice(at, len(part)), codes=pa.array(lists, pa.binary()))
                at += len(part)
                if held >= BLOCK:
                    yield from dictionary()
                    places, uses, held, no = {}, array("q"), 0, no + 1
        yield from dictionary() if places else ()

    return docs.select("doc_id", "text").mapInArrow(run, f"block long, doc_id {id_type}, codes binary, code int, segment string, n long")


def aligned(words: DataFrame, a: str = BYTES, b: str = PIECES) -> DataFrame:
    """segment, n, groups, n_a, links (id pairs), blocks, codes of distinct segments; no groups where tokens do not spell one.

    ``blocks`` and ``codes`` are where dictionaries hold it, ``n`` how often these blocks use it.  Rows of one segment lie side by side in one task,
    which reads them as a stream and tokenises it once; one with more places than a batch holds has several rows, whose ``n`` add up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, last = Tokenizers(a, b), pa.table({})
        for batch in batches:
            column = batch.column("segment")
            starts = np.concatenate([[0], 1 + np.flatnonzero(pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)), [batch.num_rows]]).astype(np.int32)
            distinct, found = column.take(pa.array(starts[:-1])), []
            if last.num_rows and last["segment"][0] == distinct[0]:  # goes on from the batch before
                found, distinct = [last.drop_columns("segment")], distinct[1:]
            for part in texts_of(pa.RecordBatch.from_arrays([distinct], ["segment"]), "segment", BATCH):
                for n, groups, n_a, n_links, links in both.aligned(part):
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32)), pa.array(links))
                    found.append(pa.table({"groups": pa.array(groups, pa.string()), "n_a": pa.array(n_a.astype(np.int32)), "links": lists}))
            out = pa.concat_tables(found).combine_chunks()
            out = out.add_column(0, "segment", column.take(pa.array(starts[:-1])))
            last = out.slice(out.num_rows - 1)
            uses = np.add.reduceat(batch.column("n").to_numpy(), starts[:-1])
            out = out.add_column(1, "n", pa.array(uses))
            for name in ("blocks", "codes"):
                out = out.append_column(name, pa.ListArray.from_arrays(pa.array(starts), batch.column(name[:-1])))
            yield from out.to_batches()

    # a segment's rows are as many as blocks that hold it
    placed = words.select("segment", "block", "code", "n").repartition("segment").sortWithinPartitions("segment")
    return placed.mapInArrow(run, "segment string, n long, groups string, n_a int, links array<long>, blocks array<long>, codes array<int>")


def _packed(codes: array) -> bytes:
    """Codes by planes of bytes, compressed: most of them are small."""
    return zstandard.compress(np.frombuffer(codes, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _codes(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    for c in column:
        planes = np.frombuffer(zstandard.decompress(c.as_buffer()), np.uint8)
        yield np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


def _wrong_uses(table: DataFrame, found: DataFrame) -> DataFrame:
    """n, links of segments: how often they occur in documents that hold a segment without groups, below zero.

    Only blocks that have such a segment are read again.
    """
    places = found.where("groups = ''").select(F.explode(F.arrays_zip("blocks", "codes")).alias("p")).select(F.col("p.blocks").alias("block"), F.col("p.codes").alias("code"))
    bad = places.groupBy("block").agg(F.collect_set("code").alias("bad"))  # within a block's dictionary
    docs = table.where(F.col("code").isNull()).select("block", "codes").join(bad, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, codes, bad in zip(batch.column("block").to_pylist(), _codes(batch.column("codes")), batch.column("bad").to_pylist(), strict=True):
                if np.isin(codes, bad).any():
                    code, n = np.unique(codes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), block)), pa.array(code), pa.array(n.astype(np.int64))], ["block", "code", "n"])

    uses = docs.mapInArrow(run, "block long, code int, n long").groupBy("block", "code").agg(F.sum("n").alias("n"))
    words = table.where(F.col("code").isNotNull()).select("block", "code", "segment")
    less = uses.join(words, ["block", "code"]).groupBy("segment").agg((-F.sum("n")).alias("n"))
    return less.join(found.select("segment", "links").dropDuplicates(["segment"]), "segment").select("n", "links")


def pair_counts(uses: DataFrame) -> DataFrame:
    """pair, count, best (whether no pair of the same second id has more) over n times links of ``uses``."""
    links = uses.select("n", F.explode("links").alias("pair"))
    counts = written(links.groupBy("pair").agg(F.sum("n").alias("count")).where("count > 0"), "pairs")
    most = counts.groupBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")).agg(F.max("count").alias("most"))  # a row per second id
    return counts.join(most, F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)) == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def with_sums(found: DataFrame, counts: DataFrame) -> DataFrame:
    """blocks, codes, groups, n_a, n_best, count_sum of every row of ``found``.

    Up to ``PAIRS`` counts (24 bytes each) are handed to all tasks, so that no row moves; more are joined by shuffling, where the
    engine splits pairs that many segments have.
    """
    columns = ["blocks", "codes", "groups", "n_a"]
    if counts.count() > PAIRS:
        rows = written(found.withColumn("row", F.monotonically_increasing_id()), "rows")
        links = rows.select("row", F.explode("links").alias("pair")).join(counts, "pair")
        sums = links.groupBy("row").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
        return rows.join(sums, "row", "left").select(*columns, "n_best", "count_sum").fillna(0, ["n_best", "count_sum"])
    table = counts.toArrow()
    order = np.argsort(pairs := table["pair"].to_numpy(), kind="stable")
    handed = found.sparkSession.sparkContext.broadcast((pairs[order], table["count"].to_numpy()[order], table["best"].to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, count, best = handed.value
        for batch in batches:
            lists = batch.column("links")
            links, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            at = np.minimum(np.searchsorted(pairs, links), max(len(pairs) - 1, 0))
            known = pairs[at] == links if len(pairs) else np.zeros(len(links), bool)  # pairs of unspelled documents alone have no count
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (np.where(known, best[at], False).astype(np.int64), np.where(known, count[at], 0))] if len(pairs) else [np.zeros(len(lists), np.int64)] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *map(pa.array, sums)], [*columns, "n_best", "count_sum"])

    return found.select(*columns, "links").mapInArrow(run, "blocks array<long>, codes array<int>, groups string, n_a int, n_best long, count_sum long")


def _compose(docs: pa.Table, words: pa.Table) -> pa.Table:
    """The documents of a block from the block's dictionary."""
    words = words.take(pc.sort_indices(words.column("code")))  # a code is its place
    n_a, texts = words.column("n_a").to_numpy().astype(np.int64), words.column("groups")
    right = pc.binary_length(texts).to_numpy() > 0
    n_groups = np.where(right, pc.count_substring(texts, "|").to_numpy().astype(np.int64), 0)
    n_b = pc.count_substring(texts, ",").to_numpy() + 2 * n_groups - n_a
    # ends of either kind, less those that both share
    measures = np.array([n_a, n_b, n_groups, n_a + n_b - n_groups, *(words.column(m).to_numpy() for m in MEASURES[4:])])
    groups = texts.to_pylist()
    rows, digests = np.zeros((len(MEASURES), docs.num_rows), np.int64), []
    for k, codes in enumerate(_codes(docs.column("codes"))):
        digest = ""
        if len(codes) and right[codes].all():
            rows[:, k] = measures[:, codes].sum(axis=1)
            text = hashlib.sha256()
            for at in range(0, len(codes), SLICE):
                text.update(((";" if at else "") + ";".join(map(groups.__getitem__, codes[at : at + SLICE].tolist()))).encode())
            digest = text.hexdigest()
        digests.append(digest)
    return pa.Table.from_arrays([docs.column("doc_id"), *map(pa.array, rows), pa.array(digests, pa.string())], ["doc_id", *MEASURES, "groups_sha256"])


def align(docs: DataFrame, a: str = BYTES, b: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    table = written(coded(docs, a, b), "coded")
    found = written(aligned(table.where(F.col("code").isNotNull()), a, b), "aligned")
    uses = found.select("n", "links")
    if not found.where("groups = ''").isEmpty():
        uses = uses.unionByName(_wrong_uses(table, found))
    measured = with_sums(found, written(pair_counts(uses), "counts"))
    dictionary = measured.withColumn("p", F.explode(F.arrays_zip("blocks", "codes"))).select(F.col("p.blocks").alias("in_block"), F.col("p.codes").alias("code"), "groups", "n_a", "n_best", "count_sum")
    rows = table.where(F.col("code").isNull()).select("block", "doc_id", "codes")
    schema = f"doc_id {id_type}, " + ", ".join(f"{m} long" for m in MEASURES) + ", groups_sha256 string"
    return rows.groupBy("block").cogroup(dictionary.groupBy("in_block")).applyInArrow(_compose, schema)
