"""Byte-level BPE by monoid tree reduction: halves are encoded on their own and joined at their boundary.

A text is halved down to leaves; each leaf is split into pre-tokens by the pattern and encoded, and
neighbours are joined up the tree.  The join is associative, so any tree gives the same ids.  It has two levels:

* Pre-tokens.  A match of the pattern depends on nothing before its start, and on what follows only
  through the run that it ends in and the character behind (a contraction needs two characters).  So all but the
  last ``UNSETTLED`` pre-tokens of the left half stay; the text behind them is split again until a boundary is
  one of the right half's own, and from there on the right half stays.
* Tokens within a pre-token (that two halves share, or that is halved itself because it is long).  Merges
  go by rank, and among equals by place.  Two facts follow, since the choices of a run over a string,
  restricted to a part that no merge has left yet, are the choices of a run over that part alone:
  (1) neighbours within an encoding encode to themselves as a pair; (2) a row of tokens each of whose neighbouring
  pairs encodes to itself is the encoding of its bytes (the first merge across a boundary would be made in the
  pair as well).  So a join encodes a window of some tokens on both sides of the boundary again; if the window's
  ends form stable pairs with the tokens outside, these provably stay, else the window doubles.

Decoding is the plain monoid: bytes of halves, concatenated up the tree.

Null texts are empty, repeated rows have a row each, further columns are left alone.  Beside the text and
its ids memory is bounded: pre-tokens and pairs that recur are remembered up to ``REMEMBERED``.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from medloom.llm.common import map_batches, texts_of

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Characters of a leaf, bytes of a pre-token that is not halved, tokens on each side of a window at first.
LEAF, SHORT, WINDOW = 512, 48, 2
#: Pre-tokens of a left half that what follows may change: a run that goes on, and a contraction's mark before one letter.
UNSETTLED = 2
REMEMBERED = 400_000
_NONE = 1 << 60


class Piece:
    """A half: the lengths of its pre-tokens in characters, and their ids (native unsigned 32-bit)."""

    __slots__ = ("ids", "lengths", "text")

    def __init__(self, text: str, lengths: list[int], ids: list[bytes]):
        self.text, self.lengths, self.ids = text, lengths, ids


class TreeBpe:
    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.split = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    # tokens of one pre-token

    def merge(self, raw: bytes) -> list[int]:
        """The ids of a string: the pair of least rank is merged first, the first among equals."""
        if len(raw) > 4 * SHORT:
            return self._merge_long(raw)
        get = self.ranks.get
        parts = [raw[i : i + 1] for i in range(len(raw))]
        found = [get(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while found and (best := min(found)) != _NONE:
            at = found.index(best)
            parts[at] += parts.pop(at + 1)
            del found[at]
            if at < len(found):
                found[at] = get(parts[at] + parts[at + 1], _NONE)
            if at:
                found[at - 1] = get(parts[at - 1] + parts[at], _NONE)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same with a heap, for windows that had to grow."""
        get, n = self.ranks.get, len(raw)
        ends, before = list(range(1, n + 1)), list(range(-1, n))  # of the part at each place; a part begins where one ends
        found = [get(raw[i : i + 2], _NONE) for i in range(n - 1)] + [_NONE]
        heap = [(r, i) for i, r in enumerate(found) if r != _NONE]
        heapify(heap)
        while heap:
            rank, at = heappop(heap)
            if found[at] != rank:  # made of parts that have changed since
                continue
            gone = ends[at]
            ends[at], found[gone] = ends[gone], _NONE
            before[ends[at]] = at
            for i in (at, before[at]):
                if i >= 0:
                    found[i] = get(raw[i : ends[ends[i]]], _NONE) if ends[i] < n else _NONE
                    if found[i] != _NONE:
                        heappush(heap, (found[i], i))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[raw[at : ends[at]]])
            at = ends[at]
        return out

    def stable(self, a: int, b: int) -> bool:
        """Whether two tokens side by side encode to themselves."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def join_ids(self, left: Sequence[int], right: Sequence[int]) -> array:
        """The encoding of both strings together, from their own encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return array("I", left) + array("I", right)
        size = WINDOW
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            inner = self.merge(self.decode_bytes(left[a:]) + self.decode_bytes(right[:b]))
            if (a == 0 or self.stable(left[a - 1], inner[0])) and (b == len(right) or self.stable(inner[-1], right[b])):
                return array("I", left[:a]) + array("I", inner) + array("I", right[b:])
            size *= 2

    def encode_bytes(self, raw: bytes) -> array:
        """The ids of one pre-token: halves, joined."""
        if len(raw) <= SHORT:
            return array("I", self.merge(raw))
        middle = len(raw) // 2
        return self.join_ids(self.encode_bytes(raw[:middle]), self.encode_bytes(raw[middle:]))

    def pretoken(self, text: str) -> bytes:
        ids = self.known.get(text)
        if ids is None:
            raw = text.encode()
            whole = self.ranks.get(raw)  # the library takes a pre-token that is a token as it is
            ids = (array("I", [whole]) if whole is not None else self.encode_bytes(raw)).tobytes()
            if len(raw) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[text] = ids
        return ids

    # pre-tokens of a text

    def leaf(self, text: str) -> Piece:
        found = self.split.findall(text)
        known = self.known
        return Piece(text, list(map(len, found)), [known.get(t) or self.pretoken(t) for t in found])

    def join(self, left: Piece, right: Piece) -> Piece:
        if not left.text or not right.text:
            return left if left.text else right
        keep = max(0, len(left.lengths) - UNSETTLED)
        begin = len(left.text) - sum(left.lengths[keep:])
        lengths, ids = left.lengths[:keep], left.ids[:keep]
        text, edge = left.text + right.text, len(left.text)
        # boundaries of the left half's open pre-tokens, and of the right half as far as the window has come
        ends, at = [begin], begin
        for n in left.lengths[keep:]:
            ends.append(ends[-1] + n)
        no, border = 0, edge  # pre-tokens of the right half that end at or before ``border``
        while at < len(text):
            while border < at:
                border += right.lengths[no]
                no += 1
            if at >= edge and border == at:
                break
            end = self.split.match(text, at).end()
            lengths.append(end - at)
            ids.append(self._again(text, at, end, left, ends, keep, right, no, border, edge))
            at = end
        else:
            no = len(right.lengths)
        return Piece(text, lengths + right.lengths[no:], ids + right.ids[no:])

    def _again(self, text: str, at: int, end: int, left: Piece, ends: list[int], keep: int, right: Piece, no: int, border: int, edge: int) -> bytes:
        """The ids of a pre-token of the window; a long one takes over what the halves know of it."""
        if end - at > SHORT and at in ends[:-1]:
            k = ends.index(at)
            if ends[k + 1] == end:  # as it was
                return left.ids[keep + k]
            if at < edge < end and ends[k + 1] == edge and edge + right.lengths[0] == end:  # one of each half
                raw = text[at:end].encode()
                if raw not in self.ranks:
                    return self.join_ids(array("I", left.ids[keep + k]), array("I", right.ids[0])).tobytes()
        return self.pretoken(text[at:end])

    def tree(self, text: str) -> Piece:
        """The whole text: leaves, joined level by level."""
        level = [self.leaf(text[at : at + LEAF]) for at in range(0, len(text), LEAF)]
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else Piece("", [], [])

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as native unsigned 32-bit integers."""
        return b"".join(self.tree(text or "").ids)

    def decode_bytes(self, ids: Sequence[int]) -> bytes:
        """The bytes of ids: halves, concatenated."""
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode_bytes(ids[:middle]) + self.decode_bytes(ids[middle:])


def _little(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "=u4").astype("<u4", copy=False)


def encode_digest(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text (null: empty)."""

    def make():
        coder = TreeBpe(path)

        def one(text: str | None) -> tuple[int, str, str]:
            ids = _little(coder.encode(text))
            return len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode_bytes(ids.tolist())).hexdigest()

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = [one(t) for part in texts_of(batch, "text") for t in part]
            if found:
                n, ids, back = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return work

    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id and the ids of every whole text (null: no ids)."""

    def make():
        coder = TreeBpe(path)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            at = 0
            for part in texts_of(batch, "text"):
                ids = [_little(coder.encode(t)).astype(np.int64) for t in part]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])
                at += len(part)

        return work

    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<long>")


def decode(rows: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id and the bytes that the ids of each row spell (null ids: none)."""

    def make():
        coder = TreeBpe(path)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            back = [coder.decode_bytes(ids.values.to_numpy(zero_copy_only=False).tolist()) if ids.is_valid else b"" for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(back, pa.binary())], ["doc_id", "raw"])

        return work

    return map_batches(rows.select("doc_id", "ids"), make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, raw binary")
