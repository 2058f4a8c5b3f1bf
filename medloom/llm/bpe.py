"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding by a state machine.

Merges apply in the order of their list.  Whether a merge happens can depend on what follows only
through a chain of later and later merges, each starting on the symbol that the one before may
consume or make; the longest such chain, in bytes, is the merge list's sufficient lookahead and is
computed once by dynamic programming over the list.  While a word streams in, a window is encoded
whenever it is longer than the lookahead; tokens that end before the lookahead's reach are stable and
are emitted, and the window goes on from the last stable boundary.  Texts are read in slices of bounded
size, within words too, and ids leave in pieces, so beside the text itself memory stays constant for
texts and words of any length.  Ids of recent words are remembered.

Decoding consumes pieces of ids: ``TokenDecoder`` gives the library's text (token strings with spaces
between), ``TextDecoder`` turns the tokens' bytes into text, a character as soon as it is complete.

Null texts are empty texts; repeated rows have a row each, further columns are left alone.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from medloom.llm.common import map_batches, texts_of

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
REMEMBERED = 350_000
_NONE = 1 << 60
#: Characters of a text that are read at once, symbols of a window beyond the lookahead, ids of a piece,
#: and characters of a chunk that is remembered.
READ, AHEAD, PIECE, LONGEST = 1 << 16, 128, 4096, 64
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: These are white space to Python's split, but not to the vocabulary's patterns.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_LETTERS, _OTHERS = regex.compile(r"[\p{L}]*"), regex.compile(r"[^\s\p{L}\p{N}]*")


@cache
def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible, else the next from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in visible:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def sufficient_lookahead(merges: list[tuple[str, str]], length=len) -> int:
    """Longest reach of a chain of merges, in symbols' lengths.

    A merge (a, b) looks beyond its place only if b itself may still be consumed or made by an
    earlier merge that begins there; its reach is a's length plus the longest reach found at b.
    """
    reach: dict[str, int] = {}
    most = 1
    for a, b in merges:
        d = length(a) + max(length(b), reach.get(b, 0))
        most = max(most, d)
        for start in (a, a + b):
            if reach.get(start, 0) < d:
                reach[start] = d
    return most


class Transducer:
    """Encoder for a vocabulary with end-of-word suffix, as its file describes it."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(merges):
            if made.get(a, -1) >= rank or made.get(b, -1) >= rank or a + b in made:
                raise ValueError("the merge list is not in order; its lookahead is not bounded by chains")
            made[a + b] = rank
        # a merge's place in the list, then its token, in one number: the least comes first
        self.ranks = {(self.ids[a], self.ids[b]): rank << 20 | self.ids[a + b] for rank, (a, b) in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges, lambda t: len(t.removesuffix(self.suffix)))
        chars = byte_characters()
        self.single = [self.ids[c] for c in chars]
        self.last = [self.ids[c + self.suffix] for c in chars]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids.update(self.special)
        self.tokens = [""] * (max(self.ids.values()) + 1)
        for t, i in self.ids.items():
            self.tokens[i] = t
        self.width = [len(t.removesuffix(self.suffix)) for t in self.tokens]
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _merge(self, ids: list[int]) -> list[int]:
        get = self.ranks.get
        found = [get(p, _NONE) for p in zip(ids, ids[1:], strict=False)]
        while found and (best := min(found)) != _NONE:
            at = found.index(best)
            ids[at] = best & 0xFFFFF
            del ids[at + 1], found[at]
            if at < len(found):
                found[at] = get((ids[at], ids[at + 1]), _NONE)
            if at:
                found[at - 1] = get((ids[at - 1], ids[at]), _NONE)
        return ids

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of one word's symbols, each as soon as it is stable."""
        window: list[int] = []
        limit = self.lookahead + AHEAD
        for symbol in symbols:
            window.append(symbol)
            if len(window) > limit:
                used = 0
                for token in self._merge(window.copy()):
                    if used + self.width[token] > len(window) - self.lookahead:
                        break
                    used += self.width[token]
                    yield token
                del window[:used]
        yield from self._merge(window)

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        single = self.single
        symbols = [single[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        if len(symbols) <= self.lookahead + AHEAD:  # ends within the first window
            return array("I", self._merge(symbols)).tobytes()
        return array("I", self.stream(symbols)).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run of text between white space."""
        chunk = _fold(chunk)
        return b"".join(map(self._known_word, [chunk] if chunk.isascii() and chunk.isalpha() else _WORDS.findall(chunk)))

    def _known_word(self, word: str) -> bytes:
        words = self.words
        ids = words.get(word)
        if ids is None:
            ids = self._word(word)
            if len(word) <= 64:
                if len(words) >= REMEMBERED:
                    words.clear()
                words[word] = ids
        return ids

    def encode(self, text: str | None) -> Iterator[bytes]:
        """Ids (little-endian, unsigned 32 bit) of a whole text in pieces of bounded size."""
        text, at = text or "", 0
        if self._split and any(s in text for s in self.special):
            for found in self._split.finditer(text):
                yield from self._part(text, at, found.start())
                yield np.array([self.special[found[0]]], "<u4").tobytes()
                at = found.end()
        yield from self._part(text, at, len(text))

    def _part(self, text: str, start: int, stop: int) -> Iterator[bytes]:
        if _SEPARATORS.search(text, start, stop):
            yield from self._long(text, start, stop)
            return
        known = self.known
        while start < stop:
            end = min(start + READ, stop)
            if end < stop:  # up to the last blank
                blank = max(text.rfind(" ", start + 1, end), text.rfind("\n", start + 1, end))
                if blank < 0:  # none: up to the next, read in slices
                    end = min((p for p in (text.find(" ", end, stop), text.find("\n", end, stop)) if p >= 0), default=stop)
                    yield from self._long(text, start, end)
                    start = end
                    continue
                end = blank
            chunks = text[start:end].split()
            start = end
            if len(known) > REMEMBERED:
                known.clear()
            for new in {c for c in chunks if c not in known and len(c) <= LONGEST}:
                known[new] = self._chunk(new)
            yield b"".join([known[c] if len(c) <= LONGEST else self._chunk(c) for c in chunks])

    def _long(self, text: str, start: int, stop: int) -> Iterator[bytes]:
        """The same for text without blanks to cut at: slices are folded one by one, words that end in
        what is read are encoded whole, and longer ones are streamed."""
        reader, out = _Reader(_slices(text, start, stop)), []
        while True:
            found = _WORDS.search(reader.text, reader.at)
            # what follows may belong to the word, or turn it into another ('s, 'll)
            if (found is None or found.end() >= len(reader.text) - 2) and len(reader.text) - reader.at <= READ and reader.more():
                continue
            if found is None:
                reader.at = len(reader.text)
                if not reader.more():
                    break
            elif found.end() < len(reader.text) or not reader.waiting:
                out.append(self._known_word(found[0]))
                reader.at = found.end()
            else:
                yield b"".join(out)
                out = []
                reader.at = found.end()
                ids = array("I")
                for token in self.stream(self._symbols(reader, found[0])):
                    ids.append(token)
                    if len(ids) == PIECE:
                        yield ids.tobytes()
                        ids = array("I")
                yield ids.tobytes()
            if len(out) >= PIECE:
                yield b"".join(out)
                out = []
        yield b"".join(out)

    def _symbols(self, reader: _Reader, begun: str) -> Iterator[int]:
        """The symbols of a word that goes on beyond what is read."""
        more = _LETTERS if _LETTERS.match(begun)[0] else _OTHERS
        single, raw = self.single, begun.encode()
        while True:
            for k in range(len(raw) - 1):
                yield single[raw[k]]
            last = raw[-1]
            if reader.at < len(reader.text) or not reader.more():
                break
            raw = more.match(reader.text)[0]
            reader.at, raw = len(raw), raw.encode()
            if not raw:
                break
            yield single[last]
        yield self.last[last]


class _Reader:
    """Slices of a text with what is left of the one before."""

    def __init__(self, slices: Iterator[str]):
        self.slices, self.text, self.at, self.waiting = slices, "", 0, True

    def more(self) -> bool:
        part = next(self.slices, None)
        if part is None:
            self.waiting = False
            return False
        self.text, self.at = self.text[self.at :] + part, 0
        return True


def _fold(text: str) -> str:
    """Normal form C in lower case."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    # every character by itself: no final sigma
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


def _slices(text: str, start: int, stop: int) -> Iterator[str]:
    """Folded slices of about READ characters, cut where no character composes with the one before
    (a run of combining marks stays together)."""
    while start < stop:
        end = min(start + READ, stop)
        while end < stop and text[end] >= "\u0300" and (unicodedata.category(text[end])[0] == "M" or "\u1100" <= text[end] <= "\u11ff"):
            end += 1
        yield _fold(text[start:end])
        start = end


class TokenDecoder:
    """State machine over ids: the library's text of the tokens so far, as UTF-8."""

    def __init__(self, tokens: list[str]):
        self.tokens, self.begun = [t.encode() for t in tokens], False

    def feed(self, ids: Iterable[int]) -> bytes:
        out = b" ".join(map(self.tokens.__getitem__, ids))
        if self.begun and out:
            out = b" " + out
        self.begun = self.begun or bool(out)
        return out

    def reset(self) -> None:
        self.begun = False


class TextDecoder:
    """State machine over ids: characters as soon as their bytes are complete; word ends become spaces."""

    def __init__(self, tokens: list[str], suffix: str):
        byte = {c: b for b, c in enumerate(byte_characters())}
        self.tokens = [bytes(byte[c] for c in t.removesuffix(suffix) if c in byte) + (b" " if suffix and t.endswith(suffix) else b"") for t in tokens]
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        return self.utf8.decode(b"".join(map(self.tokens.__getitem__, ids)), last)

    def end(self) -> str:
        return self.utf8.decode(b"", True)

    def reset(self) -> None:
        self.utf8.reset()


def encode_digest(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_chars of every whole text (null: empty).

    ``decoded_sha256`` is of the library's decoded text, ``decoded_chars`` counts the characters of the
    text that the ids' bytes spell.
    """

    def make():
        coder = Transducer(path)
        decoder, speller = TokenDecoder(coder.tokens), TextDecoder(coder.tokens, coder.suffix)

        def one(text: str | None) -> tuple[int, str, str, int]:
            ids, back, n = hashlib.sha256(), hashlib.sha256(), 0
            decoder.reset()
            speller.reset()
            chars = 0
            for piece in coder.encode(text):
                ids.update(piece)
                tokens = np.frombuffer(piece, "<u4").tolist()
                back.update(decoder.feed(tokens))
                chars += len(speller.feed(tokens))
                n += len(tokens)
            return n, ids.hexdigest(), back.hexdigest(), chars + len(speller.end())

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = [one(t) for part in texts_of(batch, "text") for t in part]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"])

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long")


def decode(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and the text that the ids of each row spell (null ids: empty)."""

    def make():
        coder = Transducer(path)
        speller = TextDecoder(coder.tokens, coder.suffix)

        def one(ids: pa.Scalar) -> str:
            speller.reset()
            return speller.feed(ids.values.to_numpy(zero_copy_only=False).tolist(), True) if ids.is_valid else ""

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(one, batch.column("ids")), pa.string())], ["doc_id", "text"])

        return work

    return map_batches(rows.select("doc_id", "ids"), make, "doc_id long, text string")


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and the ids of every whole text."""

    def make():
        coder = Transducer(path)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            at = 0
            for part in texts_of(batch, "text"):
                ids = [np.frombuffer(b"".join(coder.encode(t)), "<u4").astype(np.int64) for t in part]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])
                at += len(part)

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, ids array<long>")
