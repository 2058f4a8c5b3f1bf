"""Chat formatting with a grammar that is checked by a round trip.

A conversation is a row of turns::

    ### User:
    text
    </turn>

A backslash run before a control string takes it literally and loses one backslash when read.  Each
turn is rendered, read back by the parser, and compared with its source; where they differ, each
control string in the text gets one more backslash, until both are identical.  The loss mask covers
the text of assistant turns.

Formatting works row by row.  Reading back takes the rows of a conversation in order, one turn at a
time, so memory does not grow with a conversation's length (its digest is a chain, which only one
task can follow).  Null texts and roles are empty texts and ``null`` roles (empty in digests); rows
with equal turns are ordered by their rendered text; a null conv_id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.llm.common import texts_of

ROLES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
_BACK = {v: k for k, v in ROLES.items()}
END = "</turn>"
_CONTROL = re.compile(r"(\\*)(### (?:System|User|Assistant|Tool):|### Role\[|</turn>)")
_HEAD = re.compile(r'### (?:(System|User|Assistant|Tool)|Role\[(null|"(?:[^"\\\n]|\\.)*")\]):\n')


class ChatError(ValueError):
    """Text that the grammar does not admit."""


def _head(role: str | None) -> str:
    return f"### {ROLES[role]}:\n" if role in ROLES else f"### Role[{json.dumps(role)}]:\n"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1\2", text)


def parse_turn(rendered: str, at: int = 0) -> tuple[str | None, str, tuple[int, int], int]:
    """(role, text, span of the rendered text, end) of the turn that begins at ``at``."""
    head = _HEAD.match(rendered, at)
    if not head:
        raise ChatError(f"no turn begins at {at}")
    role = _BACK[head[1]] if head[1] else json.loads(head[2])
    parts, done = [], head.end()
    for found in _CONTROL.finditer(rendered, head.end()):
        if found[1]:
            parts.append(rendered[done : found.start()] + found[0][1:])
            done = found.end()
        elif found[2] == END and rendered.startswith("\n" + END + "\n", found.start() - 1) and found.start() - 1 >= head.end():
            parts.append(rendered[done : found.start() - 1])
            return role, "".join(parts), (head.end(), found.start() - 1), found.end() + 1
        else:
            raise ChatError(f"a control string stands at {found.start()}")
    raise ChatError("the turn has no end")


def render_turn(role: str | None, text: str | None) -> str:
    """The turn as text; escaped until reading it gives back role and text."""
    head, text = _head(role), text or ""
    body = text
    for _ in range(3):
        rendered = f"{head}{body}\n{END}\n"
        try:
            back = parse_turn(rendered)
            if (back[0], back[1], back[3]) == (role, text, len(rendered)):
                return rendered
        except ChatError:
            pass
        body = escape(body)
    raise ChatError(f"no rendering of {text[:100]!r} reads back")


def parse_conversation(rendered: str) -> Iterator[tuple[str | None, str, tuple[int, int]]]:
    at = 0
    while at < len(rendered):
        role, text, span, at = parse_turn(rendered, at)
        yield role, text, span


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, rendered: the formatted text of each turn (a conversation's output is their concatenation)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in texts_of(batch, "text"):
                own = batch.slice(at, len(part))
                texts = [render_turn(r, t) for r, t in zip(own.column("role").to_pylist(), part, strict=True)]
                yield pa.RecordBatch.from_arrays([own.column("conv_id"), own.column("turn"), pa.array(texts, pa.string())], ["conv_id", "turn", "rendered"])
                at += len(part)

    return conversations.select("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, turn long, rendered string")


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss, self.n, self.chars, self.loss_chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def read(self, rendered: str) -> None:
        for role, text, _ in parse_conversation(rendered):
            self.n += 1
            self.turns.update(f"{role or ''}\n{text}\n".encode())
            if role == "assistant":
                self.loss.update(text.encode())
                self.loss_chars += len(text)
        self.chars += len(rendered)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(rendered: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted output alone."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        now, digest, done = None, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

        for batch in batches:
            at = 0
            for part in texts_of(batch, "rendered"):
                for conv, text in zip(batch.column("conv_id").slice(at, len(part)).to_pylist(), part, strict=True):
                    if digest is None or conv != now:
                        if digest is not None:
                            done.append((now, *digest.row()))
                        now, digest = conv, _Digest()
                    digest.read(text)
                at += len(part)
            if len(done) >= 5000:
                yield out()
                done = []
        if digest is not None:
            done.append((now, *digest.row()))
        if done:
            yield out()

    order = ["conv_id", "turn", "rendered"]
    return rendered.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "rendered").mapInArrow(run, schema)


#: A conversation whose texts look like the template; it is formatted with the others.
PROBE = r"\### Assistant: </turn> ok"


def format_digest(conversations: DataFrame) -> DataFrame:
    """All conversations and the probe (-7), formatted and read back; a conversation of the table that
    has the probe's number keeps a row of its own."""
    spark = conversations.sparkSession
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(render(rows)).unionByName(read_back(render(probe)))
