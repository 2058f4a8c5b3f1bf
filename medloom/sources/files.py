"""Files and folders wherever Spark can reach them, through its Hadoop file systems."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession

_PIECE = 1 << 20


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def name_of(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def stem_of(path: str) -> str:
    return name_of(path).rpartition(".")[0] or name_of(path)


def suffix_of(path: str) -> str:
    name = name_of(path)
    return name[len(stem_of(path)) :]


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def listed(spark: SparkSession, folder: str) -> list[str]:
    """What lies right inside a folder, by name; nothing if there is no such folder."""
    fs, where = _at(spark, folder)
    if not fs.exists(where):
        return []
    return sorted(f"{folder.rstrip('/')}/{x.getPath().getName()}" for x in fs.listStatus(where))


def full_name(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    return fs.makeQualified(where).toString()


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, parts: str | Iterable[str]) -> None:
    """A text file from a string or from pieces, which are sent about a megabyte at a time."""
    fs, where = _at(spark, path)
    stream = fs.create(where, True)
    try:
        held, size = [], 0
        for part in [parts] if isinstance(parts, str) else parts:
            held.append(part)
            size += len(part)
            if size >= _PIECE:
                stream.write(bytearray("".join(held).encode()))
                held, size = [], 0
        stream.write(bytearray("".join(held).encode()))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


_MANIFEST = re.compile(r"^manifest-([0-9]{8})\.json$")
#: Snapshots that stay beside the newest, for readers that have opened them.
KEPT = 1


def _manifests(spark: SparkSession, folder: str) -> list[tuple[int, dict[str, Any]]]:
    """Complete manifests by number, the newest first; one that is being written, or was cut off, is none."""
    found = []
    for path in listed(spark, folder):
        if named := _MANIFEST.match(name_of(path)):
            try:
                content = json.loads(read_text(spark, path))
            except ValueError:
                continue
            if isinstance(content, dict) and content.get("complete") is True:
                found.append((int(named[1]), content))
    return sorted(found, key=lambda x: -x[0])


def current(spark: SparkSession, folder: str) -> str | None:
    """The folder of the published snapshot, or None."""
    found = _manifests(spark, folder)
    return f"{folder.rstrip('/')}/{found[0][1]['snapshot']}" if found else None


@contextmanager
def published(spark: SparkSession, folder: str) -> Iterator[str]:
    """A new snapshot below ``folder``, which readers see once all has been written.

    A snapshot is a folder of its own, never changed later; publishing it is the single write of a manifest with the next number, which nothing
    renames and nothing overwrites.  Whatever fails before leaves the old snapshot current, also where renaming is no single step.  Of two
    writers that take the same number one fails.  Older snapshots but ``KEPT`` are deleted afterwards.
    """
    folder, snapshot = folder.rstrip("/"), f"snapshot-{uuid.uuid4().hex}"
    before = _manifests(spark, folder)
    try:
        yield f"{folder}/{snapshot}"
        numbers = [int(m[1]) for p in listed(spark, folder) if (m := _MANIFEST.match(name_of(p)))]
        fs, where = _at(spark, f"{folder}/manifest-{max(numbers, default=0) + 1:08d}.json")
        stream = fs.create(where, False)
        try:
            stream.write(bytearray(json.dumps({"snapshot": snapshot, "complete": True}).encode()))
        finally:
            stream.close()
    except BaseException:
        delete(spark, f"{folder}/{snapshot}")
        raise
    stays = {snapshot, *(m["snapshot"] for _, m in before[:KEPT])}
    for number, manifest in before[KEPT:]:
        delete(spark, f"{folder}/manifest-{number:08d}.json")
        if manifest["snapshot"] not in stays:
            delete(spark, f"{folder}/{manifest['snapshot']}")
