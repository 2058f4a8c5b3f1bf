"""WARC archives compressed with Zstandard: one frame per record, dictionary in front.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record
then is one frame, so a reader can decode from any record on.  The reader checks the version line,
the needed headers, Content-Length against the frame, and the payload's SHA-1 digest; a violation
raises ``WarcError`` with the archive's name.

In Spark an archive is one binary value of a table in the shared folder, at most ``archive_bytes``
long (one record more may pass the mark), so writing commits like any other table and a lost executor
only costs a retry.  ``write_archive_file`` and ``read_archive_files`` handle .warc.zst files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.llm.common import fraction_hash, written

DICT_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that the reader hands to a frame at once.
FEED = 16 * 1024
#: Repeated digests that are broadcast (about 100 bytes each); more of them meet the pages in a shuffled join.
BROADCAST_ROWS = 300_000
DATE = "2000-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that breaks the format."""


@dataclass(frozen=True)
class Record:
    kind: str
    record_id: str
    uri: str
    headers: dict[str, str]
    payload: bytes | None  # None for a revisit
    payload_length: int
    digest: str  # lower-case hex


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(null|-?\d+)>", identifier)
    if not found:
        raise WarcError(f"not a page's identifier: {identifier!r}")
    return None if found[1] == "null" else int(found[1])


def _safe_uri(url: str | None, page_id: int | None) -> str:
    """Header values hold no white space or control characters: those are percent-encoded."""
    if not url:
        return record_id(page_id)[1:-1]
    return re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_safe_uri(url, page_id)}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes, where: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"{where}: bad header line {line[:80]!r}")
        if (key := name.decode().lower()) in found:
            raise WarcError(f"{where}: {key} twice")
        found[key] = value.strip().decode()
    return found


def parse_record(raw: bytes, where: str = "record") -> Record:
    """The one record that a frame holds; checks version, headers, lengths and digest."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"{where}: no WARC version line")
    headers = _headers(lines, where)
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in headers:
            raise WarcError(f"{where}: {need} is missing")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"{where}: Content-Length {headers['content-length']} does not fit the frame")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise WarcError(f"{where}: no HTTP header")
    length = int(_headers(lines, where)["content-length"])
    algorithm, _, encoded = headers.get("warc-payload-digest", "").partition(":")
    if algorithm != "sha1":
        raise WarcError(f"{where}: no SHA-1 payload digest")
    digest = base64.b32decode(encoded).hex()
    kind = headers["warc-type"]
    if kind == "revisit":
        if payload or "warc-refers-to" not in headers:
            raise WarcError(f"{where}: a revisit has no payload, and names the record it repeats")
        return Record(kind, headers["warc-record-id"], headers.get("warc-target-uri", ""), headers, None, length, digest)
    if len(payload) != length:
        raise WarcError(f"{where}: payload of {len(payload)} bytes, {length} announced")
    if hashlib.sha1(payload).hexdigest() != digest:
        raise WarcError(f"{where}: payload does not match its digest")
    return Record(kind, headers["warc-record-id"], headers.get("warc-target-uri", ""), headers, payload, length, digest)


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def _dict(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def compressor(dictionary: bytes, level: int = 3) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, dict_data=_dict(dictionary), write_content_size=True, write_checksum=True)


def iter_records(archive: bytes, where: str = "archive") -> Iterator[Record]:
    """The records of an archive, decoded one frame at a time."""
    at, dictionary = 0, b""
    view = memoryview(archive)
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICT_MAGIC:
        size = struct.unpack_from("<I", archive, 4)[0]
        dictionary, at = bytes(view[8 : 8 + size]), 8 + size
        if len(dictionary) != size:
            raise WarcError(f"{where}: the dictionary is cut off")
        if dictionary[:4] == struct.pack("<I", ZSTD_MAGIC):  # the dictionary itself may be compressed
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    reader = zstandard.ZstdDecompressor(dict_data=_dict(dictionary))
    n = 0
    while at < len(archive):
        # fed piece by piece: what a frame leaves unused is copied, so a piece is all that is ever copied twice
        one, parts = reader.decompressobj(), []
        while not one.eof and at < len(archive):
            piece = view[at : at + FEED]
            try:
                parts.append(one.decompress(piece))
            except zstandard.ZstdError as error:
                raise WarcError(f"{where}, record {n}: {error}") from error
            at += len(piece) - (len(one.unused_data) if one.eof else 0)
        if not one.eof:
            raise WarcError(f"{where}, record {n}: the frame is cut off")
        yield parse_record(b"".join(parts), f"{where}, record {n}")
        n += 1


def train_dictionary(samples: list[bytes], size: int = 32 * 1024) -> bytes:
    """A dictionary from sample records; empty if the samples are too few to learn from."""
    if len(samples) < 16 or sum(map(len, samples)) < 8 * size:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


#: At most about so many pages, each with at most so many bytes, teach the dictionary (it changes sizes, never contents).
SAMPLE_PAGES, SAMPLE_BYTES = 256, 16 * 1024


def _page_dictionary(pages: DataFrame) -> bytes:
    n = pages.count()
    if not n:
        return b""
    sample = pages.where(fraction_hash(F.col("page_id"), "dictionary") < SAMPLE_PAGES / n).select(F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES).alias("html")).limit(2 * SAMPLE_PAGES)
    return train_dictionary([r.html.encode() for r in sample.collect() if r.html])


def mark_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, html with digest, revisit and refers_to.

    Of records with equal payloads of at least ``least_bytes`` the one with the largest page_id is the
    response.  Only ids and digests are grouped (combined before the shuffle).  Up to ``BROADCAST_ROWS``
    digests that repeat are broadcast, so no html is shuffled; beyond, pages meet them in a shuffled
    join whose hot keys Spark can split.  Rows that share the largest page_id are all responses (and
    share a record id); a null page_id ranks below all others.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"))
    long_enough = F.octet_length("html") >= least_bytes
    repeated = rows.where(long_enough).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("same"), "first")
    repeated = written(repeated, "repeated")
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    joined = rows.join(repeated, (F.col("digest") == F.col("same")) & long_enough, "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first")))
    return joined.select("page_id", "url", "html", "digest", F.coalesce(revisit, F.lit(False)).alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(marked: DataFrame, dictionary: bytes, archive_bytes: int = 4 << 20) -> DataFrame:
    """Archives (name, records, archive) of the marked pages, written into the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        pack, front = compressor(dictionary), dictionary_frame(dictionary)
        frames, size, n = [front], len(front), 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{no:05d}.warc.zst"]), pa.array([n]), pa.array([b"".join(frames)], pa.binary())], ["name", "records", "archive"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for page, url, html, digest, revisit, refers in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    frame = pack.compress(build_record(page, url, html.encode(), digest, refers, revisit))
                    frames.append(frame)
                    size, n = size + len(frame), n + 1
                    if size >= archive_bytes:
                        yield full()
                        frames, size, n, no = [front], len(front), 0, no + 1
        if n:
            yield full()

    return written(marked.mapInArrow(run, "name string, records long, archive binary"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record: page_id, uri, record_type, payload_bytes, payload_digest, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for row in range(batch.num_rows):
                name, archive = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                found = [(page_of(r.record_id), r.uri, r.kind, r.payload_length, r.digest, page_of(r.headers["warc-refers-to"]) if r.kind == "revisit" else None) for r in iter_records(archive, name)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    return archives.select("name", "archive").mapInArrow(run, "page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write every page to archives, read the archives back, and report each record.

    Null html is an empty payload, a null url becomes the page's own identifier; an empty table gives
    no archives and no rows.
    """
    archives = write_archives(mark_revisits(pages), _page_dictionary(pages))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri")


def write_archive_file(path: str, records: Iterable[bytes], dictionary: bytes = b"") -> None:
    """One .warc.zst file from built records."""
    pack = compressor(dictionary)
    with open(path, "wb") as out:
        out.write(dictionary_frame(dictionary))
        for record in records:
            out.write(pack.compress(record))


def read_archive_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of .warc.zst files (each at most 2 GB, as Spark's binary source needs)."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), F.col("content").alias("archive")))
