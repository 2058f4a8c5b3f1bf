import hashlib
import re
import struct
import time

import duckdb
import pytest
import zstandard

from medloom.llm import warc
from medloom.llm.queries import ORACLES, op2_warc


def record(n=0, payload=b"hello", revisit=False):
    return warc.build_record(n, "http://x.example/a b", payload, hashlib.sha1(payload).hexdigest(), 9 if revisit else None, revisit)


def archive(records, dictionary=b""):
    pack = warc.compressor(dictionary)
    return warc.dictionary_frame(dictionary) + b"".join(pack.compress(r) for r in records)


def test_round_trip_with_dictionary():
    payloads = [f"<html><p>page {i} of many pages with the same words</p></html>".encode() * 30 for i in range(200)]
    dictionary = warc.train_dictionary(payloads, 4096)
    assert dictionary
    whole = archive([record(i, p) for i, p in enumerate(payloads)], dictionary)
    assert struct.unpack_from("<I", whole)[0] == warc.DICT_MAGIC
    found = list(warc.iter_records(whole))
    assert [r.payload for r in found] == payloads and [warc.page_of(r.record_id) for r in found] == list(range(200))
    packed = warc.dictionary_frame(zstandard.compress(dictionary)) + whole[8 + len(dictionary) :]
    assert len(list(warc.iter_records(packed))) == 200
    assert found[0].uri == "http://x.example/a%20b"


def test_revisit_keeps_length_and_digest():
    r = next(warc.iter_records(archive([record(3, b"abc", True)])))
    assert (r.kind, r.payload, r.payload_length, r.digest, warc.page_of(r.headers["warc-refers-to"])) == ("revisit", None, 3, hashlib.sha1(b"abc").hexdigest(), 9)


@pytest.mark.parametrize("change", [
    lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: r.replace(b"hello", b"hellO"), lambda r: r.replace(b"WARC-Date", b"WARC-Dote"), lambda r: r[:-1],
    lambda r: r + b"x", lambda r: r.replace(b"Content-Length: 5\r\n", b"Content-Length: 6\r\n"), lambda r: r.replace(b"sha1:", b"md5:"), lambda r: r.replace(b"WARC-Date:", b"WARC-Type:"),
])
def test_broken_records(change):
    with pytest.raises(warc.WarcError):
        list(warc.iter_records(archive([change(record())])))


def test_broken_archives():
    whole = archive([record(), record(1)])
    for bad in (whole[:-3], whole[:20] + b"\0" + whole[21:], warc.dictionary_frame(b"x" * 50)[:20]):
        with pytest.raises(warc.WarcError):
            list(warc.iter_records(bad))
    assert list(warc.iter_records(b"")) == []


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW pages AS SELECT * FROM read_parquet('/root/testdata/sf0.001/pages.parquet')")
    got = op2_warc(spark, "/root/testdata/sf0.001").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert {tuple(r) for r in got} == set(con.sql(ORACLES["op2_warc"]).fetchall())


def test_odd_pages(spark):
    same, short = "z" * 1000, "z" * 999
    rows = [(1, "u", same), (2, None, same), (3, "u\r\nX: y", same), (4, "u", short), (5, "u", short), (6, "ü", None), (7, "u", ""), (None, "u", same), (3, "u", same)]
    pages = spark.createDataFrame([(*r, "x", True) for r in rows], "page_id long, url string, html string, digest string, revisit boolean")
    got = warc.archive_pages(pages).collect()
    assert len(got) == 9
    key = lambda r: (r.page_id, r.record_type, r.refers_to, r.payload_bytes)
    assert sorted(map(str, map(key, got))) == sorted(map(str, [(1, "revisit", 3, 1000), (2, "revisit", 3, 1000), (3, "response", None, 1000), (3, "response", None, 1000), (4, "response", None, 999), (5, "response", None, 999), (6, "response", None, 0), (7, "response", None, 0), (None, "revisit", 3, 1000)]))
    assert {r.payload_digest for r in got if r.payload_bytes == 0} == {hashlib.sha1().hexdigest()}
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_files(spark, tmp_path):
    warc.write_archive_file(str(tmp_path / "a.warc.zst"), [record(5), record(6, b"x", True)])
    assert sorted((r.page_id, r.record_type) for r in warc.read_archive_files(spark, str(tmp_path)).collect()) == [(5, "response"), (6, "revisit")]


def test_many_small_records_are_read_in_linear_time():
    record = warc.build_record(1, "u", b"small payload", hashlib.sha1(b"small payload").hexdigest(), None, False)
    frame = warc.compressor(b"").compress(record)
    archive = frame * ((8 << 20) // len(frame))
    start = time.perf_counter()
    assert sum(1 for _ in warc.iter_records(archive)) == len(archive) // len(frame)
    assert time.perf_counter() - start < 10
    large = b"".join(hashlib.sha1(str(i).encode()).digest() for i in range(20_000))
    record = warc.build_record(2, "u", large, hashlib.sha1(large).hexdigest(), None, False)
    mixed = frame + warc.compressor(b"").compress(record) + frame  # a frame over many pieces
    assert [r.payload_length for r in warc.iter_records(mixed)] == [13, len(large), 13]


def test_no_exchange_carries_html(spark, capsys):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        warc.mark_revisits(pages).explain("formatted")
        plan = capsys.readouterr().out
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and not re.search(r"\(\d+\) Exchange\n[^(]*html", plan)


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"u{i}", ("x" * 1500 if i % 3 else f"{i}" * 800) if i % 5 else "short") for i in range(60)], "page_id long, url string, html string")
    few = sorted(tuple(r) for r in warc.mark_revisits(pages).drop("html").collect())
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in warc.mark_revisits(pages).drop("html").collect()) == few
