import zlib

import duckdb

from medloom.llm import sharding
from medloom.llm.queries import ORACLES, op9_sharding


def brute(rows, shards):
    """rows: (doc_id, size) in order."""
    total, before, out, slots = sum(s for _, s in rows), 0, [], {}
    for doc, size in rows:
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        out.append((doc, size, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return out


def test_against_brute_force(documents):
    rows = sorted((r.doc_id, len((r.text or "").encode()) + 1) for r in documents.collect())
    got = sharding.shard_by_bytes(documents.repartition(5), 16).collect()
    assert sorted((r.doc_id, r.size, r.shard, r.slot) for r in got) == sorted(brute(rows, 16))
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)


def test_odd_rows(odd_documents):
    got = sharding.shard_by_bytes(odd_documents, 4).collect()
    assert len(got) == 9 and {r.size for r in got if r.doc_id in (1, 2)} == {1} and {r.text_crc32 for r in got if r.doc_id == 1} == {0}
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_by_bytes(odd_documents.limit(0), 4).count() == 0


def test_hot_id_is_spread(spark):
    docs = spark.range(4000).selectExpr("IF(id < 2000, 7, id) AS doc_id", "'abc' AS text")
    got = sharding.shard_by_bytes(docs, 8).groupBy("shard").count().collect()
    assert {r["count"] for r in got} == {500}


def test_query_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    want = con.sql(ORACLES["op9_sharding"])
    names = want.columns
    assert sorted(map(tuple, op9_sharding(spark, "/root/testdata/sf0.001").select(*names).collect())) == sorted(want.fetchall())
