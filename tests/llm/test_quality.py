import re

import duckdb
import pytest

from medloom.llm import quality
from medloom.llm.queries import ORACLES, op3_quality_rules, quality_ablation

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


@pytest.mark.parametrize("text", [None, "", " ", "a", "a b c a b c", "a a a a", "x\n\nx\n x\nx", "é#ü|ß <b> \x1c \x85", "a b c d a b c e a b", "one\r\ntwo\x0bone two one two one"])
def test_measures(text):
    assert quality.measure(text)[:5] == brute(text)


def test_measures_of_documents(documents):
    for r in documents.select("text").limit(60).collect():
        words = (r.text or "").split()
        if len(words) < 600:
            assert quality.measure(r.text)[:5] == brute(r.text)


def test_ledger_policies_and_ablation(documents):
    rows = quality.ledger(documents).cache()
    bits = [r.failed for r in rows.collect()]
    assert {r.doc_id for r in rows.collect()} == {r.doc_id for r in documents.collect()}
    whole = quality.mask(quality.POLICIES["v1"])
    table = {r.rule: r for r in quality.ablation(rows, "v1", "v2").where("policy = 'v1'").collect()}
    for name in quality.POLICIES["v1"]:
        bit = quality.mask((name,))
        assert (table[name].fails, table[name].only_it, table[name].kept_without) == (sum(b & bit > 0 for b in bits), sum(b & whole == bit for b in bits), sum(not b & whole & ~bit for b in bits))
    assert quality.judge(rows, "v1").where("kept").count() == sum(not b & whole for b in bits)


def test_labelled_documents(spark):
    """Of the good documents that pass the base rules all stay; most of the bad ones go."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_report(docs).join(labels, "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1 and not r.base_failed)
    bad = [r for r in rows if r.quality == 0]
    assert sum(not r.kept for r in bad) > 0.9 * len(bad)


def test_odd_rows(odd_documents):
    rows = quality.quality_report(odd_documents).collect()
    assert len(rows) == 9 and all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    kept = quality.keep(odd_documents)
    assert kept.columns == odd_documents.columns and quality.keep(odd_documents.limit(0)).count() == 0


def test_short_clean_documents_stay_under_the_second_policy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.keep(docs, "v2").collect()}
    rows = [r for r in labels.collect()]
    assert all(r.doc_id in kept for r in rows if r.quality == 1)
    assert sum(r.doc_id not in kept for r in rows if r.quality == 0) > 0.9 * sum(r.quality == 0 for r in rows)


@pytest.mark.parametrize("query", [op3_quality_rules, quality_ablation])
def test_query_against_sql(spark, query):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    want = con.sql(ORACLES[query.__name__]).df()
    got = query(spark, "/root/testdata/sf0.001").toPandas()
    order = sorted(got.columns)
    assert sorted(map(tuple, got[order].values.tolist())) == sorted(map(tuple, want[order].values.tolist()))
