import re

import corpus_pipeline
from medloom.llm import langid, quality


def _shingles(text):
    words = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages(spark, documents):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == documents.columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    model = langid.fit(documents)
    assert seen["language"].keys() == {r.doc_id for r in documents.collect() if not model.predict(r.text)[2]}
    whole = quality.mask(quality.POLICIES["v2"])
    ledger = {r.doc_id: r.failed for r in quality.ledger(documents).collect()}
    assert seen["quality"].keys() == {d for d in seen["language"] if not ledger[d] & whole}
    ids = sorted(seen["quality"])
    sets = [_shingles(seen["quality"][d]) for d in ids]
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if group[i] != group[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    assert seen["near_duplicates"].keys() == {ids[g] for g in group} and len(set(group)) < len(ids)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r.doc_id for r in packed.select("doc_id").collect()} == seen["near_duplicates"].keys()


def test_odd_rows(spark, odd_documents):
    docs = odd_documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == odd_documents.columns
    assert {r.doc_id for r in docs.collect()} <= {4, None, 6}  # blanks, copies and near copies are gone
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_documents.limit(0), "").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0 and corpus_pipeline.ORACLE_SQL is None
