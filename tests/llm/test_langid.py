import math
import zlib

import numpy as np
import pytest

from medloom.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert rows.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    held = [d for d in rows if rows[d].held_out]
    assert sum(rows[d].lang_pred == truth[d] for d in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert sum(r.rejected for r in rows.values()) <= 0.002 * len(rows)


def test_lang_is_no_input(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    other = docs.selectExpr("doc_id + 1000 AS doc_id", "text", "'zz' AS lang", "'q' AS source", "n_chars")
    a = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    b = {r.doc_id - 1000: r.lang_pred for r in langid.identify(other, model).collect()}
    assert a == b


def test_odd_rows(spark, odd_documents, documents):
    rows = {r.doc_id: r for r in langid.identify(odd_documents).collect()}
    assert len(rows) == 8 and all(rows[d].lang_pred == "und" and rows[d].score == 0 for d in (1, 2, 3))
    assert rows[4].lang_pred in ("en", "de")
    digits = spark.createDataFrame([(1, "123 !?", "en")], "doc_id long, text string, lang string")
    assert langid.identify(digits, langid.fit(documents)).first().lang_pred == "und"
    none = spark.createDataFrame([(1, "words", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(none).collect()} == {"und"}
    assert langid.identify(odd_documents.limit(0)).count() == 0


def test_keep(spark, documents, odd_documents):
    model = langid.fit(documents)
    assert langid.keep(documents, model).count() == documents.count()
    kept = langid.keep(odd_documents, model)
    assert kept.columns == odd_documents.columns and not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    unlabelled = documents.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    truth = {r.doc_id: r.lang for r in documents.collect()}
    labelled = langid.keep(unlabelled, model).collect()
    assert sum(r.lang == truth[r.doc_id] for r in labelled) >= 0.98 * len(labelled)
    noise = documents.selectExpr("doc_id", "repeat('0123 ### ', 20) AS text", "lang", "source", "n_chars")
    assert langid.keep(noise, model).count() == 0


def test_subwords_do_not_cross_spaces():
    assert set(langid.buckets("ab cd")) == set(langid.buckets("ab")) | set(langid.buckets("cd"))
    assert len(langid.buckets("")) == len(langid.buckets("12 .")) == len(langid.buckets(None)) == 0
    assert set(langid.buckets("ÀB")) == set(langid.buckets("àb"))


UNLEARNED = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
    "zh": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心。",
    "letters": "qzx vkwro jjpq xxzvma wqkj zzpt bgrf yuoqw nnbd kkcxz pmwv ttqghj ouiy zrrk",
}


def test_unlearned_languages_are_rejected(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        model = langid.fit(docs)
        assert {k for k, text in UNLEARNED.items() if not model.predict(text)[2]} == set()
        held = [r.text for r in docs.where(langid.held_out(docs.doc_id)).collect()]
        assert sum(model.predict(t)[2] for t in held) <= 0.01 * len(held)


def slow_buckets(text):
    """The hashed subwords of two to four characters, one at a time."""
    letters = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in f" {text} "]
    u32 = 0xFFFFFFFF
    out = []
    for n in langid.SIZES:
        for i in range(len(letters) - n + 1):
            part = letters[i : i + n]
            if " " in part[1:-1] or part == [" "] * n or (n == 2 and part == [" ", " "]):
                continue
            h = (ord(part[0]) * 0x9E3779B1) & u32
            for c in part[1:]:
                h = ((h * 0x85EBCA6B) & u32) ^ ((ord(c) * 0x9E3779B1) & u32)
            h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & u32
            out.append(h >> (32 - langid.BITS))
    return out


@pytest.mark.parametrize("text", ["a", "ab c", "Straße, 12 Äpfel & Ω!", "x  y\nlong words here", "éà", "İi"])
def test_buckets_one_by_one(text):
    assert sorted(langid.buckets(text).tolist()) == sorted(slow_buckets(text))


def slow_train(texts, labels, dim=4, epochs=2, rate=0.5, bits=8, seed=7, per_language=5):
    """SGD with plain loops; the same order of rows and start."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    chosen = []
    for lang in languages:
        own = [k for k in range(len(texts)) if labels[k] == lang]
        share = min(0.8, per_language / len(own))
        chosen += [k for i, k in enumerate(own) if math.ceil((i + 1) * share) > math.ceil(i * share)]
    embed = rng.normal(0, 1 / dim, (1 << bits, dim)).astype(np.float32).astype(float).tolist()
    layer, bias = [[0.0] * len(languages) for _ in range(dim)], [0.0] * len(languages)
    step = 0
    for _ in range(epochs):
        for k in rng.permutation(len(chosen)):
            found = langid.buckets(texts[chosen[k]], bits).tolist()
            y = languages.index(labels[chosen[k]])
            now = rate * (1 - step / (epochs * len(chosen)))
            step += 1
            mean = [sum(embed[b][d] for b in found) / len(found) for d in range(dim)]
            logits = [sum(mean[d] * layer[d][j] for d in range(dim)) + bias[j] for j in range(len(languages))]
            e = [math.exp(x - max(logits)) for x in logits]
            grad = [x / sum(e) - (j == y) for j, x in enumerate(e)]
            back = [sum(layer[d][j] * grad[j] for j in range(len(languages))) for d in range(dim)]
            for d in range(dim):
                for j in range(len(languages)):
                    layer[d][j] -= now * mean[d] * grad[j]
            for j in range(len(languages)):
                bias[j] -= 0.1 * now * grad[j]
            for b in set(found):
                for d in range(dim):
                    embed[b][d] -= 20 * now * found.count(b) / len(found) * back[d]
    return np.array(embed) @ np.array(layer), np.array(bias)


def test_training_and_prediction_the_slow_way(documents):
    rows = [r for r in documents.orderBy("doc_id").limit(60).collect() if r.text and len(r.text) < 3000][:40]
    texts, labels = [r.text for r in rows], [r.lang for r in rows]
    model = langid.train(texts, labels, dim=4, steps=22, bits=8, per_language=5)
    table, bias = slow_train(texts, labels)
    assert np.allclose(model.table, table, atol=1e-3) and np.allclose(model.bias, bias, atol=1e-4)
    whole = langid.fit(documents)
    for r in rows:
        found = slow_buckets(r.text)
        logits = (sum(whole.table[b] for b in found) / len(found) + whole.bias) / whole.temperature
        e = [math.exp(x - max(logits)) for x in logits]
        known = max(sum(whole.known[b] for b in found) / len(found))
        lang, score, rejected = whole.predict(r.text)
        assert lang == whole.languages[int(np.argmax(logits))] and abs(score - max(e) / sum(e)) < 1e-9
        assert rejected == (score < whole.reject_below or known < whole.least_known)


def test_calibration_is_inside_its_grid(spark):
    for sf in ("sf0.001", "sf0.01"):
        model = langid.fit(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
        assert 0.02 < model.temperature < 50 and 0 < model.reject_below < 1 and np.isfinite(model.least_known)
