"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased, everything but letters becomes a space, and the subwords of two to four
characters within a word (with its edges) are hashed into buckets.  The mean of the buckets'
embeddings goes through a linear layer and a softmax.  Embeddings and layer are learned by stochastic
gradient descent in numpy on a bounded sample of labelled rows; temperature and rejection are set on
the part of the sample that training did not see.  The temperature minimises the loss against labels
smoothed by the number of unseen texts, so that it stays finite where these are told apart perfectly.
A softmax only tells learned languages from each other, so rejection goes by familiarity as well: the
mean log frequency of a text's subwords in the language where they are most frequent.  Both thresholds
lie between unseen texts in learned languages and negatives made of them (with shuffled letters, and
for familiarity each judged by the other languages only, too), and reject at most the stated share of
the unseen texts.  For prediction embeddings and layer are multiplied out once, so a text costs one
gather per subword.  Texts are predicted whole; only the texts learned from are cut.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.llm.common import fraction_hash, map_batches

BITS = 16
#: About so many labelled rows of each language are learned from, and so many more calibrate (expected
#: sizes of a hash sample); at most so many characters of each, and of so many languages, the most frequent.
PER_LANGUAGE, CALIBRATION, CHARACTERS, LANGUAGES = 400, 600, 2000, 256
SIZES = (2, 3, 4)
#: The share of unseen texts in learned languages that may be rejected, half of it by either threshold.
FALSE_REJECTIONS = 0.001


@cache
def _lower() -> np.ndarray:
    """Code point -> its lower-case letter, or a space."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (s := chr(c)).isalpha():
            out[c] = ord(low) if len(low := s.lower()) == 1 else c
    return out


def buckets(text: str | None, bits: int = BITS) -> np.ndarray:
    """The hashed subwords of a whole text; empty if it has no letters."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "replace"), "<u4")
    codes = np.full(len(raw) + 2, 32, np.uint32)
    codes[1:-1] = _lower()[raw]
    space = codes == 32
    if space.all():
        return np.empty(0, np.int32)
    found = []
    mixed = codes * np.uint32(0x9E3779B1)
    value = mixed
    inner = np.zeros(len(codes), bool)
    for n in range(2, SIZES[-1] + 1):
        value = (value[: len(codes) - n + 1] * np.uint32(0x85EBCA6B)) ^ mixed[n - 1 :]
        if n > 2:  # no space strictly inside
            inner = inner[: len(codes) - n + 1] | space[n - 2 : len(codes) - 1]
        else:
            inner = np.zeros(len(codes) - 1, bool)
        edge = space[: len(codes) - n + 1] & space[n - 1 :] if n == 2 else inner
        ok = ~(inner | edge)
        h = value[ok]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found.append((h >> np.uint32(32 - bits)).astype(np.int32))
    return np.concatenate(found)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket -> logits, embeddings times layer
    bias: np.ndarray
    temperature: float
    reject_below: float
    #: Bucket -> bits by which it is more frequent in each language than if all buckets were alike.
    known: np.ndarray
    least_known: float

    def __post_init__(self) -> None:
        self.both = np.hstack([self.table, self.known])

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language or ``und``, calibrated probability, rejected)."""
        at = buckets(text)
        if not len(at) or not self.languages:
            return "und", 0.0, True
        counts = np.bincount(at, minlength=0)
        if len(counts) < len(at):
            used = np.flatnonzero(counts)
            sums = counts[used] @ self.both[used]
        else:
            sums = self.both[at].sum(axis=0)
        logits, known = np.split(sums / len(at), 2)
        p = _softmax((logits + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.reject_below or known.max() < self.least_known)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _shuffled(text: str, rng: np.random.Generator) -> str:
    """The text with its letters dealt anew over their places."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").copy()
    letters = np.flatnonzero(_lower()[codes] != 32)
    codes[letters] = codes[rng.permutation(letters)]
    return codes.tobytes().decode("utf-32-le")


def _cut(positive: list[float], negative: list[float]) -> float:
    """The least value that passes: half-way between both kinds (the negatives' highest hundredth apart),
    but no more than half the rate ``FALSE_REJECTIONS`` of the positive ones fail."""
    if not positive:
        return -np.inf
    least = float(np.quantile(positive, FALSE_REJECTIONS / 2, method="lower"))
    return min(least, 0.5 * (least + float(np.quantile(negative, 0.99)))) if negative else least


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of the least loss, each label smoothed by 1 / (texts + 2)."""
    if not len(truth) or logits.shape[1] < 2:
        return 1.0
    soft = 1 / (len(truth) + 2)
    target = np.full(logits.shape, soft / (logits.shape[1] - 1))
    target[np.arange(len(truth)), truth] = 1 - soft
    tried = np.geomspace(0.01, 100, 160)
    return float(tried[int(np.argmin([-(target * np.log(_softmax(logits / t) + 1e-300)).sum() for t in tried]))])


def train(texts: list[str], labels: list[str], dim: int = 16, steps: int = 6000, rate: float = 0.5, bits: int = BITS, seed: int = 7, per_language: int = PER_LANGUAGE) -> Model:
    """SGD over ``per_language`` rows of each language, or four fifths of its rows if it has fewer; the
    others calibrate temperature and rejection.  At least ``steps`` steps in whole epochs are made."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1, 0), np.float32), np.zeros(0), 1.0, 0.0, np.zeros((1, 0)), 0.0)
    at = {x: k for k, x in enumerate(languages)}
    rows = []
    for text, label in zip(texts, labels, strict=True):
        found = buckets(text, bits)
        if len(found):
            used, counts = np.unique(found, return_counts=True)
            rows.append((used, (counts / len(found)).astype(np.float32), at[label], len(found), text))
    rng = np.random.default_rng(seed)
    shown, held = [], []
    for y in range(len(languages)):
        own = [r for r in rows if r[2] == y]
        share = min(0.8, per_language / max(1, len(own)))
        for k, row in enumerate(own):  # spread evenly, the first is learned
            (shown if math.ceil((k + 1) * share) > math.ceil(k * share) else held).append(row)
    embed = rng.normal(0, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    # large steps: a mean over many subwords moves each embedding only a little
    epochs = -(-steps // max(1, len(shown)))
    step, total = 0, max(1, epochs * len(shown))
    for _ in range(epochs):
        for k in rng.permutation(len(shown)):
            used, weight, y, _, _ = shown[k]
            now = rate * (1 - step / total)
            step += 1
            mean = weight @ embed[used]
            grad = _softmax(mean @ layer + bias)
            grad[y] -= 1
            back = layer @ grad
            layer -= now * np.outer(mean, grad)
            bias -= 0.1 * now * grad
            embed[used] -= (20 * now) * weight[:, None] * back
    table = (embed @ layer).astype(np.float64)
    bias = bias.astype(np.float64)
    frequency = np.zeros((1 << bits, len(languages)))
    for used, weight, y, n, _ in shown:
        frequency[used, y] += weight * n
    known = np.log2((frequency + 0.1) / (frequency.sum(axis=0) + 0.1 * (1 << bits))) + bits
    # both measures of the unseen texts, and of the negatives made of them
    logits = np.array([w @ table[u] + bias for u, w, *_ in held]).reshape(-1, len(languages))
    temperature = _temperature(logits, np.array([r[2] for r in held], int))
    sure, unsure, near, far = [], [], [], []
    shuffler = np.random.default_rng(seed + 1)
    for (used, weight, y, _, text), own in zip(held, logits, strict=True):
        found = weight @ known[used]
        sure.append(float(_softmax(own / temperature).max()))
        near.append(float(found.max()))
        if len(languages) > 1:
            far.append(float(np.delete(found, y).max()))
        mixed = buckets(_shuffled(text, shuffler), bits)
        unsure.append(float(_softmax((table[mixed].mean(axis=0) + bias) / temperature).max()))
        far.append(float(known[mixed].mean(axis=0).max()))
    reject = _cut(sure, unsure) if len(languages) > 1 else 0.0
    return Model(languages, table, bias, temperature, reject, known, _cut(near, far))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, calibration: int = CALIBRATION) -> Model:
    """A model from about ``per_language`` rows of each lang value, none of them held out; about
    ``calibration`` more of each set temperature and rejection.

    Rows are picked by a hash of doc_id at a rate set from each language's count; four times the
    expected number is a hard limit, so at most that many texts of ``CHARACTERS`` reach the driver.
    Null ids, texts and languages teach nothing.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    wanted = per_language + calibration
    rates = docs.sparkSession.createDataFrame([(r.lang, min(1.0, wanted / r.n)) for r in counts], "lang string, rate double")
    picked = usable.join(F.broadcast(rates), "lang").where(fraction_hash(F.col("doc_id"), "language") < F.col("rate"))  # at most LANGUAGES rows
    sample = picked.select("doc_id", "lang", F.substring("text", 1, CHARACTERS).alias("text")).limit(4 * wanted * max(1, len(counts)))
    rows = sorted(((r.doc_id, r.lang, r.text) for r in sample.collect()), key=lambda r: (r[0], r[1], r[2]))
    return train([r[2] for r in rows], [r[1] for r in rows], per_language=per_language)


def _predictor(docs: DataFrame, model: Model, text: str, kept: list[str] | None, lang: str | None = None):
    handed = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        one = handed.value

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = [one.predict(t) for at in range(0, batch.num_rows, 64) for t in batch.column(text).slice(at, 64).to_pylist()]
            if kept is None:
                stays = pa.array([not x[2] for x in found], pa.bool_())
                if lang and batch.num_rows:
                    k = batch.schema.names.index(lang)
                    batch = batch.set_column(k, batch.schema.field(k), pc.coalesce(batch.column(k), pa.array([x[0] for x in found], batch.schema.field(k).type)))
                yield batch.filter(stays)
            elif found:
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True))], [*kept, "lang_pred", "score", "rejected"])

        return work

    return make


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row.

    Texts without letters (null texts among them) are ``und`` with score 0.  Without any labelled row
    nothing can be learned, and every text is ``und``.
    """
    model = model or fit(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_batches(rows, _predictor(rows, model, "text", ["doc_id", "held_out"]), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs without the rows that the model rejects, and with the predicted language where ``lang`` is null; all columns stay."""
    model = model or fit(docs)
    names = docs.columns
    inner = docs.select(*[F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)])
    schema = ", ".join(f.simpleString().replace(":", " ", 1) for f in inner.schema)
    out = map_batches(inner, _predictor(inner, model, f"c{names.index('text')}", None, f"c{names.index('lang')}" if dict(docs.dtypes).get("lang") == "string" else None), schema)
    return out.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)])
