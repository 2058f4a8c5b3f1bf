"""Quality rules as a ledger of bit masks.

Every rule is evaluated once per document.  The ledger, which is stored, holds the measurements and
one long whose bit k is set if rule k fails; policies are versioned sets of rules, so a verdict is a
bit test, and an ablation (what would a policy keep without one of its rules?) is a sum over bit tests
in one pass for all policies.

Null texts have no words.  Words are runs without ASCII white space, lines are cut at line feeds.
Repeated rows have a row each, an empty table has none, and further columns are left alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.llm.common import map_batches, texts_of, written

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
_SPACE, _SYMBOLS, _UPPER, _MARKS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91)), b"!?"


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < n - 2:
            counts = Counter(windows)
            hit = np.fromiter((counts[w] > 1 for w in windows), bool, n - 2)
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + n - 2] |= hit
            repeated = int(covered.sum())
    return (n, len(text) - without(_SPACE), without(_SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), without(_UPPER), without(_MARKS))


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements


#: A rule's place is its bit; append only.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines"),
    Rule("upper_case", "100 * n_upper > 50 * word_chars"),
    Rule("marks", "100 * n_marks > 60 * n_words"),
    Rule("word_length", "word_chars > 16 * n_words OR 2 * word_chars < 3 * n_words"),
    Rule("no_words", "n_words = 0"),
    Rule("long_repeated_windows", "n_words >= 50 AND 100 * n_repeat_words > 50 * n_words"),
)
BASE = ("few_words", "repeated_windows")
_SHAPE = ("symbols", "duplicate_lines", "upper_case", "marks", "word_length")
#: Versioned policies: the rules that reject.  "v2" keeps short texts that nothing else speaks against.
POLICIES = {"base": BASE, "v1": (*BASE, *_SHAPE), "v2": ("no_words", "long_repeated_windows", *_SHAPE)}


def mask(names: tuple[str, ...]) -> int:
    at = {r.name: k for k, r in enumerate(RULES)}
    return sum(1 << at[n] for n in names)


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """docs (names that do not clash with MEASURES) with the measurements of ``text``."""
    schema = ", ".join(f.simpleString().replace(":", " ", 1) for f in docs.schema) + "".join(f", {m} long" for m in MEASURES)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = [measure(t) for part in texts_of(batch, text) for t in part]
            found = np.array(rows, np.int64).reshape(len(rows), len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[:, k]) for k in range(len(MEASURES)))], [*batch.schema.names, *MEASURES])

        return work

    return map_batches(docs, make, schema)


def failures() -> Column:
    """The bits of the rules that fail, over the measurements."""
    return F.expr(" + ".join(f"IF({r.fails}, {1 << k}L, 0L)" for k, r in enumerate(RULES)))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``, the bits of the rules that fail; written once, so any
    number of policies and ablations read it without a text being measured again."""
    return written(_measured(docs.select("doc_id", "text"), "text").select("doc_id", *MEASURES, failures().alias("failed")), "ledger")


def judge(rows: DataFrame, policy: str, to: str = "kept") -> DataFrame:
    return rows.withColumn(to, F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def ablation(rows: DataFrame, *policies: str) -> DataFrame:
    """policy, rule, fails, only_it, kept_without for each rule of the policies: how many documents fail
    it, how many only it rejects, how many the policy keeps without it.  An empty ledger gives zeros."""
    sums, lines = [], []
    for policy in policies:
        whole = mask(POLICIES[policy])
        for name in POLICIES[policy]:
            bit, at = mask((name,)), len(lines)
            sums += [F.count_if(F.col("failed").bitwiseAND(bit) != 0).alias(f"f{at}"), F.count_if(F.col("failed").bitwiseAND(whole) == bit).alias(f"o{at}"), F.count_if(F.col("failed").bitwiseAND(whole & ~bit) == 0).alias(f"k{at}")]
            lines.append(f"'{policy}', '{name}', f{at}, o{at}, k{at}")
    return rows.agg(*sums).select(F.expr(f"stack({len(lines)}, {', '.join(lines)}) AS (policy, rule, fails, only_it, kept_without)"))


def keep(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """docs without the rows that the policy rejects; all columns stay."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)])
    kept = _measured(inner, f"c{names.index('text')}").where(failures().bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)
    return kept.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)])


def quality_report(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """One row per document: the measurements, base_failed, kept and the failure bits."""
    rows = judge(judge(ledger(docs), "base", "base_kept"), policy)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "failed")
