"""Field-level F1 between an extraction and its reference, and training examples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.operators.extraction import Model, Rounds, flatten_long
from medloom.operators.longnotes import chunk_patients
from medloom.operators.notes import PieceTokenizer, Tokenizer, concatenate

WRONG_VALUE = 0.25


def field_set(long: DataFrame, pid: str = "patient_id") -> DataFrame:
    """Distinct (patient, category, field, value), lower-cased and trimmed, without empty values."""
    text = lambda c: F.lower(F.trim(c))
    rows = long.select(pid, text("category").alias("category"), text("field").alias("field"), text("value").alias("value"))
    return rows.where("field IS NOT NULL AND value IS NOT NULL AND value <> ''").distinct()


def _credits(left: DataFrame, right: DataFrame, pid: str) -> DataFrame:
    """(patient, credit, n): for each left triple 1 if a right value equals or contains it (or is contained), a quarter for the field alone."""
    values = right.groupBy(pid, "category", "field").agg(F.collect_set("value").alias("values"))
    long = F.length("value") > 3
    match = F.exists("values", lambda v: (v == F.col("value")) | (long & (F.length(v) > 3) & (F.contains(v, F.col("value")) | F.contains(F.col("value"), v))))
    joined = left.join(values, [pid, "category", "field"], "left")
    credit = F.when(F.col("values").isNull(), 0.0).when(match, 1.0).otherwise(WRONG_VALUE)
    return joined.groupBy(pid).agg(F.sum(credit).alias("credit"), F.count(F.lit(1)).alias("n"))


def field_f1(extracted: DataFrame, reference: DataFrame, pid: str = "patient_id") -> DataFrame:
    """(patient, precision, recall, f1) of two long extractions; a patient without reference scores 1 if nothing was extracted."""
    ext, ref = field_set(extracted, pid), field_set(reference, pid)
    r = _credits(ref, ext, pid).select(pid, (F.col("credit") / F.col("n")).alias("recall"), F.col("n").alias("n_ref"))
    p = _credits(ext, ref, pid).select(pid, (F.col("credit") / F.col("n")).alias("precision"), F.col("n").alias("n_ext"))
    every = extracted.select(pid).union(reference.select(pid)).distinct()
    rows = every.join(r, pid, "left").join(p, pid, "left")
    no_ref, no_ext = F.col("n_ref").isNull(), F.col("n_ext").isNull()
    both = F.when(no_ref, F.when(no_ext, 1.0).otherwise(0.0))
    precision, recall = F.coalesce(both, F.col("precision"), F.lit(0.0)), F.coalesce(both, F.col("recall"), F.lit(0.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return rows.select(pid, precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def summary_rewards(
    spark: SparkSession,
    summaries: DataFrame,
    labels: DataFrame,
    folder: str,
    model: Callable[[int], Model],
    instructions: str = "",
    workers: int = 8,
    retries: int = 10,
    each: int = 8,
) -> DataFrame:
    """(patient_id, sample, reward): how much of its label each summary tells, by the F1 of what a model extracts from it.

    ``summaries`` has patient_id, summary and, where a patient has several, sample (a string; else null).
    Answers are kept in ``folder`` as rounds keep them: a run that was cut off goes on, one that has ended asks nobody.
    The reward is 0 without a label or an entry in it, for null and empty summaries, and where nothing is extracted.  Of rows
    with the same patient and sample the last summary in order of text counts.
    """
    sample = F.col("sample").cast("string") if "sample" in summaries.columns else F.lit(None).cast("string")
    one = summaries.select(F.col("patient_id").cast("string").alias("patient_id"), sample.alias("sample"), F.nullif(F.trim("summary"), F.lit("")).alias("summary"))
    one = one.groupBy("patient_id", "sample").agg(F.max("summary").alias("summary"))
    one = one.withColumn("key", F.to_json(F.struct("patient_id", "sample")))
    asked = one.where("summary IS NOT NULL").select(F.col("key").alias("patient_id"), F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), F.col("summary").alias("chunk_text"))
    answers = Rounds(spark, folder, instructions, workers=workers, retries=retries, each=each).run(asked, model)
    extracted = flatten_long(answers).withColumnRenamed("patient_id", "key")
    told = labels.select(F.col("patient_id").cast("string").alias("patient_id"), "extraction")
    reference = flatten_long(one.where("summary IS NOT NULL").select("patient_id", "key").join(told, "patient_id").select("key", "extraction"), "key")
    # both sides need an entry
    scores = field_f1(extracted, reference, "key").join(extracted.select("key"), "key", "left_semi").join(reference.select("key"), "key", "left_semi")
    return one.join(scores, "key", "left").select("patient_id", "sample", F.coalesce("f1", F.lit(0.0)).alias("reward"))


def training_examples(
    notes: DataFrame,
    labels: DataFrame,
    instructions: str,
    max_patients: int | None = None,
    pid: str = "patient_id",
    max_prompt_tokens: int | None = None,
    tokenizer: Callable[[], Tokenizer] = PieceTokenizer,
    text: str = "text",
    date: str = "date",
    kind: str = "note_type",
) -> DataFrame:
    """(patient, prompt, label): notes of patients that have a label, the first so many patients by id,
    notes cut to so many tokens (at least one); then no task holds more of a patient."""
    if max_patients is not None:  # of all patients with notes, as those without a label count, too
        first = notes.select(pid).distinct().orderBy(pid).limit(max_patients)
        notes = notes.join(first, pid, "left_semi")
    labels = labels.select(pid, F.col("extraction").alias("label"))
    if max_prompt_tokens is None:
        texts = concatenate(notes, pid, text, date, kind)
    else:  # the first chunk, wherever notes begin
        cut = chunk_patients(notes.join(labels, pid, "left_semi"), max_prompt_tokens, 0, tokenizer, pid, text, date, kind, window=0)
        texts = cut.where("chunk_index = 0").withColumnRenamed("chunk_text", "notes")
    return texts.join(labels, pid).select(pid, F.format_string("%s\n\nNotes:\n%s", F.lit(instructions), F.col("notes")).alias("prompt"), "label")
