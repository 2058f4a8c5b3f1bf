"""Model-extracted records: parsing, flattening, and rounds over chunks with resume."""

from __future__ import annotations

import itertools
import json
import random
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.session import settled

SUMMARY = "clinical_summary"
ROUND_SCHEMA = "patient_id string, round int, extraction string, num_chunks int"
#: Seconds between two calls at most.
LONGEST_WAIT = 60.0
REASONING_END = "assistantfinal"


class Model(Protocol):
    def generate(self, prompt: str, system: str = "", max_tokens: int = 8000, temperature: float = 0.0) -> str: ...


def strip_reasoning(text: str) -> str:
    """What follows the first end-of-reasoning mark, or all of it."""
    return text.split(REASONING_END, 1)[-1].strip() if REASONING_END in text else text


_DECODER = json.JSONDecoder()


def parse_json_list(text: str) -> list | None:
    """The longest JSON array that begins at any opening bracket of a model's answer; None if there is none."""
    best, length, at = None, 0, text.find("[")
    while at >= 0:
        try:
            found, end = _DECODER.raw_decode(text, at)
        except (ValueError, RecursionError):
            end = at + 1
        else:
            if end - at > length:
                best, length = found, end - at
        at = text.find("[", end)
    return best


def wrap_summary(summary: str) -> str:
    return json.dumps([{SUMMARY: {"summary": summary}}])


def unwrap_summary(extraction: Column) -> Column:
    return F.get_json_object(extraction, f"$[0].{SUMMARY}.summary")


def is_summary_only(ontology_ids: Sequence[str]) -> bool:
    return bool(ontology_ids) and all(o == SUMMARY for o in ontology_ids)


def validate_extraction(entries: Any, categories: Sequence[str]) -> list[str]:
    """What is wrong with a list of single-key entries."""
    if not isinstance(entries, list):
        return ["the extraction must be a list"]
    errors = []
    for k, entry in enumerate(entries):
        if not isinstance(entry, dict) or len(entry) != 1:
            errors.append(f"Entry {k}: must be a single-key dictionary")
        elif (name := next(iter(entry))) not in categories:
            errors.append(f"Entry {k}: unknown category '{name}'")
    return errors


def flatten_long(extractions: DataFrame, pid: str = "patient_id", column: str = "extraction") -> DataFrame:
    """(patient, entry_no, category, field, value) from JSON lists; entries that aren't single-key objects
    of objects are left out, an entry without fields keeps one row with a null field.

    Variants keep odd entries from spoiling the rest of a list.
    """
    parsed = extractions.select(pid, F.try_parse_json(F.col(column)).alias("_v")).where("schema_of_variant(_v) LIKE 'ARRAY%'")
    spark = extractions.sparkSession
    entries = spark.sql("SELECT t.*, e.pos AS entry_no, e.value AS _e FROM {rows} AS t, LATERAL variant_explode(t._v) AS e", rows=parsed).drop("_v").where("schema_of_variant(_e) LIKE 'OBJECT%'")
    pairs = entries.withColumn("_m", F.expr("try_variant_get(_e, '$', 'map<string,variant>')")).where("size(_m) = 1")
    named = pairs.select(pid, "entry_no", F.map_keys("_m")[0].alias("category"), F.map_values("_m")[0].alias("_a")).where("schema_of_variant(_a) LIKE 'OBJECT%'")
    fields = named.withColumn("_f", F.expr("try_variant_get(_a, '$', 'map<string,variant>')")).select(pid, "entry_no", "category", F.explode_outer("_f").alias("field", "_x"))
    listed = F.expr("array_join(transform(try_variant_get(_x, '$', 'array<variant>'), y -> try_variant_get(y, '$', 'string')), '; ')")
    return fields.select(pid, "entry_no", "category", "field", F.when(F.expr("schema_of_variant(_x) LIKE 'ARRAY%'"), listed).otherwise(F.expr("try_variant_get(_x, '$', 'string')")).alias("value"))


def flatten_wide(long: DataFrame, fields: Sequence[str] | None = None, pid: str = "patient_id") -> DataFrame:
    """One row per entry, a string column per field (the distinct names, or those given)."""
    names = list(fields) if fields is not None else sorted(r[0] for r in long.where("field IS NOT NULL").select("field").distinct().collect())
    values = F.map_from_entries(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "value"))))
    rows = long.groupBy(pid, "entry_no", "category").agg(values.alias("_f"))
    return rows.select(pid, "category", *[F.try_element_at("_f", F.lit(n)).alias(n) for n in names])


def first_prompt(chunk: str, instructions: str) -> str:
    return f"{instructions}\n\nNotes:\n{chunk}\n\nAnswer with a JSON list of single-key objects."


def update_prompt(chunk: str, instructions: str, state: str) -> str:
    return f"{instructions}\n\nFound so far:\n{state}\n\nFurther notes:\n{chunk}\n\nAnswer with the whole updated JSON list."


def extract_one(model: Model, chunk: str, state: str | None, instructions: str, summary_only: bool = False, retries: int = 10, wait: float = 0.0) -> str | None:
    """The new state; the old one if the model fails or never answers with a list.

    After a failing call the next one waits for ``wait`` seconds, twice as long each time up to ``LONGEST_WAIT``, less a random part.
    """
    prompt = update_prompt(chunk, instructions, state) if state else first_prompt(chunk, instructions)
    failed = 0
    for _ in range(retries):
        try:
            answer = strip_reasoning(model.generate(prompt))
        except Exception:  # noqa: BLE001  a failing backend must not lose what is known
            time.sleep(min(LONGEST_WAIT, wait * 2**failed) * random.uniform(0.5, 1.0))
            failed += 1
            continue
        if summary_only:
            return wrap_summary(answer)
        if (found := parse_json_list(answer)) is not None:
            return json.dumps(found, ensure_ascii=False)
    return state


def side_by_side(work: Callable[..., Any], rows: Iterable[tuple], threads: int) -> Iterator[Any]:
    """Results of calls in the order of their rows, at most ``threads`` at a time and twice as many begun or held."""
    waiting: deque = deque()
    with ThreadPoolExecutor(threads) as pool:
        for row in rows:
            waiting.append(pool.submit(work, *row))
            if len(waiting) >= 2 * threads:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


#: Slices of a round at most; beyond, slices grow.
MOST_SLICES = 1000


class Rounds:
    """Round r gives chunk r of every patient to the model.

    At most ``workers`` requests run at a time, ``threads`` of them side by side in a task.  A round is asked in slices of
    ``workers * each`` patients or so.  A task publishes its answers when it ends, not when
    its slice or round does, so a job that fails loses no finished task's answers: patients that a round lacks are pending, all
    others are not asked again.  On a file system without rename a slice is published instead.  Rounds build on each
    other only through the tables, so a run can stop and go on at any time.
    """

    def __init__(self, spark: SparkSession, folder: str, instructions: str = "", summary_only: bool = False, workers: int = 8, retries: int = 10, each: int = 8, threads: int = 4, wait: float = 0.5):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.instructions, self.summary_only, self.workers, self.retries, self.each = instructions, summary_only, workers, retries, each
        self.threads, self.wait = min(threads, workers), wait

    def saved(self) -> DataFrame:
        """All written records (bad lines aside), with their place."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], ROUND_SCHEMA + ", seq long")
        rows = self.spark.read.schema(ROUND_SCHEMA).option("recursiveFileLookup", "true").json(self.folder)
        return rows.where("patient_id IS NOT NULL").withColumn("seq", F.monotonically_increasing_id())

    def clean(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def latest(self) -> DataFrame:
        """The last state of each patient: highest round, then the last record."""
        return last_wins(self.saved())

    def progress(self, chunks: DataFrame) -> DataFrame:
        """(round, expected, done): how far each round has come."""
        return round_progress(chunks, self.saved())

    def pending(self, chunks: DataFrame) -> list[int]:
        """The rounds that still lack a patient, in order; none if all is done.  One number for each round."""
        return [r["round"] for r in self.progress(chunks).where("done < expected").orderBy("round").collect()]

    def run(self, chunks: DataFrame, model: Callable[[int], Model], resume: bool = True) -> DataFrame:
        """All rounds that are not done; ``model(task)`` makes a client in each task, so tasks can spread over backends."""
        if not resume:
            self.clean()
        for r in self.pending(chunks):
            done = self.saved().where(F.col("round") == r).select("patient_id").distinct()
            todo = chunks.where(F.col("chunk_index") == r).join(done, "patient_id", "left_anti")
            state = last_wins(self.saved().where(F.col("round") < r)).select("patient_id", F.col("extraction").alias("state"))
            work = todo.join(state, "patient_id", "left").select("patient_id", "chunk_text", "state", "total_chunks")
            slices = min(MOST_SLICES, max(1, -(-work.count() // (self.workers * self.each))))
            # fixed content: a slice must not ask whom an earlier one has answered for
            work = settled(work.withColumn("slice", F.pmod(F.xxhash64("patient_id"), F.lit(slices))), by="slice")
            for no in range(slices):
                asked = work.where(F.col("slice") == no).drop("slice").repartition(-(-self.workers // self.threads))
                answers = asked.mapInPandas(self._work(model, r), ROUND_SCHEMA)
                answers.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").json(f"{self.folder}/round={r:04d}")
        return self.latest()

    def _work(self, model: Callable[[int], Model], r: int):
        instructions, summary_only, retries, wait, threads = self.instructions, self.summary_only, self.retries, self.wait, self.threads

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = model(TaskContext.get().partitionId())
            ask = lambda c, s: extract_one(client, c, s if isinstance(s, str) else None, instructions, summary_only, retries, wait)
            for frame in frames:
                states = list(side_by_side(ask, zip(frame.chunk_text, frame.state, strict=True), threads))
                yield pd.DataFrame({"patient_id": frame.patient_id, "round": r, "extraction": states, "num_chunks": frame.total_chunks})

        return run


def last_wins(records: DataFrame) -> DataFrame:
    """The record of the highest round for each patient, the last of equals."""
    return records.groupBy("patient_id").agg(F.max_by(F.struct("round", "extraction", "num_chunks"), F.struct("round", "seq")).alias("_r")).select("patient_id", "_r.*")


def round_progress(chunks: DataFrame, saved: DataFrame) -> DataFrame:
    expected = chunks.groupBy(F.col("chunk_index").alias("round")).agg(F.countDistinct("patient_id").alias("expected"))
    done = saved.groupBy("round").agg(F.countDistinct("patient_id").alias("done"))
    return expected.join(done, "round", "left").select("round", "expected", F.coalesce("done", F.lit(0)).alias("done"))


def summaries(latest: DataFrame) -> DataFrame:
    return latest.select("patient_id", unwrap_summary(F.col("extraction")).alias("summary"))


def silver_labels(spark: SparkSession, chunks: DataFrame, folder: str, model: Callable[[int], Model], instructions: str = "", workers: int = 8, retries: int = 10) -> DataFrame:
    """(patient_id, extraction): a model's extractions to train against, made once.

    Labels that were stored are read back; a run that was cut off goes on with the rounds it lacks.
    """
    folder = folder.rstrip("/")
    stored = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/labels/_SUCCESS")
    if not stored.getFileSystem(spark._jsc.hadoopConfiguration()).exists(stored):
        latest = Rounds(spark, f"{folder}/rounds", instructions, workers=workers, retries=retries).run(chunks, model)
        latest.where("extraction IS NOT NULL").select("patient_id", "extraction").write.mode("overwrite").parquet(f"{folder}/labels")
    return spark.read.parquet(f"{folder}/labels")


class Paused(RuntimeError):
    """A server that failed too often is not asked for a while."""


class Breaker:
    """A client that is not called for ``pause`` seconds after ``failures`` calls in a row have failed; then one call tries it again."""

    def __init__(self, client: Model, failures: int = 3, pause: float = 30.0):
        self.client, self.failures, self.pause = client, failures, pause
        self._failed, self._until, self._lock = 0, 0.0, threading.Lock()

    def __getstate__(self) -> dict[str, Any]:
        return {n: v for n, v in self.__dict__.items() if n != "_lock"}

    def __setstate__(self, state: dict[str, Any]) -> None:
        self.__dict__.update(state, _lock=threading.Lock())

    @property
    def paused(self) -> bool:
        return time.monotonic() < self._until

    def generate(self, *args: Any, **options: Any) -> str:
        with self._lock:
            if self.paused:
                raise Paused
            if self._failed >= self.failures:  # others wait for what the trial says
                self._until = time.monotonic() + self.pause
        try:
            answer = self.client.generate(*args, **options)
        except Exception:
            with self._lock:
                self._failed += 1
                if self._failed >= self.failures:
                    self._until = time.monotonic() + self.pause
            raise
        with self._lock:
            self._failed, self._until = 0, 0.0
        return answer


class RoundRobin:
    """Calls to several clients in turn, paused ones left out; safe for threads."""

    def __init__(self, clients: Sequence[Model]):
        if not clients:
            raise ValueError("no clients")
        self.clients, self._next, self._lock = list(clients), itertools.cycle(range(len(clients))), threading.Lock()

    def generate(self, *args: Any, **options: Any) -> str:
        for _ in self.clients:
            with self._lock:
                at = next(self._next)
            if not getattr(self.clients[at], "paused", False):
                return self.clients[at].generate(*args, **options)
        raise Paused
