"""Streams give what batches give."""

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from medloom.streaming import state

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Echo:
    def generate(self, prompt, **_):
        seen = json.loads(prompt.split("Found so far:\n")[1].split("\n\n")[0]) if "Found so far:" in prompt else []
        return json.dumps([*seen, {"n": {"k": str(len(seen))}}])


def test_window_counts_on_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = tmp_path / "in"
    events.write.parquet(str(source))
    stream = state.window_counts(spark.readStream.schema(events.schema).parquet(str(source)), late="0 seconds")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    run.processAllAvailable()
    run.stop()
    want = state.window_counts(events).select("start", "event_type", "n").collect()
    assert sorted(map(tuple, spark.table("counts").select("start", "event_type", "n").collect())) == sorted(map(tuple, want))


def test_patient_states(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "patient_id string, chunk_index int, chunk_text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = state.patient_states(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), Echo)
    run = stream.writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "ck")).start()
    run.processAllAvailable()
    run.stop()
    assert {r.patient_id: r.chunks for r in spark.table("states").collect()} == {"a": 2, "b": 1}


def test_sessions(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert state.sessions(events).agg(F.sum("n")).first()[0] == events.count()
