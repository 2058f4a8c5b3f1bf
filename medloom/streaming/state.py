"""Streams: event counts in windows with late data, and the note state machine per patient."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.operators.extraction import Model, extract_one


def window_counts(events: DataFrame, time: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and type; state older than the watermark is let go."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    windows = F.window("_t", width, slide) if slide else F.window("_t", width)
    return timed.groupBy(windows.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, time: str = "ts", by: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.session_window("_t", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def patient_states(chunks: DataFrame, model: Callable[[], Model], instructions: str = "") -> DataFrame:
    """A stream of (patient_id, chunk_index, chunk_text) folded into each patient's extraction; emits the new state."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        now, seen = state.get if state.exists else (None, 0)
        client = model()
        for frame in frames:
            for chunk in frame.sort_values("chunk_index").chunk_text:
                now, seen = extract_one(client, chunk, now, instructions), seen + 1
        state.update((now, seen))
        yield pd.DataFrame({"patient_id": [key[0]], "extraction": [now], "chunks": [seen]})

    return chunks.groupBy("patient_id").applyInPandasWithState(fold, "patient_id string, extraction string, chunks long", "extraction string, chunks long", "update", "NoTimeout")
