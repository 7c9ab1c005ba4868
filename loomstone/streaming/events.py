"""Event streams: closed vocabulary, counts, the accessibility ladder and expert weights as keyed state.

The last two keep one small struct for a key, so state grows with keys and not with events.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cognitive import EXERCISE_LEVEL, LEVELS

VOCABULARY = ("click", "error", "purchase", "signup", "view")


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Events of a Parquet folder, or of one file: the pattern lets the source take either."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def known_only(events: DataFrame, kinds: tuple[str, ...] = VOCABULARY) -> DataFrame:
    return events.filter(F.col("event_type").isin(*kinds))


def counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """An extension: event-time windows with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there and returns the result (small ones: it is held by the driver)."""
    name = f"stream_{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_path(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an append-only stream over what is there into a Parquet folder; a run that was cut off goes on from its checkpoint."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    return stream.sparkSession.read.parquet(path)


def ladder(attempts: DataFrame) -> DataFrame:
    """(item, level, streak, attempts) after each batch, from (item, at, exercise, result)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rung, streak, n = state.get if state.exists else (0, 0, 0)
        for at, exercise, result in sorted((r for b in batches for r in b[["at", "exercise", "result"]].itertuples(index=False, name=None)), key=lambda r: r[0]):
            n += 1
            if result == "success":
                rung, streak = max(rung, LEVELS.index(EXERCISE_LEVEL[exercise])), streak + 1
            elif result == "failure":
                streak = 0
        state.update((rung, streak, n))
        yield pd.DataFrame({"item": [key[0]], "level": [LEVELS[rung]], "streak": [streak], "attempts": [n]})

    return attempts.groupBy("item").applyInPandasWithState(step, "item long, level string, streak long, attempts long", "rung long, streak long, n long", "update", GroupStateTimeout.NoTimeout)


def expert_weights(facts: DataFrame, eta: float = 0.25) -> DataFrame:
    """(expert, weight) after each batch, from (expert, ts, loss)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        w = state.get[0] if state.exists else 1.0
        for _, loss in sorted(r for b in batches for r in b[["ts", "loss"]].itertuples(index=False, name=None)):
            w = min(2.0, max(0.5, w * math.exp(-eta * loss)))
        state.update((w,))
        yield pd.DataFrame({"expert": [key[0]], "weight": [w]})

    return facts.groupBy("expert").applyInPandasWithState(step, "expert string, weight double", "w double", "update", GroupStateTimeout.NoTimeout)
