"""What answers teach, as streams: where an answer came from meets what came of it, within a span of time and with rows that come late or twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import events


def losses(provenance: DataFrame, outcomes: DataFrame, late: str = "1 hour", within: str = "7 days") -> DataFrame:
    """(expert, ask_id, ts, loss), append-only: -1 for each stream that brought a page that proved useful, 1 for one that did not.

    provenance: (ask_id, page, stream, at); outcomes: (ask_id, page, verdict, ts), of the pages that an answer cited. An outcome counts if it comes no later
    than ``within`` after the question. Rows that are ``late`` behind the newest are gone; repeated ones within that time count once, also a stream that
    brought several cited pages of one question. State is dropped as both clocks pass.
    """
    asked = provenance.withWatermark("at", late).dropDuplicatesWithinWatermark(["ask_id", "page", "stream"]).select(F.col("ask_id").alias("asked"), F.col("page").alias("brought"), "stream", "at")
    came = outcomes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["ask_id", "page"])
    met = came.join(asked, F.expr(f"ask_id = asked AND page = brought AND ts >= at AND ts <= at + INTERVAL {within}"))
    loss = F.when(F.col("verdict") == "useful", F.lit(-1.0)).otherwise(F.lit(1.0))
    return met.select(F.col("stream").alias("expert"), "ask_id", "ts", loss.alias("loss")).dropDuplicatesWithinWatermark(["expert", "ask_id"])


def learn(spark: SparkSession, provenance: str, outcomes: str, store: str, late: str = "1 hour", within: str = "7 days", eta: float = 0.25) -> DataFrame:
    """(expert, weight) after all that the two Parquet folders hold by now: losses are appended below ``store``, and weights follow those.

    Each run goes on where the last one stopped, also one that was broken off. A stream's pairs are given once both clocks have passed them, so the newest wait.
    """
    found = losses(events.read_events(spark, provenance), events.read_events(spark, outcomes), late, within)
    events.run_to_path(found, f"{store}/losses", f"{store}/losses-checkpoint")
    learned = events.expert_weights(events.read_events(spark, f"{store}/losses").select("expert", "ts", "loss"), eta)

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("expert", "weight", F.lit(number).cast("long").alias("turn")).write.mode("overwrite").parquet(f"{store}/weights/batch={number}")

    learned.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{store}/weights-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{store}/weights").groupBy("expert").agg(F.max_by("weight", "turn").alias("weight"))
