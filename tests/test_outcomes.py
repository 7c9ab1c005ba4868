"""Outcomes as streams against the batch operator: late and repeated rows, several pages of one stream, and going on from a checkpoint."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loomstone.operators import readmodels
from loomstone.streaming import outcomes

START = datetime(2024, 1, 1)
PROVENANCE, OUTCOMES = "ask_id long, page string, stream string, at timestamp", "ask_id long, page string, verdict string, ts timestamp"


def test_streams_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    came, said = [], []
    for ask in range(40):
        at = START + timedelta(hours=2 * ask)
        pages = rng.sample("abcdef", 3)
        came += [(ask, p, s, at) for p in pages for s in rng.sample(["fts", "graph", "entity"], 2)]
        if rng.random() < 0.8:
            verdict = rng.choice(["useful", "useless"])
            said += [(ask, p, verdict, at + timedelta(minutes=rng.randrange(50))) for p in pages[:2]]
    said.append((3, "a", "useful", START + timedelta(days=40)))  # long after the question
    paths = {n: str(tmp_path / n) for n in ("provenance", "outcomes")}
    write = lambda name, rows, kind: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(paths[name])
    write("provenance", came[:120] + came[:30], PROVENANCE)  # the first thirty come twice
    write("outcomes", [r for r in said if r[0] < 20] + said[:9], OUTCOMES)
    first = outcomes.learn(spark, *paths.values(), str(tmp_path / "store"))
    assert first.count() <= 3
    write("provenance", came[120:], PROVENANCE)
    write("outcomes", [r for r in said if r[0] >= 20], OUTCOMES)
    outcomes.learn(spark, *paths.values(), str(tmp_path / "store"))
    # the clocks pass everything; an outcome of the first question comes again, far too late
    far = START + timedelta(days=60)
    write("provenance", [(9_000, "z", "fts", far)], PROVENANCE)
    write("outcomes", [(9_001, "z", "useful", far), (*said[0][:2], "useless", START)], OUTCOMES)
    weights = {r.expert: r.weight for r in outcomes.learn(spark, *paths.values(), str(tmp_path / "store")).collect()}
    in_time = [r for r in said if r[3] <= START + timedelta(hours=2 * r[0], days=7)]
    verdicts = spark.createDataFrame(in_time, OUTCOMES)
    provenance = spark.createDataFrame(came, PROVENANCE).dropDuplicates(["ask_id", "page", "stream"])
    want = readmodels.outcome_losses(verdicts.groupBy("ask_id").agg(F.min("ts").alias("ts"), F.min("verdict").alias("verdict")), provenance, verdicts.select("ask_id", "page"))
    got = spark.read.parquet(str(tmp_path / "store/losses"))
    pick = lambda df: sorted((r.expert, r.loss) for r in df.collect())
    assert pick(got) == pick(want) and len(pick(got)) > 30
    for expert, weight in weights.items():
        w = 1.0
        for r in sorted(got.filter(F.col("expert") == expert).collect(), key=lambda r: r.ts):
            w = min(2.0, max(0.5, w * math.exp(-0.25 * r.loss)))
        assert math.isclose(w, weight)
    again = {r.expert: r.weight for r in outcomes.learn(spark, *paths.values(), str(tmp_path / "store")).collect()}
    assert again == weights
