"""Usage facts to read models: outcomes, heat, overlay, budgets, calibration, learning of stream weights, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars


def outcome_ratios(outcomes: DataFrame) -> DataFrame:
    """(page, useful, bad) from (verdict, pages array)."""
    each = outcomes.select("verdict", F.explode("pages").alias("page"))
    return each.groupBy("page").agg(F.count_if(F.col("verdict") == "useful").alias("useful"), F.count_if(F.col("verdict").isin("dead_end", "corrected")).alias("bad"))


def heat(usage: DataFrame, ratios: DataFrame) -> DataFrame:
    """(page, score) from (page, reads, cites, age_days): recall of reads, citations and outcomes."""
    u = usage.join(ratios, "page", "left")
    total = F.coalesce("useful", F.lit(0)) + F.coalesce("bad", F.lit(0))
    outcome = F.when(total == 0, F.lit(0.5)).otherwise(F.col("useful") / total)
    recall = F.when(F.col("reads") <= 0, F.lit(0.0)).otherwise(scalars.logistic(scalars.activation(F.col("reads"), F.col("age_days"))))
    return u.select("page", (0.6 * recall + 0.2 * F.least(F.lit(1.0), F.col("cites") / 5) + 0.2 * outcome).alias("score"))


def overlay(ratios: DataFrame) -> DataFrame:
    """(page, status, useful, bad): fewer than three outcomes are tentative; good ones are looked at before bad ones."""
    n = F.col("useful") + F.col("bad")
    status = F.when(n < 3, "tentative").when(F.col("useful") / n >= 0.75, "preferred").when(F.col("bad") / n >= 0.5, "low_yield").otherwise("tentative")
    return ratios.select("page", status.alias("status"), "useful", "bad")


def usage_candidates(scored: DataFrame) -> DataFrame:
    """(kind, page, score): promote the ten hottest of the inbox above .6, archive what is cold and idle, list low yield.

    scored: (page, score, idle_days, status).
    """
    promote = scored.filter("page LIKE 'inbox/%' AND score > 0.6").orderBy(F.desc("score"), "page").limit(10)
    archive = scored.filter("score < 0.15 AND idle_days > 90")
    poor = scored.filter("status = 'low_yield'")
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "page", "score")
    return tag(promote, "promote").unionByName(tag(archive, "archive")).unionByName(tag(poor, "low_yield"))


def histogram(rows: DataFrame, column: str, width: float = 0.2, buckets: int = 5) -> DataFrame:
    return rows.groupBy(F.least(F.lit(buckets - 1), F.floor(F.col(column) / width)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def latest_by(rows: DataFrame, key: str, at: str, *columns: str, tie: str | None = None) -> DataFrame:
    """The last row of each key; ties by the greatest ``tie``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, *([tie] if tie else []))).alias("x")).select(key, "x.*")


def ring(rows: DataFrame, by: str, keep: int) -> DataFrame:
    """The newest ``keep`` rows."""
    return rows.orderBy(F.desc(by)).limit(keep)


def budget_left(ledger: DataFrame, day: str, daily: float, estimate: float) -> DataFrame:
    """One row (spent, left, allowed): spending of one UTC day against the daily budget."""
    spent = ledger.filter(F.to_date("ts") == F.lit(day)).agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("spent"))
    return spent.select("spent", F.greatest(F.lit(0.0), daily - F.col("spent")).alias("left")).withColumn("allowed", F.col("left") - estimate > 0)


def calibration(pairs: DataFrame) -> DataFrame:
    """One row (n, brier, overconfidence) of (p, outcome)."""
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("p") - F.col("outcome"), 2)).alias("brier"), (F.avg("p") - F.avg("outcome")).alias("overconfidence"))


def calibration_bins(pairs: DataFrame, bins: int = 5) -> DataFrame:
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p")))
    return pairs.groupBy(F.least(F.lit(bins - 1), F.floor(p * bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("outcome").alias("hit_rate"))


def strategy_patterns(asked: DataFrame, at_least: int = 5, gap: float = 0.15) -> DataFrame:
    """(strategy, n, rate, overall): strategies that do better than all questions together. asked: (strategy, useful 0/1)."""
    overall = asked.agg(F.avg("useful").alias("overall"))
    by = asked.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.avg("useful").alias("rate"))
    return by.crossJoin(F.broadcast(overall)).filter((F.col("n") >= at_least) & (F.col("rate") - F.col("overall") >= gap))


def load_pattern(asked: DataFrame, at_least: int = 5, gap: float = 0.15) -> DataFrame:
    """One row at most: the share of bad outcomes under high load beside that under low. asked: (load, bad 0/1)."""
    high = F.col("load") >= 4
    a = asked.agg(F.count_if(high).alias("n_high"), F.count_if(~high).alias("n_low"), F.avg(F.when(high, F.col("bad"))).alias("bad_high"), F.avg(F.when(~high, F.col("bad"))).alias("bad_low"))
    return a.filter((F.col("n_high") >= at_least) & (F.col("n_low") >= at_least) & (F.col("bad_high") - F.col("bad_low") >= gap))


def hedge(losses: Column, start: float = 1.0, eta: float = 0.25, floor: float = 0.5, ceiling: float = 2.0) -> Column:
    """Fold of an ordered array of losses: multiply by exp(-eta loss), clamp each time."""
    return F.aggregate(losses, F.lit(start), lambda w, x: F.least(F.lit(ceiling), F.greatest(F.lit(floor), w * F.exp(-F.lit(eta) * x))))


def expert_weights(facts: DataFrame, block: int = 4096) -> DataFrame:
    """(expert, weight) from (expert, ts, loss).

    A clamped step w -> clamp(w * f) maps to (scale, low, high) and such maps compose, so a history is folded in time blocks
    of at most about ``block`` rows, and the blocks' maps in order: no key's rows need to fit one task.
    """
    w = Window.partitionBy("expert", "day").orderBy("ts", "loss")
    cut = facts.withColumn("day", F.to_date("ts")).withColumn("part", F.floor((F.row_number().over(w) - 1) / block))
    step = F.struct(F.col("ts"), F.col("loss"))
    parts = cut.groupBy("expert", "day", "part").agg(F.array_sort(F.collect_list(step)).alias("xs"))
    identity = F.struct(F.lit(1.0).alias("f"), F.lit(0.5).alias("lo"), F.lit(2.0).alias("hi"))
    clamp = lambda x: F.least(F.lit(2.0), F.greatest(F.lit(0.5), x))

    def then(m: Column, f: Column, lo: Column, hi: Column) -> Column:
        # w -> min(hi', max(lo', w * f')) after w -> min(hi, max(lo, w * f))
        pick = lambda x: F.least(hi, F.greatest(lo, x * f))
        return F.struct((m.f * f).alias("f"), pick(m.lo).alias("lo"), pick(m.hi).alias("hi"))

    folded = parts.select("expert", "day", "part", F.aggregate("xs", identity, lambda m, x: then(m, F.exp(-0.25 * x.loss), F.lit(0.5), F.lit(2.0))).alias("m"))
    maps = folded.groupBy("expert").agg(F.array_sort(F.collect_list(F.struct("day", "part", "m"))).alias("ms"))
    return maps.select("expert", F.aggregate("ms", F.lit(1.0), lambda w, x: F.least(x.m.hi, F.greatest(x.m.lo, clamp(w) * x.m.f))).alias("weight"))


def delayed_recall(attempts: DataFrame) -> DataFrame:
    """One row (n, rate): success of attempts at least a day after the item's previous one. attempts: (item, at, result)."""
    before = F.lag("at").over(Window.partitionBy("item").orderBy("at"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    late = attempts.withColumn("before", before).filter(micros("at") - micros("before") >= 86_400_000_000)
    return late.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("result") == "success").cast("double")).alias("rate"))


def trace(provenance: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(ask_id, page, streams, outcome) from (ask_id, page, stream) and (ask_id, at, verdict)."""
    last = outcomes.groupBy("ask_id").agg(F.max_by("verdict", F.struct("at", "verdict")).alias("outcome"))
    return provenance.groupBy("ask_id", "page").agg(F.array_join(F.array_sort(F.collect_set("stream")), ",").alias("streams")).join(last, "ask_id", "left")


def rank_metrics(cases: DataFrame, k: int = 5) -> DataFrame:
    """(case_id, recall, mrr) from (case_id, expected array, got array): recall among the first k."""
    top = F.slice("got", 1, k)
    place = F.array_min(F.filter(F.transform("expected", lambda e: F.array_position(F.col("got"), e)), lambda p: p > 0))
    return cases.select("case_id", (F.size(F.array_intersect("expected", top)) / F.size("expected")).alias("recall"), F.coalesce(1 / place, F.lit(0.0)).alias("mrr"))


def nearest_rank(samples: Column, p: float) -> Column:
    """sorted[min(n - 1, int(p n))]."""
    n = F.size(samples)
    return F.element_at(F.array_sort(samples), F.least(n, F.floor(n * F.lit(p)).cast("int") + 1))


def percentiles(rows: DataFrame, key: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """(key, a column each): nearest ranks from counts by value, so no group's values are gathered."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(key).orderBy(value))
    x = counts.withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(Window.partitionBy(key)))
    at = lambda p: F.min(F.when(F.col("_upto") >= F.least(F.col("_n"), F.floor(F.col("_n") * F.lit(p)) + 1), F.col(value)))
    return x.groupBy(key).agg(*[at(p).alias(name) for name, p in wanted.items()])
