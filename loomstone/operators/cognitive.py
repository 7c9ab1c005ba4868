"""The practice domain: gates, priority, working sets, knapsack, interleaving, accessibility, review schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

# Ladder, exercises and the default policy.
LEVELS = ("none", "recognition", "recall", "explanation", "application", "transfer", "critique")
EXERCISE_LEVEL = {"recall": "recall", "explain": "explanation", "apply": "application", "compare": "application", "transfer": "transfer", "critique": "critique"}
EXERCISE_DIMENSION = {"recall": "conceptual", "explain": "conceptual", "apply": "practical", "compare": "critical", "critique": "critical", "transfer": "transfer"}
LEVEL_DEPTH = {"none": 0, "recognition": 1, "recall": 1, "explanation": 2, "application": 2, "transfer": 3, "critique": 3}
WEIGHTS = {"user_focus": 0.22, "goal_alignment": 0.18, "knowledge_gap": 0.22, "dependency_unlock": 0.12, "review_urgency": 0.12, "accessibility_heat": 0.04, "expected_information_gain": 0.06, "cost_penalty": 0.08}
BUDGETS = {"max_items": 7, "max_questions": 3, "max_cost_min": 90, "max_distance": 2}
GATES = {"allow_sensitive": False, "allow_stale": True, "allow_low_yield": True}
REVIEW = {"base_interval_days": 1.0, "growth": 2.2, "partial_growth": 1.2, "failure_interval_days": 1.0, "overconfident_interval_days": 0.5, "overconfidence_threshold": 0.7, "horizon_fraction": 3.0}


def _lookup(key: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def level_index(level: Column) -> Column:
    return _lookup(level, {name: i for i, name in enumerate(LEVELS)}, 0)


def gates(views: DataFrame, root: str, excluded: tuple[str, ...] = (), policy: dict = GATES, budgets: dict = BUDGETS) -> DataFrame:
    """Adds refused (names of the gates that refuse) and eligible."""
    named = [
        ("superseded", F.col("superseded")),
        ("invalid", F.col("invalid")),
        ("excluded", F.col("page").isin(*excluded) if excluded else F.lit(False)),
        ("privacy", F.col("sensitive") & F.lit(not policy["allow_sensitive"])),
        ("stale", F.col("stale") & F.lit(not policy["allow_stale"])),
        ("low_yield", F.col("low_yield") & F.lit(not policy["allow_low_yield"])),
        ("scope", (F.col("distance") > budgets["max_distance"]) & ~F.col("pinned") & (F.col("page") != root)),
    ]
    refused = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in named]))
    return views.withColumn("refused", refused).withColumn("eligible", F.size("refused") == 0)


def priority(views: DataFrame, root: str, goal_priority: int = 3, mean_depth: float = 1.0, weights: dict = WEIGHTS) -> DataFrame:
    """Adds cost_min and score: the weighted components less the weighted cost."""
    target = min(len(LEVELS) - 1, 1 + round(mean_depth * 1.6))
    own = F.col("pinned") | (F.col("page") == root)
    cost = scalars.reading_cost(F.col("words"))
    gap = F.greatest(F.lit(0.0), (target - level_index(F.col("level"))) / F.lit(float(target)))
    unlock = F.least(F.lit(1.0), F.col("degree") / 6.0)
    parts = {
        "user_focus": F.when(own, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - 0.3 * F.col("distance")) * (goal_priority / 5.0)),
        "goal_alignment": 1.0 / (1.0 + F.col("distance")),  # weighted below
        "knowledge_gap": gap,
        "dependency_unlock": unlock,
        "review_urgency": F.when(F.col("review_due"), 1.0).otherwise(0.0),
        "accessibility_heat": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("heat"))),
        "expected_information_gain": F.round(gap * unlock, 4),
    }
    # a share of a weight is one division: the product with a rounded reciprocal differs from it in the last bits, and by them in rank
    weighted = {k: F.lit(weights[k]) * v for k, v in parts.items()} | {"goal_alignment": F.lit(weights["goal_alignment"]) / (1.0 + F.col("distance"))}
    score = sum(weighted.values(), F.lit(0.0)) - F.lit(weights["cost_penalty"]) * F.least(F.lit(1.0), cost / 30.0)
    return views.withColumn("cost_min", cost).withColumn("score", F.greatest(F.lit(0.0), score))


def working_set(scored: DataFrame, root: str, budgets: dict = BUDGETS) -> DataFrame:
    """(page, kind) of what enters: questions by their own quota, items in order by count and cost; scores of items that agree to nine decimals are equal.

    Each turn takes the next item that fits, one row of a sorted top, so at most max_items small queries see all candidates.
    scored: (page, type, score, cost_min, pinned).
    """
    order = [F.desc("score"), "cost_min", "page"]
    questions = scored.filter("type = 'question'").orderBy(*order).limit(budgets["max_questions"]).select("page", F.lit("question").alias("kind"))
    rank = F.struct((-F.round("score", 9)).alias("s"), F.col("cost_min").alias("c"), F.col("page").alias("p"))
    left = scored.filter("type <> 'question'").select("page", F.col("cost_min").cast("double").alias("cost"), F.coalesce(F.col("pinned"), F.lit(False)).alias("pinned"), rank.alias("rank"))
    taken, spent, last = [], 0.0, None
    while len(taken) < budgets["max_items"]:
        fits = left.filter(F.col("pinned") | (F.col("page") == root) | (F.lit(spent) + F.col("cost") <= budgets["max_cost_min"]))
        if last is not None:
            fits = fits.filter(F.col("rank") > F.struct(F.lit(last.s).alias("s"), F.lit(last.c).alias("c"), F.lit(last.p).alias("p")))
        if not (got := fits.orderBy("rank").limit(1).collect()):
            break
        taken, spent, last = [*taken, (got[0].page, "item")], spent + got[0].cost, got[0]["rank"]
    return scored.sparkSession.createDataFrame(taken, "page string, kind string").unionByName(questions)


def fill_budget(items: DataFrame, minutes: float, max_cost: float | None = None, block: int = 4096) -> DataFrame:
    """(page, value, cost): greedy by value density, skipping what doesn't fit and going on. items: (page, value, cost).

    Items without cost always fit. The others are read in order, ``block`` at a time and only those that still fit, until none does;
    what is taken is bounded by the minutes.
    """
    if max_cost is not None:
        items = items.filter(F.col("cost") <= max_cost)
    items = items.select("page", F.col("value").cast("double").alias("value"), F.col("cost").cast("double").alias("cost"))
    rank = F.struct((-F.col("value") / F.greatest("cost", F.lit(0.1))).alias("d"), F.col("cost").alias("c"), F.col("page").alias("p"))
    ranked, left, last, taken = items.filter("cost > 0").withColumn("rank", rank), float(minutes), None, []
    while True:
        fits = ranked.filter(F.col("cost") <= left)
        if last is not None:
            fits = fits.filter(F.col("rank") > F.struct(F.lit(last.d).alias("d"), F.lit(last.c).alias("c"), F.lit(last.p).alias("p")))
        got = fits.orderBy("rank").limit(block).collect()
        for r in got:
            if r.cost <= left:
                left -= r.cost
                taken.append((r.page, r.value, r.cost))
        if len(got) < block:
            break
        last = got[-1]["rank"]
    return items.sparkSession.createDataFrame(taken, "page string, value double, cost double").unionByName(items.filter("cost <= 0"))


def interleave(items: DataFrame, bucket: Column, order: str) -> DataFrame:
    """Adds position: round robin over buckets in order of first appearance, stable within a bucket.

    A turn's items are ranked within the turn; the items of all turns before are counted from the buckets' sizes, so no
    window spans all items.
    """
    x = items.withColumn("bucket", bucket)
    x = x.withColumn("turn", F.row_number().over(Window.partitionBy("bucket").orderBy(order))).withColumn("first", F.min(order).over(Window.partitionBy("bucket")))
    turns = x.groupBy("turn").agg(F.count(F.lit(1)).alias("many")).withColumn("cell", F.floor(F.col("turn") / 65_536))
    cells = turns.groupBy("cell").agg(F.sum("many").alias("all"))  # a row for 65,536 turns
    cells = cells.select("cell", (F.sum("all").over(Window.orderBy("cell")) - F.col("all")).alias("base"))
    before = turns.join(cells, "cell").select("turn", (F.col("base") + F.sum("many").over(Window.partitionBy("cell").orderBy("turn")) - F.col("many")).alias("before"))
    ranked = x.withColumn("place", F.row_number().over(Window.partitionBy("turn").orderBy("first")))
    return ranked.join(before, "turn").withColumn("position", (F.col("before") + F.col("place")).cast("int")).drop("turn", "first", "bucket", "place", "before")


def accessibility(attempts: DataFrame) -> DataFrame:
    """(item, level, streak, attempts, last_result): the ladder only rises; a failure ends a streak, a partial result leaves it.

    attempts: (item, at, exercise, result). Aggregates only: the streak is the number of successes after the last failure.
    """
    reached = F.when(F.col("result") == "success", _lookup(F.col("exercise"), {e: LEVELS.index(v) for e, v in EXERCISE_LEVEL.items()}, 0)).otherwise(0)
    fell = attempts.groupBy("item").agg(F.max(F.when(F.col("result") == "failure", F.col("at"))).alias("fell"), F.max(reached).alias("rung"), F.count(F.lit(1)).alias("attempts"), F.max_by("result", "at").alias("last_result"))
    streak = attempts.join(fell.select("item", "fell"), "item").filter((F.col("result") == "success") & (F.col("fell").isNull() | (F.col("at") > F.col("fell")))).groupBy("item").agg(F.count(F.lit(1)).alias("streak"))
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("rung") + 1)
    return fell.join(streak, "item", "left").select("item", level.alias("level"), F.coalesce("streak", F.lit(0)).alias("streak"), "attempts", "last_result")


def next_interval(result: Column, confidence: Column, previous: Column, horizon_days: Column, p: dict = REVIEW) -> Column:
    """Days to the next review."""
    base = F.coalesce(F.nullif(previous, F.lit(0.0)), F.lit(p["base_interval_days"]))
    fail = F.when(confidence >= p["overconfidence_threshold"], p["overconfident_interval_days"]).otherwise(p["failure_interval_days"])
    days = F.when(result == "failure", fail).when(result == "partial", base * p["partial_growth"]).otherwise(base * p["growth"])
    return F.least(days, F.greatest(F.lit(p["base_interval_days"]), horizon_days / max(1.0, p["horizon_fraction"])))


def review_interval(attempts: Column, horizon_days: Column, p: dict = REVIEW) -> Column:
    """Fold of an item's ordered attempts array<struct<at, result, confidence>>, rounded to two decimals at each step."""
    return F.aggregate(attempts, F.lit(None).cast("double"), lambda prev, x: F.round(next_interval(x.result, x.confidence, prev, horizon_days, p), 2))


def depth_progress(successes: DataFrame, desired: dict[str, int]) -> DataFrame:
    """(dimension, desired, validated, progress); null where no exercise measures a dimension."""
    depth = _lookup(F.col("level"), LEVEL_DEPTH, 0)
    got = successes.groupBy(_lookup(F.col("exercise"), EXERCISE_DIMENSION, None).alias("dimension")).agg(F.max(depth).alias("best"))
    rows = [(d, n, d in EXERCISE_DIMENSION.values()) for d, n in desired.items() if n > 0]
    want = successes.sparkSession.createDataFrame(rows, "dimension string, desired int, measurable boolean")
    have = F.when(F.col("measurable"), F.coalesce("best", F.lit(0)))
    return want.join(got, "dimension", "left").select("dimension", "desired", have.alias("validated"), F.when(F.col("measurable"), F.round(F.least(F.lit(1.0), have / F.col("desired")), 2)).alias("progress"))


def support_level(streak: Column) -> Column:
    return F.when(streak <= 0, "worked_example").when(streak == 1, "hint").otherwise("none")


def current_state(declared: DataFrame, now: str, ttl_hours: int = 8) -> DataFrame:
    """One row (load, focus, energy): the last declaration within its lifetime, else neutral threes."""
    fresh = declared.filter((F.col("at") <= F.lit(now).cast("timestamp")) & (F.col("at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {ttl_hours} HOURS")))
    last = fresh.agg(F.max_by(F.struct("load", "focus", "energy"), F.struct("at", "id")).alias("x"))
    return last.select(*[F.coalesce(F.col(f"x.{c}"), F.lit(3)).alias(c) for c in ("load", "focus", "energy")])
