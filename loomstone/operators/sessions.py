"""Practice sessions as events: states, steps, capsules to resume from; goals, prompts and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import cognitive

# Which command leads from which state to which.
MOVES = {("start", "none"): "active", ("suspend", "active"): "suspended", ("resume", "suspended"): "active", ("complete", "active"): "completed", ("complete", "suspended"): "completed"}
INTENTS = ("learn", "review", "decide", "create", "explore")


def session_states(events: DataFrame) -> DataFrame:
    """(session_id, state, steps, current_item, refused): each session after its events, in order of (at, seq).

    A command that its state doesn't allow is refused and counted, a step outside an active session too. A session's events are folded
    in one row; a session is one person's sitting. events: (session_id, at, seq, command, item).
    """
    ordered = events.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "command", "item"))).alias("xs"))
    kind = "struct<state:string,steps:bigint,item:string,refused:bigint>"
    start = F.struct(F.lit("none").alias("state"), F.lit(0).cast("long").alias("steps"), F.lit(None).cast("string").alias("item"), F.lit(0).cast("long").alias("refused")).cast(kind)

    def to(s: Column, x: Column) -> Column:
        new = F.lit(None).cast("string")
        for (command, state), after in MOVES.items():
            new = F.when((x["command"] == command) & (s["state"] == state), F.lit(after)).otherwise(new)
        step = (x["command"] == "step") & (s["state"] == "active")
        moved = F.struct(F.coalesce(new, s["state"]).alias("state"), (s["steps"] + step.cast("long")).alias("steps"), F.when(step, F.coalesce(x["item"], s["item"])).otherwise(s["item"]).alias("item"), (s["refused"] + (new.isNull() & ~step).cast("long")).alias("refused"))
        return moved.cast(kind)

    return ordered.select("session_id", F.aggregate("xs", start, to).alias("s")).select("session_id", "s.state", "s.steps", F.col("s.item").alias("current_item"), "s.refused")


def capsules(events: DataFrame, states: DataFrame) -> DataFrame:
    """(session_id, current_item, steps, reason, suspended_at) of suspended sessions: what it takes to resume. events have a note."""
    last = events.filter("command = 'suspend'").groupBy("session_id").agg(F.max_by(F.struct("at", "note"), F.struct("at", "seq")).alias("x"))
    return states.filter("state = 'suspended'").join(last, "session_id").select("session_id", "current_item", "steps", F.col("x.note").alias("reason"), F.col("x.at").alias("suspended_at"))


def valid_goals(goals: DataFrame, intents: tuple[str, ...] = INTENTS) -> DataFrame:
    """Adds wrong: names of the fields that keep a goal (intent, priority, horizon_days, depth array<int>) from being set."""
    tests = [("intent", ~F.col("intent").isin(*intents)), ("priority", ~F.col("priority").between(1, 5)), ("horizon", F.col("horizon_days") <= 0), ("depth", F.exists("depth", lambda d: (d < 0) | (d > 3)))]
    return goals.withColumn("wrong", F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(n)) for n, t in tests])))


#: What an exercise asks, with the page's title.
PROMPTS = {
    "recall": "Without looking, what do you remember of '%s'?",
    "explain": "Explain '%s' in your own words.",
    "apply": "Use '%s' on a case of your own.",
    "compare": "Compare '%s' with something close to it.",
    "transfer": "Where else would '%s' hold?",
    "critique": "What speaks against '%s'?",
}


def exercise_prompt(exercise: Column, title: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, prompt in PROMPTS.items():
        out = F.when(exercise == name, F.format_string(prompt, title)).otherwise(out)
    return out


def submit_attempts(schedules: DataFrame, attempts: DataFrame, horizon_days: float = 90.0) -> DataFrame:
    """(item, at, days, gap, cancelled): the review that each item's last attempt sets, the calibration gap of that attempt, and whether it
    replaces a scheduled one. attempts: (item, at, result, confidence); schedules: (item, days, status)."""
    last = attempts.groupBy("item").agg(F.max_by(F.struct("at", "result", "confidence"), "at").alias("x")).select("item", "x.*")
    open_ = schedules.filter("status = 'scheduled'").groupBy("item").agg(F.max("days").alias("previous"))
    days = cognitive.next_interval(F.col("result"), F.col("confidence"), F.col("previous"), F.lit(horizon_days))
    gap = F.col("confidence") - (F.col("result") == "success").cast("double")
    return last.join(open_, "item", "left").select("item", "at", F.round(days, 2).alias("days"), F.round(gap, 4).alias("gap"), F.col("previous").isNotNull().alias("cancelled"))


def projection(views: DataFrame, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(page, score, cost_min, refused, kind): a goal's candidates with their gates, priorities, and place in the working set."""
    scored = cognitive.priority(cognitive.gates(views, root, excluded), root)
    chosen = cognitive.working_set(scored.filter("eligible"), root)
    return scored.join(chosen, "page", "left").select("page", "score", "cost_min", F.array_join("refused", ",").alias("refused"), "kind")


def accepted(rows: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Feedback or experience whose value is in the closed vocabulary."""
    return rows.filter(F.col(column).isin(*allowed))


def complete_reviews(schedules: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Schedules after some reviews were done: only a due one can be. done: (review_id)."""
    hit = done.select("review_id").distinct().withColumn("done", F.lit(True))
    status = F.when(F.col("done") & (F.col("due_at") <= now) & (F.col("status") == "scheduled"), "done").otherwise(F.col("status"))
    return schedules.join(hit, "review_id", "left").withColumn("status", status).drop("done")


def config_history(changes: DataFrame, keep: int = 30) -> DataFrame:
    """The newest changes of the configuration, the newest first."""
    return changes.orderBy(F.desc("version")).limit(keep)


def config_at(changes: DataFrame, version: int) -> DataFrame:
    """(key, value) as it stood at a version. changes: (version, key, value)."""
    return changes.filter(F.col("version") <= version).groupBy("key").agg(F.max_by("value", "version").alias("value"))


def leased_jobs(jobs: DataFrame, now: Column, attempts: int = 3, lease_s: int = 600) -> DataFrame:
    """(id, state): the queue after a look at its leases: an expired lease is queued again, or dead after the last attempt."""
    expired = (F.col("state") == "running") & (F.col("leased_at") + F.make_dt_interval(secs=F.lit(lease_s)) < now)
    return jobs.select("id", F.when(expired & (F.col("tries") >= attempts), "dead").when(expired, "queued").otherwise(F.col("state")).alias("state"))


def retry_delay(tries: Column, job_id: Column, jitter: float = 1.0) -> Column:
    """Seconds before try number ``tries``: 5 doubled each time, and a jitter that the job's id settles."""
    share = F.pmod(F.xxhash64(job_id), F.lit(1000)) / F.lit(1000.0)
    return 5.0 * F.pow(F.lit(2.0), tries - 1) + F.lit(jitter) * share


def next_jobs(jobs: DataFrame, slots: int) -> DataFrame:
    """The jobs to start: queued ones by priority and age, one for each dedupe key."""
    w = Window.partitionBy(F.coalesce("dedupe", F.col("id").cast("string"))).orderBy(F.desc("priority"), "id")
    once = jobs.filter("state = 'queued'").withColumn("turn", F.row_number().over(w)).filter("turn = 1").drop("turn")
    return once.orderBy(F.desc("priority"), "id").limit(slots)


def golden_seed(spark: SparkSession, file: str, existing: DataFrame) -> DataFrame:
    """Golden cases of a JSON file that are not there yet."""
    return spark.read.option("multiLine", True).json(file).join(existing.select("case_id"), "case_id", "left_anti")
