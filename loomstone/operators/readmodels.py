"""Read models over usage, index and knowledge tables: relational views that a question, a dashboard or an attention list reads.

Each function takes the tables it reads and gives a DataFrame; lists that a person reads are cut by an ordered limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from .curation import alive, only_alive, suppressed


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ---- index


def entity_page_counts(entities: DataFrame, mentions: DataFrame, limit: int = 500) -> DataFrame:
    """(entity, pages): entities by the number of distinct pages that mention them, none included."""
    m = mentions.select("entity", "page")
    return entities.select("entity").join(m, "entity", "left").groupBy("entity").agg(F.countDistinct("page").alias("pages")).orderBy(F.desc("pages"), "entity").limit(limit)


def without(rows: DataFrame, known: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is not known."""
    keys = [on] if isinstance(on, str) else on
    return rows.join(known.select(*keys), keys, "left_anti")


def pending_embeddings(chunks: DataFrame, embeddings: DataFrame, limit: int = 256) -> DataFrame:
    """The next chunks that have no vector, in order of their ids."""
    return without(chunks, embeddings, "chunk_id").orderBy("chunk_id").limit(limit)


def purge_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges neither of whose ends is gone."""
    g = gone.select("page")
    return edges.join(g.withColumnRenamed("page", "src"), "src", "left_anti").join(g.withColumnRenamed("page", "dst"), "dst", "left_anti").select(edges.columns)


def purge_embeddings(embeddings: DataFrame, chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Vectors whose chunk doesn't belong to a page that is gone."""
    theirs = chunks.join(gone.select("page"), "page", "left_semi").select("chunk_id")
    return without(embeddings, theirs, "chunk_id")


def dependents(edges: DataFrame, page) -> DataFrame:
    """(src): pages that lead to a page, itself aside."""
    return edges.filter((F.col("dst") == F.lit(page)) & (F.col("src") != F.lit(page))).select("src").distinct()


def linked(edges: DataFrame, page) -> DataFrame:
    """(page): pages that a page leads to or is led to from, and itself."""
    p = F.lit(page)
    ends = edges.filter((F.col("src") == p) | (F.col("dst") == p)).select(F.explode(F.array("src", "dst")).alias("page"))
    return ends.unionByName(edges.sparkSession.range(1).select(p.alias("page"))).distinct()


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count(F.lit(1)).alias("cites"))


def first_chunks(chunks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(page, chunk_id, ord): the first chunk of each page, of all pages or of (page, place), whose order place keeps."""
    if pages is not None:
        chunks = chunks.join(pages.select("page").distinct(), "page", "left_semi")
    first = chunks.groupBy("page").agg(F.min_by("chunk_id", F.struct("ord", "chunk_id")).alias("chunk_id"), F.min("ord").alias("ord"))
    return first if pages is None else first.join(pages.groupBy("page").agg(F.min("place").alias("place")), "page")


def heaviest_pages(weights: DataFrame, limit: int = 20) -> DataFrame:
    return weights.orderBy(F.desc("weight"), "page").limit(limit)


def overview_stream(chunks: DataFrame, limit: int = 12, prefix: str = "communities/") -> DataFrame:
    """(chunk_id, rank): first chunks of overview pages, for a question about everything."""
    first = first_chunks(chunks.filter(F.col("page").startswith(prefix))).orderBy("page").limit(limit)
    return first.select("chunk_id", (F.row_number().over(Window.orderBy("page")) - 1).alias("rank"))


def graph_stream(rank: DataFrame, chunks: DataFrame, limit: int = 12) -> DataFrame:
    """(chunk_id, rank): the first chunks of the best pages of a ranked graph (node, score)."""
    best = rank.orderBy(F.desc("score"), "node").limit(limit).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "node")) - 1)
    return first_chunks(chunks, best.select(F.col("node").alias("page"), "place")).select("chunk_id", F.col("place").alias("rank"))


def cold_hits(hits: DataFrame, cold: DataFrame) -> DataFrame:
    """Hits of the search over cold digests, with the memory they stand for."""
    return hits.join(cold, "page")


def cold_by_strong_id(cold: DataFrame, identifiers: list[str]) -> DataFrame:
    """Cold memories that carry one of the identifiers. cold: (page, strong_ids separated by spaces)."""
    wanted = F.array(*[F.lit(i) for i in identifiers]) if identifiers else F.array().cast("array<string>")
    return cold.filter(F.arrays_overlap(F.split("strong_ids", " "), wanted))


def abstains(fused: DataFrame, least: float) -> DataFrame:
    """One row (abstain): whether the best fused score is under a bound, so that cold memories are to be searched."""
    return fused.agg((F.coalesce(F.max("score"), F.lit(0.0)) < least).alias("abstain"))


def gazetteer_fingerprint(aliases: DataFrame) -> DataFrame:
    """One row (fingerprint): a digest of the alias table whatever its order. aliases: (alias, canonical).

    Digests of the rows are summed, so no task holds the table.
    """
    row = F.conv(F.substring(F.sha2(F.concat_ws("\t", "alias", "canonical"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return aliases.distinct().agg(F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), F.coalesce(F.sum(row), F.lit(0)).cast("decimal(38,0)").cast("string")), 256).alias("fingerprint"))


# ---- counts


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    return _union([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


def health(tables: dict[str, DataFrame], jobs: DataFrame) -> DataFrame:
    """(name, n): rows of each table, jobs by state, and under ``oldest queued`` and ``last trace`` the two numbers that show delay."""
    states = jobs.groupBy("state").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("jobs "), F.col("state")).alias("name"), "n")
    oldest = jobs.filter("state = 'queued'").agg(F.min("id").alias("n")).select(F.lit("oldest queued").alias("name"), "n")
    last = jobs.agg(F.max("trace").alias("n")).select(F.lit("last trace").alias("name"), "n")
    return _union([row_counts(tables), states, oldest, last])


def dashboard(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, n): pages by type, stale ones, and orphans, which no wiki link from another page reaches."""
    types = pages.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("type "), "type").alias("name"), "n")
    stale = pages.agg(F.count_if(F.col("stale_as_of").isNotNull()).alias("n")).select(F.lit("stale").alias("name"), "n")
    reached = edges.filter((F.col("kind") == "wikilink") & (F.col("src") != F.col("dst"))).select(F.col("dst").alias("page"))
    orphans = pages.join(reached, "page", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphans").alias("name"), "n")
    return _union([types, stale, orphans])


def activity(rows: DataFrame, at: str, kind: str) -> DataFrame:
    return rows.groupBy(F.to_date(at).alias("day"), kind).agg(F.count(F.lit(1)).alias("n"))


def structure(nodes: DataFrame, pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (nodes, orphans, components, largest, evenness, kind): how a graph hangs together.

    evenness is the normalised entropy of the components' sizes. Fewer than 10 nodes are incipient; a largest component of under
    half the nodes is dispersed; a high evenness is diverse, a low one focused.
    """
    sizes = nodes.select("node").distinct().join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.count(F.lit(1)).alias("size"))
    by = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("many"))  # components of one size count alike: few rows
    total = by.agg(F.sum(F.col("size") * F.col("many")).alias("nodes"), F.sum("many").alias("components"), F.max("size").alias("largest"))
    share = F.col("size") / F.col("nodes")
    bits = by.crossJoin(F.broadcast(total)).agg(F.sum(-F.col("many") * share * F.log2(share)).alias("bits"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    alone = nodes.select("node").distinct().join(ends, "node", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    x = total.crossJoin(F.broadcast(bits)).crossJoin(F.broadcast(alone))
    x = x.withColumn("evenness", F.when(F.col("components") < 2, F.lit(0.0)).otherwise(F.col("bits") / F.log2("components")))
    kind = F.when(F.col("nodes") < 10, "incipient").when(F.col("largest") * 2 < F.col("nodes"), "dispersed").when(F.col("evenness") >= 0.5, "diverse").otherwise("focused")
    return x.select("nodes", "orphans", "components", "largest", scalars.r6(F.col("evenness")).alias("evenness"), kind.alias("kind"))


def dictionary(pages: DataFrame, recommended: list[str]) -> DataFrame:
    """(type, pages, recommended): the types in use beside the recommended ones."""
    seen = pages.groupBy("type").agg(F.count(F.lit(1)).alias("pages"))
    known = pages.sparkSession.createDataFrame([(t, True) for t in recommended], "type string, recommended boolean")
    return seen.join(known, "type", "full").select("type", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("recommended", F.lit(False)).alias("recommended"))


def tag_counts(pages: DataFrame, limit: int | None = None) -> DataFrame:
    got = pages.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return got if limit is None else got.orderBy(F.desc("n"), "tag").limit(limit)


def cold_stats(cold: DataFrame) -> DataFrame:
    """One row (n, raw, packed, saved, recycles): how much freezing saved, in per cent."""
    saved = F.when(F.col("raw") > 0, F.round(100 * (1 - F.col("packed") / F.col("raw")), 1)).otherwise(F.lit(0.0))
    return cold.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("packed"), F.lit(0)).alias("packed"), F.coalesce(F.sum("recycles"), F.lit(0)).alias("recycles")).select("n", "raw", "packed", saved.alias("saved"), "recycles")


def newest(rows: DataFrame, by: str, keep: int, tie: str | None = None) -> DataFrame:
    """The newest rows, the newest first."""
    return rows.orderBy(F.desc(by), *([F.desc(tie)] if tie else [])).limit(keep)


def inbox_status(raw: DataFrame, compiled: DataFrame) -> DataFrame:
    """(name, status): raw sources that are new, compiled, or stale because their digest has changed. raw, compiled: (name, sha)."""
    status = F.when(F.col("was").isNull(), "new").when(F.col("was") == F.col("sha"), "compiled").otherwise("stale")
    return raw.join(compiled.select("name", F.col("sha").alias("was")), "name", "left").select("name", status.alias("status"))


def weekly_review(pages: DataFrame, edges: DataFrame, now: Column, days: int = 7, tags: int = 12) -> DataFrame:
    """(section, item, n): pages that are new in the last days, orphans, stale pages, decisions, open questions, and the commonest tags."""
    one = lambda name, df: df.select(F.lit(name).alias("section"), F.col("page").cast("string").alias("item"), F.lit(1).cast("long").alias("n"))
    reached = edges.filter("src <> dst").select(F.col("dst").alias("page"))
    recent = pages.filter((F.col("created") > now - F.make_dt_interval(F.lit(days))) & (F.col("created") <= now))
    top = tag_counts(pages, tags).select(F.lit("tags").alias("section"), F.col("tag").alias("item"), "n")
    return _union([one("new", recent), one("orphans", pages.join(reached, "page", "left_anti")), one("stale", pages.filter("stale_as_of IS NOT NULL")), one("decisions", recent.filter("type = 'decision'")), one("questions", pages.filter("type = 'question' AND answered_by IS NULL")), top])


# ---- usage


def outcomes_in_context(context: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every outcome with the context its question was asked in."""
    return context.join(outcomes, "ask_id")


def schedules_with_access(schedules: DataFrame, access: DataFrame) -> DataFrame:
    """Review schedules beside the accessibility of their item, if it has any."""
    return schedules.join(access, "item", "left")


def record_usage(usage: DataFrame, fused: DataFrame) -> DataFrame:
    """(page, reads): counts after one more question whose evidence came from the fused pages."""
    return usage.select("page", "reads").unionByName(fused.select("page").distinct().withColumn("reads", F.lit(1).cast("long"))).groupBy("page").agg(F.sum("reads").alias("reads"))


def outcome_losses(outcomes: DataFrame, provenance: DataFrame, cited: DataFrame) -> DataFrame:
    """(expert, ts, loss): what each outcome teaches the streams that brought a cited page: -1 if it was useful, else 1.

    outcomes: (ask_id, ts, verdict); provenance: (ask_id, page, stream); cited: (ask_id, page).
    """
    streams = provenance.join(cited, ["ask_id", "page"], "left_semi").select("ask_id", "stream").distinct()
    loss = F.when(F.col("verdict") == "useful", F.lit(-1.0)).otherwise(F.lit(1.0))
    return outcomes.join(streams, "ask_id").select(F.col("stream").alias("expert"), "ts", loss.alias("loss"))


def choose_strategy(weights: DataFrame, declared: str | None = None) -> DataFrame:
    """One row (strategy): the declared one, else that of the greatest weight, ties by name. A draw by weight is left to the caller."""
    if declared is not None:
        return weights.sparkSession.range(1).select(F.lit(declared).alias("strategy"))
    return weights.orderBy(F.desc("weight"), "strategy").limit(1).select("strategy")


def recent_traces(provenance: DataFrame, limit: int = 50) -> DataFrame:
    """(ask_id, pages, last): the newest questions by the last sequence number of their provenance."""
    by = provenance.groupBy("ask_id").agg(F.countDistinct("page").alias("pages"), F.max("seq").alias("last"))
    return by.orderBy(F.desc("last"), "ask_id").limit(limit)


def category_rates(cases: DataFrame) -> DataFrame:
    """(category, total, passed): golden cases by category. cases: (category, passed boolean)."""
    return cases.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"))


def envelope(cases: DataFrame, expected: list[str], least: int = 20) -> DataFrame:
    """One row (samples, rate, status): how far an evaluation carries; partially below ``least`` samples or without some category."""
    want = F.array(*[F.lit(c) for c in expected]) if expected else F.array().cast("array<string>")
    a = cases.agg(F.count(F.lit(1)).alias("samples"), F.avg(F.col("passed").cast("double")).alias("rate"), F.collect_set(F.when(F.col("category").isin(*expected), F.col("category"))).alias("seen"))
    full = (F.col("samples") >= least) & (F.size(F.array_except(want, "seen")) == 0)
    status = F.when(F.col("samples") == 0, "unevaluated").when(full, "evaluated").otherwise("partially_evaluated")
    return a.select("samples", F.round("rate", 4).alias("rate"), status.alias("status"))


def answer_grades(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """(case_id, category, passed): a case passes if the answer cites an expected page, or abstains where it should.

    cases: (case_id, category, expected array, abstain); answers: (case_id, cited array, abstained).
    """
    passed = F.when(F.col("abstain"), F.coalesce("abstained", F.lit(True))).otherwise(~F.coalesce("abstained", F.lit(True)) & F.coalesce(F.arrays_overlap("expected", "cited"), F.lit(False)))
    return cases.join(answers, "case_id", "left").select("case_id", "category", passed.alias("passed"))


# ---- attention


def bridge_items(bridges: DataFrame, pages: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """(key, page, value, cost, origin): fragile bridges worth a second link, of live pages, unless a verdict hides them."""
    live = only_alive(bridges, pages, "src").join(alive(pages).select(F.col("page").alias("dst")), "dst", "left_semi")
    keyed = live.withColumn("key", F.concat_ws("|", F.lit("bridge"), "src", "dst"))
    value = F.least(F.lit(0.85), 0.7 + 0.03 * (F.col("small_side") - 2))
    return keyed.join(suppressed(verdicts, now), "key", "left_anti").select("key", F.col("src").alias("page"), value.alias("value"), F.lit(5.0).alias("cost"), F.lit("bridge").alias("origin"))


def contradiction_items(shared: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """Items for identifiers on several live pages. shared: (identifier, page)."""
    keyed = shared.withColumn("key", F.concat_ws("|", F.lit("contradiction"), "identifier"))
    return keyed.join(suppressed(verdicts, now), "key", "left_anti").select("key", "page", F.lit(0.9).alias("value"), F.lit(8.0).alias("cost"), F.lit("contradiction").alias("origin"))


def review_items(access: DataFrame) -> DataFrame:
    """Items that a review would gain most on. access: (page, recall, words); a gain of at least .3 counts."""
    gain = scalars.review_gain(F.col("recall"))
    return access.withColumn("gain", gain).filter("gain >= 0.3").select(F.concat_ws("|", F.lit("review"), "page").alias("key"), "page", F.col("gain").alias("value"), scalars.reading_cost(F.col("words")).alias("cost"), F.lit("review").alias("origin"))


def gap_items(pages: DataFrame) -> DataFrame:
    """Open questions (.9), pages of low yield (.8) and stale ones (.6). pages: (page, type, status, stale_as_of)."""
    value = F.when(F.col("type") == "question", 0.9).when(F.col("status") == "low_yield", 0.8).when(F.col("stale_as_of").isNotNull(), 0.6)
    return pages.withColumn("value", value).filter("value IS NOT NULL").select(F.concat_ws("|", F.lit("gap"), "page").alias("key"), "page", "value", F.lit(10.0).alias("cost"), F.lit("gap").alias("origin"))


def inbox_items(raw: DataFrame, compiled: DataFrame) -> DataFrame:
    """Raw sources that are not compiled yet."""
    return inbox_status(raw, compiled).filter("status <> 'compiled'").select(F.concat_ws("|", F.lit("inbox"), "name").alias("key"), F.col("name").alias("page"), F.lit(0.5).alias("value"), F.lit(6.0).alias("cost"), F.lit("inbox").alias("origin"))


def next_actions(sources: list[DataFrame], limit: int = 40) -> DataFrame:
    """(position, key, page, value, cost, origin): all items by value density, the best first."""
    density = F.col("value") / F.greatest("cost", F.lit(0.1))
    top = _union(sources).withColumn("density", density).orderBy(F.desc("density"), "key").limit(limit)
    return top.select(F.row_number().over(Window.orderBy(F.desc("density"), "key")).alias("position"), "key", "page", "value", "cost", "origin")


def action_counts(sources: list[DataFrame], limit: int = 40) -> DataFrame:
    """(origin, n, truncated): items by origin, and whether there are more than are shown."""
    every = _union(sources)
    n = every.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return every.groupBy("origin").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n))


def plan_sources(sources: list[DataFrame], load: int) -> DataFrame:
    """Items that a person under this cognitive load can take on: above 3 only reviews and cheap ones, of at most 15 minutes."""
    every = _union(sources)
    return every.filter("(origin = 'review' OR cost <= 10) AND cost <= 15") if load >= 4 else every


def curation_projection(signals: DataFrame, aligned: DataFrame, limit: int = 20) -> DataFrame:
    """(page, score, signals): pages by their strongest signal, .3 more if they belong to a goal. signals: (page, signal, weight)."""
    by = signals.groupBy("page").agg(F.max("weight").alias("top"), F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"))
    goal = aligned.select("page").distinct().withColumn("own", F.lit(0.3))
    score = F.col("top") + F.coalesce("own", F.lit(0.0))
    return by.join(goal, "page", "left").select("page", score.alias("score"), "signals").orderBy(F.desc("score"), "page").limit(limit)


def due_reviews(schedules: DataFrame, now: Column, limit: int = 30) -> DataFrame:
    """(item, due_at, support): reviews that are due, the longest due first, with the support their streak asks for."""
    support = F.when(F.col("streak") <= 0, "worked_example").when(F.col("streak") == 1, "hint").otherwise("none")
    return schedules.filter((F.col("due_at") <= now) & (F.col("status") == "scheduled")).orderBy("due_at", "item").limit(limit).select("item", "due_at", support.alias("support"))


def goal_progress(attempts: DataFrame, projection: DataFrame) -> DataFrame:
    """(successes, pages): exercises that succeeded on the pages of a goal's projections."""
    mine = attempts.join(projection.select(F.col("page").alias("item")).distinct(), "item", "left_semi").filter("result = 'success'")
    return mine.agg(F.count(F.lit(1)).alias("successes"), F.countDistinct("item").alias("pages"))


def candidate_views(pages: DataFrame, distances: DataFrame, overlay: DataFrame, heat: DataFrame, access: DataFrame, degrees: DataFrame, due: DataFrame) -> DataFrame:
    """The views that gates and priorities read: pages within reach of a goal with what all tables know of them.

    pages: (page, superseded, invalid, sensitive, stale, words); distances: (page, distance).
    """
    x = pages.join(distances, "page").join(overlay.select("page", "status"), "page", "left").join(heat.select("page", F.col("score").alias("heat")), "page", "left")
    x = x.join(access.select(F.col("item").alias("page"), "level"), "page", "left").join(degrees.select("page", "degree"), "page", "left").join(due.select(F.col("item").alias("page")).distinct().withColumn("due", F.lit(True)), "page", "left")
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return x.select("page", "superseded", "invalid", "sensitive", "stale", "words", "distance", (F.coalesce("status", F.lit("")) == "low_yield").alias("low_yield"), zero("heat", 0.0), zero("level", "none"), zero("degree", 0), F.coalesce("due", F.lit(False)).alias("review_due"))


def episodes(steps: DataFrame, sessions: int = 12, limit: int = 40) -> DataFrame:
    """(session_id, at, kind): the last steps of the newest sessions, the newest first. steps: (session_id, started, at, kind)."""
    newest_ones = steps.groupBy("session_id").agg(F.max("started").alias("s")).orderBy(F.desc("s"), F.desc("session_id")).limit(sessions).select("session_id")
    return steps.join(F.broadcast(newest_ones), "session_id", "left_semi").orderBy(F.desc("at"), F.desc("session_id")).limit(limit).select("session_id", "at", "kind")


def community_summaries(pairs: DataFrame, community: DataFrame, members: int = 8) -> DataFrame:
    """(community, rank, node, strength): the members of greatest weighted degree of each community of two or more."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("strength"))
    who = community.join(ends, "node", "left").withColumn("strength", F.coalesce("strength", F.lit(0.0)))
    big = who.groupBy("community").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2 AND community >= 0").select("community")
    ranked = who.join(big, "community").withColumn("rank", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("strength"), "node")))
    return ranked.filter(F.col("rank") <= members).select("community", "rank", "node", "strength")


def hottest_subgraph(nodes: DataFrame, pairs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The hottest nodes by (heat, degree), and the pairs among them. nodes: (node, heat, degree)."""
    top = nodes.orderBy(F.desc("heat"), F.desc("degree"), "node").limit(limit)
    ids = F.broadcast(top.select("node"))
    inside = pairs.join(ids.withColumnRenamed("node", "a"), "a", "left_semi").join(ids.withColumnRenamed("node", "b"), "b", "left_semi")
    return top, inside


def articulators(betweenness: DataFrame, limit: int = 10) -> DataFrame:
    return betweenness.filter("betweenness > 0").orderBy(F.desc("betweenness"), "node").limit(limit)


def last_runs(runs: DataFrame) -> DataFrame:
    """The last run of each pipeline, whole. runs: (name, started_at, status, ...)."""
    rest = [c for c in runs.columns if c != "name"]
    return runs.groupBy("name").agg(F.max_by(F.struct(*rest), F.struct("started_at", *[c for c in rest if c != "started_at"])).alias("x")).select("name", "x.*")


def new_observations(mined: DataFrame, known: DataFrame) -> DataFrame:
    """Mined observations that no open one states already: (kind, statement)."""
    return without(mined, known.filter("status = 'open'"), ["kind", "statement"])


def page_meta(pages: DataFrame) -> DataFrame:
    """Metadata with what is missing filled in."""
    fill = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return pages.select("page", fill("type", "note"), F.coalesce("title", scalars.titleize(F.col("page"))).alias("title"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), fill("privacy", "standard"), fill("confidence", "extracted"), F.col("stale_as_of").isNotNull().alias("stale"))


ACTS = {"contradiction": ("merge", "supersede", "invalidate"), "bridge": ("link", "reject"), "gap": ("edit", "close", "reject"), "inbox": ("compile", "discard"), "review": ("practise",)}


def acts_for(items: DataFrame) -> DataFrame:
    """(key, act, ord): the acts that each item offers, by its origin."""
    offers = F.create_map(*[x for origin, acts in ACTS.items() for x in (F.lit(origin), F.array(*[F.lit(a) for a in acts]))])
    return items.select("key", F.posexplode(offers[F.col("origin")]).alias("ord", "act"))
