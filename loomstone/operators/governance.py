"""Write governance: gate rules, invariants, curation acts on versioned pages, regions inside bodies, freezing.

A rule is a filter that gives findings (severity, rule, page); an act is a plain transformation of a pages or versions table, so it can be
previewed before it is appended. Pages: page, type, body, privacy, generated_via, source_sha256, valid_at, invalid_at, superseded_by,
answered_by, stale_as_of, supersedes.
"""

from __future__ import annotations

import base64
import difflib
import re
import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text
from . import curation, graph

MACHINE = ("api:", "local:")
CITATION = "\\[(\\d{1,2})\\](?!\\()"


def _rule(severity: str, name: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(name).alias("rule"), "page")


def _numbers(body: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(CITATION), F.lit(1)), lambda x: x.cast("int")))


def _unknown_commits(shas: DataFrame, commits: DataFrame) -> DataFrame:
    """(page, sha) whose abbreviated sha begins no commit: they meet under their first seven digits."""
    seven = lambda c: F.lower(F.substring(c, 1, 7))
    known = shas.withColumn("k", seven(F.col("sha"))).join(commits.select(F.lower("sha").alias("whole"), seven(F.col("sha")).alias("k")), "k")
    return shas.join(known.filter(F.startswith("whole", F.lower("sha"))).select("page", "sha").distinct(), ["page", "sha"], "left_anti")


def gate_rules(batch: DataFrame, stored: DataFrame, known_types: list[str], required: DataFrame, commits: DataFrame, mode: str = "write", intent: str | None = None) -> DataFrame:
    """(severity, rule, page): what keeps a batch of pages from being written.

    batch: pages, with ``sensitive`` (a valid personal identifier was found) and ``fields`` (names of the front matter's filled keys);
    stored: pages that are there, with ``fields``; required: (type, fields); commits: (sha).
    """
    b, there = batch, stored.select("page").distinct()
    machine = reduce(Column.__or__, [F.coalesce(F.col("generated_via"), F.lit("")).startswith(m) for m in MACHINE])
    cited = F.regexp_extract("body", "(?ms)^#{1,2}\\s*Citations\\s*$(.*)", 1)
    listed = _numbers(cited)
    by_api = b.filter(F.col("generated_via").startswith("api:"))
    shas = b.select("page", F.explode(F.regexp_extract_all(F.concat_ws(" ", "body", "stale_as_of"), F.lit("(?i)(?:commit|stale_as_of|detected_at_commit)\\D{0,4}([0-9a-f]{7,40})"), F.lit(1))).alias("sha"))
    both = there.unionByName(b.select("page")).distinct()
    successors = b.select("page", F.explode(F.array("superseded_by", "answered_by")).alias("to")).filter("`to` IS NOT NULL")
    old = stored.select("page", F.col("body").alias("old_body"), F.col("fields").alias("old_fields"))
    again = b.join(old, "page")
    schema = lambda body: F.array_distinct(F.regexp_extract_all(text.section(body, "Schema"), F.lit("`([A-Za-z_][\\w.]*)`"), F.lit(1)))
    parts = [
        _rule("error", "policy.privacy_required", b.filter(F.col("privacy").isNull() | ~F.col("privacy").isin("local_only", "api_allowed"))),
        _rule("error", "policy.pii_requires_local", b.filter(F.col("sensitive") & (F.col("privacy") == "api_allowed"))),
        _rule("error", "policy.temporal_order", b.filter(F.col("invalid_at") <= F.col("valid_at"))),
        _rule("error", "policy.source_sha_required", b.filter(machine & (F.coalesce("source_sha256", F.lit("")) == ""))),
        _rule("error", "policy.citation_required", by_api.filter(F.size(listed) == 0)),
        _rule("error", "policy.citation_invalid", by_api.filter((F.size(listed) > 0) & (F.size(F.array_except(_numbers(F.col("body")), listed)) > 0))),
        _rule("error", "policy.dangling_successor", successors.join(both.withColumnRenamed("page", "to"), "to", "left_anti")),
        _rule("error", "policy.bad_commit_ref", _unknown_commits(shas, commits)),
        _rule("error", "policy.schema_shrink", again.filter((F.size(F.array_except(schema(F.col("old_body")), schema(F.col("body")))) > 0) & F.col("supersedes").isNull())),
        _rule("warn", "policy.metadata_shrink", again.filter(F.size(F.array_except("old_fields", F.array_union("fields", F.array(F.lit("timestamp"))))) > 0)),
        _rule("info", "policy.unknown_type", b.filter(~F.col("type").isin(*known_types))),
        _rule("error", "policy.schema_required_field", b.join(required.select("type", F.col("fields").alias("must")), "type").filter(F.size(F.array_except("must", "fields")) > 0)),
    ]
    if intent == "Creation":
        parts.append(_rule("error", "policy.path_collision", b.join(there, "page", "left_semi")))
    if mode == "release":
        found = b.select("page", F.explode(text.links(F.col("body"))).alias("l")).select("page", "l.target").filter(text.is_internal(F.col("target")))
        gone = found.withColumn("dst", text.resolve("target", "page")).join(there.withColumnRenamed("page", "dst"), "dst", "left_anti")
        parts.append(_rule("error", "policy.release_broken_link", gone))
    return reduce(DataFrame.unionByName, parts).distinct()


def finding_counts(findings: DataFrame) -> DataFrame:
    """(severity, n, rules): findings by severity and the set of rules they come from."""
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))


# ---- invariants


def index_orphans(indexed: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that the index knows and the bundle doesn't."""
    return indexed.select("page").distinct().join(pages.select("page"), "page", "left_anti")


def unmarked_superseded(pages: DataFrame, indexed: DataFrame) -> DataFrame:
    """Pages that are superseded in the bundle but not marked so in the index. indexed: (page, superseded boolean)."""
    return pages.filter("superseded_by IS NOT NULL").select("page").join(indexed.filter("NOT superseded"), "page", "left_semi")


def stale_index(pages: DataFrame, indexed: DataFrame) -> DataFrame:
    """Pages whose indexed digest is not that of the bundle. Both: (page, sha)."""
    return pages.join(indexed.select("page", F.col("sha").alias("was")), "page").filter("sha <> was").select("page")


def same_themes(themes: DataFrame, tau: float = 1 / 3) -> DataFrame:
    """(a, b, jaccard): pairs of live themes that overlap too much to be two. themes: (theme, page). Few pages meet as matrices, else
    only themes with a common page meet."""
    if dense := graph.dense_codes(themes.select(F.col("theme").alias("id"), F.col("page").alias("name"))):
        alike = graph.dense_overlaps(*dense, lambda s, na, nb: s / (na + nb - s) >= tau)
        return alike.select("a", "b", (F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))).alias("jaccard"))
    x = graph.match_themes(themes, themes.withColumnRenamed("theme", "community"), tau)
    return x.filter("theme < community").select(F.col("theme").alias("a"), F.col("community").alias("b"), "jaccard")


def contradictions(pages: DataFrame) -> DataFrame:
    """(identifier, page, blocks): strong ids held by live pages that no chain of succession joins; the page to look at is human first.

    pages: (page, ids, human, superseded_by, invalid_at). Pages of one id that succeed one another are one block.
    """
    each = pages.select("page", "human", "superseded_by", "invalid_at", F.explode(F.array_distinct("ids")).alias("identifier"))
    chains = each.alias("x").join(each.alias("y"), (F.col("x.identifier") == F.col("y.identifier")) & (F.col("x.superseded_by") == F.col("y.page")))
    pair = lambda side: F.concat_ws("\u0001", f"{side}.identifier", F.col(f"{side}.page").cast("string"))
    labels = graph.components(chains.select(pair("x").alias("a"), pair("y").alias("b")))
    mine = curation.alive(each).withColumn("node", F.concat_ws("\u0001", "identifier", F.col("page").cast("string"))).join(labels, "node", "left")
    by = mine.groupBy("identifier").agg(F.countDistinct(F.coalesce("label", "node")).alias("blocks"), F.min_by("page", F.struct(~F.col("human"), F.col("page"))).alias("page"))
    return by.filter("blocks >= 2").select("identifier", "page", "blocks")


def _tainted(sources: DataFrame, bad: DataFrame, nodes: int) -> tuple[DataFrame, DataFrame]:
    """(derivation) that some chain of sources leads from to a bad one; and (derivation) whose chains never end, being on or behind a cycle.

    Chains double: round k knows for each derivation what is 2^k steps up, and whether anything nearer is bad. So a chain of any depth takes as
    many rounds as its length has binary digits, and chains longer than there are nodes are cycles.
    """
    jump = graph.held(sources.select("derivation", "source").distinct(), "jump0")
    tainted, turn = graph.held(bad.select("derivation"), "tainted0"), 0
    while not jump.isEmpty() and 1 << turn <= 2 * nodes:
        turn += 1
        reached = jump.join(tainted.withColumnRenamed("derivation", "source"), "source", "left_semi").select("derivation")
        grown = graph.held(tainted.unionByName(reached).distinct(), f"tainted{turn}")
        upper = jump.select(F.col("derivation").alias("middle"), F.col("source").alias("top"))
        longer = graph.held(jump.join(upper, jump["source"] == upper["middle"]).select("derivation", F.col("top").alias("source")).distinct(), f"jump{turn}")
        graph.discard(jump, tainted)
        jump, tainted = longer, grown
    return tainted, jump.select("derivation").distinct()


def derivation_states(checkpoints: DataFrame, sources: DataFrame, current: DataFrame) -> DataFrame:
    """(derivation, state): absent without a checkpoint, stale if its input changed, stale_upstream if anything it is made from, however far up, is
    stale, else fresh. checkpoints: (derivation, input_state); sources: (derivation, source); current: (derivation, input_state).

    What was never made is no defect and taints nothing, but what is stale taints through it.
    """
    own = current.select("derivation", F.col("input_state").alias("now")).join(checkpoints, "derivation", "left")
    state = F.when(F.col("input_state").isNull(), "absent").when(F.col("input_state") != F.col("now"), "stale").otherwise("fresh")
    out = graph.held(own.select("derivation", state.alias("state")), "states")
    tainted, _ = _tainted(sources, out.filter("state = 'stale'"), sources.select(F.explode(F.array("derivation", "source"))).distinct().count())
    return out.join(tainted.withColumn("up", F.lit(True)), "derivation", "left").select("derivation", F.when((F.col("state") == "fresh") & F.col("up"), "stale_upstream").otherwise(F.col("state")).alias("state"))


def endless_derivations(sources: DataFrame) -> DataFrame:
    """(derivation) that are on a cycle of sources, or made from one that is."""
    nodes = sources.select(F.explode(F.array("derivation", "source"))).distinct().count()
    return _tainted(sources, sources.select("derivation").limit(0), nodes)[1]


# ---- acts


def mark_stale(pages: DataFrame, page: str, commit: str) -> DataFrame:
    return pages.withColumn("stale_as_of", F.when(F.col("page") == page, F.lit(commit)).otherwise(F.col("stale_as_of")))


def merge_pages(pages: DataFrame, page: str, into: str, when: str) -> DataFrame:
    """The winner takes the loser's body into a region, the loser is superseded; refuses a page into itself or one already superseded."""
    if page == into:
        raise ValueError("a page can't be merged into itself")
    loser = pages.filter(F.col("page") == page).select(F.col("body").alias("absorbed"), F.col("superseded_by").alias("gone")).limit(1)
    if (row := loser.collect()) and row[0].gone is not None:
        raise ValueError(f"{page} is already superseded")
    absorbed = row[0].absorbed if row else None
    body = F.when((F.col("page") == into) & F.lit(absorbed is not None), F.concat(F.coalesce("body", F.lit("")), F.lit(region(page, absorbed or "")))).otherwise(F.col("body"))
    return curation.supersede(pages.withColumn("body", body), page, into, when)


def third_pages(mentions: DataFrame, page, into) -> DataFrame:
    """(third, identifier): other pages that share a strong id with either side of a merge. mentions: (page, identifier)."""
    mine = mentions.filter(F.col("page").isin(page, into)).select("identifier").distinct()
    return mentions.join(mine, "identifier", "left_semi").filter(~F.col("page").isin(page, into)).select(F.col("page").alias("third"), "identifier").distinct()


def edit_page(pages: DataFrame, page: str, body: str | None = None, patch: dict[str, str] | None = None, guarded: tuple[str, ...] = ("page", "source_sha256", "generated_via")) -> DataFrame:
    """A human edit of a body or of metadata; guarded fields are refused."""
    if bad := sorted(set(patch or {}) & set(guarded)):
        raise ValueError(f"guarded fields: {bad}")
    changes = dict(patch or {}) | ({"body": body} if body is not None else {})
    return pages.select(*[F.when(F.col("page") == page, F.lit(changes[c])).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in pages.columns])


def close_question(pages: DataFrame, page: str, answered_by: str, when: str, evidence: DataFrame, force: bool = False) -> DataFrame:
    """Sets answered_by, if asking the question reaches the answer: evidence is what asking it gives, (page); itself doesn't count."""
    if not force and evidence.filter((F.col("page") == answered_by) & (F.col("page") != page)).isEmpty():
        raise ValueError(f"asking {page} doesn't reach {answered_by}")
    hit = F.col("page") == page
    return pages.withColumn("answered_by", F.when(hit, F.lit(answered_by)).otherwise(F.col("answered_by"))).withColumn("resolved_at", F.when(hit, F.lit(when)))


def promote(existing: DataFrame, drafts: DataFrame) -> DataFrame:
    """(page, action): what becomes of drafts (page, resolution): created, updated or given a new name if the page is there, else refused."""
    there = existing.select("page").distinct().withColumn("there", F.lit(True))
    action = F.when(F.col("there").isNull(), "create").when(F.col("resolution") == "update", "update").when(F.col("resolution") == "new_slug", "create").otherwise("collision")
    page = F.when(F.col("there") & (F.col("resolution") == "new_slug"), F.concat(F.regexp_replace("page", "\\.md$", ""), F.lit("-2.md"))).otherwise(F.col("page"))
    return drafts.join(there, "page", "left").select(page.alias("page"), action.alias("action"))


def compile_pending(raw: DataFrame, compiled: DataFrame) -> DataFrame:
    """Raw sources whose content has not been compiled: (source, sha) pairs that are not there."""
    return raw.join(compiled.select("source", "sha"), ["source", "sha"], "left_anti")


def adopt_legacy_policy(policy: dict) -> dict:
    """A policy's gates under their present names."""
    names = {"exclude_sensitive": ("allow_sensitive", True), "exclude_stale": ("allow_stale", True), "exclude_low_yield": ("allow_low_yield", True)}
    out = {}
    for k, v in policy.items():
        name, turned = names.get(k, (k, False))
        out[name] = not v if turned else v
    return out


def validate_policy(policy: dict, defaults: dict) -> dict:
    """defaults with a policy's values over them; unknown names, other types and negative numbers are refused."""
    out = {}
    for group, values in defaults.items():
        given = policy.get(group, {})
        if extra := sorted(set(given) - set(values)):
            raise ValueError(f"unknown in {group}: {extra}")
        for k, v in given.items():
            number = isinstance(values[k], (int, float)) and not isinstance(values[k], bool)
            if isinstance(v, bool) != isinstance(values[k], bool) or number and (not isinstance(v, (int, float)) or v < 0):
                raise ValueError(f"{group}.{k}: {v!r}")
        out[group] = values | given
    if extra := sorted(set(policy) - set(defaults)):
        raise ValueError(f"unknown groups: {extra}")
    return out


def validate_pipeline(name: str, stages: list[dict], known: set[str]) -> list[str]:
    """What is wrong with a pipeline's specification: 1 to 20 known stages, a slug as name, no stage that runs the pipeline itself."""
    wrong = [] if re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", name) else ["name"]
    wrong += [] if 1 <= len(stages) <= 20 else ["stages"]
    for i, s in enumerate(stages):
        wrong += [f"{i}: unknown {s.get('job')}"] if s.get("job") not in known else []
        wrong += [f"{i}: recursion"] if s.get("job") == "pipeline" and s.get("payload", {}).get("name") == name else []
        wrong += [f"{i}: on_error"] if s.get("on_error", "stop") not in ("stop", "continue") else []
    return wrong


def run_pipeline(stages: list[tuple[str, object, str]]) -> list[dict]:
    """Runs (name, function of the results so far, on_error) in order and logs each; a failed stage stops the rest unless it says continue."""
    log, results = [], {}
    for name, function, on_error in stages:
        try:
            results[name] = function(results)
            log.append({"stage": name, "ok": True, "error": None})
        except Exception as error:  # noqa: BLE001
            log.append({"stage": name, "ok": False, "error": str(error)})
            if on_error != "continue":
                break
    return log


# ---- regions inside bodies


def region(source: str, body: str) -> str:
    return f"\n<!-- absorbed:{source} -->\n{body}\n<!-- /absorbed:{source} -->\n"


def region_sources(body: Column) -> Column:
    """The pages whose text a body has absorbed, in order."""
    return F.regexp_extract_all(body, F.lit("<!-- absorbed:([^ ]+) -->"), F.lit(1))


RELATIONS = ("<!-- relations -->", "<!-- /relations -->")


def relation_block(body: Column) -> Column:
    """The text between a body's one pair of relation marks; null if there is none or more than one."""
    opened = F.size(F.regexp_extract_all(body, F.lit(RELATIONS[0]), F.lit(0)))
    return F.when(opened == 1, F.nullif(F.regexp_extract(body, f"(?s){RELATIONS[0]}\n(.*?){RELATIONS[1]}", 1), F.lit("")))


def with_relation(body: Column, title: Column, target: Column, rel: Column) -> Column:
    """A body with one more link in its relation block, which is made at the end if there is none; a link that is there stays single."""
    entry = F.concat(F.lit("* "), text.md_link(title, target, rel), F.lit("\n"))
    has = F.contains(body, F.lit(RELATIONS[1]))
    added = F.replace(body, F.lit(RELATIONS[1]), F.concat(entry, F.lit(RELATIONS[1])))
    return F.when(F.contains(body, entry), body).when(has, added).otherwise(F.concat(body, F.lit(f"\n{RELATIONS[0]}\n"), entry, F.lit(f"{RELATIONS[1]}\n")))


def without_relation(body: Column, target: Column) -> Column:
    """A body without the relation block's links to a target; links in prose stay."""
    quoted = F.concat(F.lit("(?m)^\\* \\[[^\\]]*\\]\\(/\\Q"), target, F.lit('\\E(?: "[^"]*")?\\)\\n'))
    block = F.coalesce(relation_block(body), F.lit(""))
    return F.when(block == "", body).otherwise(F.replace(body, block, F.regexp_replace(block, quoted, F.lit(""))))


def prose_links(body: Column) -> Column:
    """Targets of links outside the relation block."""
    outside = F.regexp_replace(body, f"(?s){RELATIONS[0]}.*?{RELATIONS[1]}", "")
    return F.transform(text.links(outside), lambda x: x["target"])


# ---- freezing


@F.pandas_udf(StringType())
def pack(whole: pd.Series) -> pd.Series:
    """zlib level 9 of a page, as base 64."""
    return whole.map(lambda s: None if s is None else base64.b64encode(zlib.compress(s.encode(), 9)).decode())


@F.pandas_udf(StringType())
def unpack(packed: pd.Series) -> pd.Series:
    return packed.map(lambda s: None if s is None else zlib.decompress(base64.b64decode(s)).decode())


def freeze(pages: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the pages that stay, the frozen ones as (page, digest, raw, packed)); pages with a veto stay. chosen: (page, veto)."""
    go = chosen.filter("veto IS NULL").select("page")
    cold = pages.join(go, "page", "left_semi").select("page", F.sha2(F.encode("body", "UTF-8"), 256).alias("digest"), F.octet_length("body").alias("raw"), pack("body").alias("packed"))
    return pages.join(go, "page", "left_anti"), cold


def recycle(cold: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, body, intact) of frozen pages that come back; those that live again already are left out."""
    back = cold.join(pages.select("page"), "page", "left_anti").withColumn("body", unpack("packed"))
    return back.select("page", "body", (F.sha2(F.encode("body", "UTF-8"), 256) == F.col("digest")).alias("intact"))


@F.pandas_udf(StringType())
def unified_diff(before: pd.Series, after: pd.Series, path: pd.Series) -> pd.Series:
    """The unified difference of two texts of a path."""

    def one(a, b, p) -> str:
        return "\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), f"a/{p}", f"b/{p}", lineterm=""))

    return pd.Series([one(a, b, p) for a, b, p in zip(before, after, path, strict=True)])


# ---- manifests


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha, bytes) of (path, content)."""
    return files.select("path", F.sha2(F.encode("content", "UTF-8"), 256).alias("sha"), F.octet_length("content").alias("bytes"))


def verify_manifest(stated: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem): files that are missing, changed or not stated."""
    now = manifest(files).select("path", F.col("sha").alias("now"))
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("sha").isNull(), "unexpected").when(F.col("sha") != F.col("now"), "changed")
    return stated.select("path", "sha").join(now, "path", "full").select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def log_positions(entries: DataFrame, at: str, tie: str) -> DataFrame:
    """Adds day and position: an episodic log by UTC day, the oldest entry of a day first."""
    w = Window.partitionBy("day").orderBy(at, tie)
    return entries.withColumn("day", F.to_date(at)).withColumn("position", F.row_number().over(w))
