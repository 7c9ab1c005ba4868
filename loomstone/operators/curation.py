"""Versioned pages: snapshot differences, upserts, invalidation, merging, tags, findings, vitality and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): added, changed or removed between two snapshots, by content digest."""
    side = lambda df, name: df.select(key, F.sha2(F.encode(F.coalesce(F.col(content), F.lit("")), "UTF-8"), 256).alias(name))
    both = side(old, "was").join(side(new, "now"), key, "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select(key, change.alias("change")).filter("change IS NOT NULL")


def apply_delta(index: DataFrame, fresh: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Index rows of changed and removed keys go, rows of changed and added ones come."""
    stay = index.join(changes.select(key), key, "left_anti")
    come = fresh.join(changes.filter("change <> 'removed'").select(key), key, "left_semi")
    return stay.unionByName(come)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], replace: bool) -> DataFrame:
    """Insert what is absent; with replace also update what is there."""
    if replace:
        return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti"))


def alive(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("superseded_by").isNull() & F.col("invalid_at").isNull())


def only_alive(items: DataFrame, pages: DataFrame, target: str) -> DataFrame:
    """Items whose target page lives; items without a target pass."""
    live = alive(pages).select(F.col("page").alias(target)).distinct()
    return items.filter(F.col(target).isNull()).unionByName(items.join(live, target, "left_semi").select(items.columns))


def suppressed(verdicts: DataFrame, now: Column) -> DataFrame:
    """Keys that a rejection or deferral still hides."""
    return verdicts.filter(F.col("status").isin("rejected", "deferred") & (F.col("until").isNull() | (now < F.col("until")))).select("key").distinct()


def supersede(pages: DataFrame, page: str, successor: str, when: str) -> DataFrame:
    if page == successor:
        raise ValueError("a page can't supersede itself")
    hit = F.col("page") == page
    return pages.withColumn("superseded_by", F.when(hit, F.lit(successor)).otherwise(F.col("superseded_by"))).withColumn("invalid_at", F.when(hit, F.lit(when)).otherwise(F.col("invalid_at")))


def invalidate(pages: DataFrame, page: str, when: str, reason: str | None = None) -> DataFrame:
    hit = F.col("page") == page
    out = pages.withColumn("invalid_at", F.when(hit, F.lit(when)).otherwise(F.col("invalid_at")))
    return out if reason is None else out.withColumn("description", F.when(hit, F.lit(reason)).otherwise(F.col("description")))


def current(versions: DataFrame, key: str = "page") -> DataFrame:
    """The last version of each page, removed ones left out."""
    w = Window.partitionBy(key).orderBy(F.desc("version"))
    return versions.withColumn("_r", F.row_number().over(w)).filter("_r = 1 AND op <> 'remove'").drop("_r")


def at_version(versions: DataFrame, version: int, key: str = "page") -> DataFrame:
    return current(versions.filter(F.col("version") <= version), key)


def undo(versions: DataFrame, page: str, as_version: int, key: str = "page") -> DataFrame:
    """Writes the version before the last forward as a new one; refuses to undo a creation (no earlier version: no row)."""
    mine = versions.filter(F.col(key) == page)
    w = Window.partitionBy(key).orderBy(F.desc("version"))
    before = mine.withColumn("_r", F.row_number().over(w)).filter("_r = 2").drop("_r").withColumn("version", F.lit(as_version)).select(versions.columns)
    return versions.unionByName(before)


def merge_meta(target: Column, source: Column) -> Column:
    """Union of two frontmatters (tags, entities, confidence, valid_at, description, title): the target wins, empty fields are filled,
    lists are joined in order, the weakest confidence and the earliest validity stay."""
    rank = lambda c: F.when(c == "ambiguous", 0).when(c == "inferred", 1).otherwise(2)
    filled = lambda f: F.coalesce(F.nullif(target[f], F.lit("")), source[f]).alias(f)
    lists = lambda f: F.array_union(F.coalesce(target[f], F.array().cast("array<string>")), F.coalesce(source[f], F.array().cast("array<string>"))).alias(f)
    weakest = F.when(rank(source["confidence"]) < rank(target["confidence"]), source["confidence"]).otherwise(target["confidence"])
    return F.struct(filled("title"), filled("description"), lists("tags"), lists("entities"), weakest.alias("confidence"), F.least(target["valid_at"], source["valid_at"]).alias("valid_at"))


def rename_tag(pages: DataFrame, old: str, new: str | None) -> DataFrame:
    kept = F.filter("tags", lambda t: t != old) if new is None else F.transform("tags", lambda t: F.when(t == old, F.lit(new)).otherwise(t))
    return pages.withColumn("tags", F.array_distinct(kept))


def shared_identifiers(pages: DataFrame) -> DataFrame:
    """(identifier, page, pages): strong ids on two live pages or more; the page to look at is human first, then by path.

    pages: (page, ids array, human boolean, superseded_by, invalid_at).
    """
    each = alive(pages).select("page", "human", F.explode(F.array_distinct("ids")).alias("identifier"))
    return each.groupBy("identifier").agg(F.countDistinct("page").alias("pages"), F.min_by("page", F.struct(~F.col("human"), F.col("page"))).alias("page")).filter("pages >= 2")


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Internal links (src, dst) to pages that are not there."""
    return links.join(pages.select(F.col("page").alias("dst")), "dst", "left_anti").select("src", "dst").distinct()


def orphans(pages: DataFrame, edges: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Pages without in-edges from another page, of any kind or of the given ones."""
    into = edges.filter("src <> dst")
    into = into if kinds is None else into.filter(F.col("kind").isin(*kinds))
    return pages.select("page").join(into.select(F.col("dst").alias("page")), "page", "left_anti")


def findings(rules: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(severity, rule, page) of all rules, each given as severity, name and a DataFrame with a page column."""
    out = None
    for severity, rule, df in rules:
        part = df.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), "page")
        out = part if out is None else out.unionByName(part)
    return out


def freeze_veto(pages: DataFrame, protected: tuple[str, ...], force: bool = False) -> DataFrame:
    """Adds veto: the first reason why a page can't be frozen, or null. pages: (type, dependents, status, recall, idle_days)."""
    v = F.when(F.col("type").isin(*protected), "protected_type").when(F.col("dependents") > 0, "dependents")
    if not force:
        v = v.when(F.col("status") == "preferred", "preferred").when(F.col("recall") > 0.05, "still_recalled").when(F.col("idle_days") < 90, "recent")
    return pages.withColumn("veto", v)


def directory_index(paths: DataFrame) -> DataFrame:
    """(dir, subdirectories, pages): sorted entries of every directory and its ancestors."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir"), F.element_at(parts, i + 1).alias("entry"), (i == F.size(parts) - 1).alias("leaf")))
    each = paths.select(F.explode(up).alias("x")).select("x.*")
    names = lambda leaf: F.array_join(F.array_sort(F.collect_set(F.when(F.col("leaf") == leaf, F.col("entry")))), ",")
    return each.groupBy("dir").agg(names(False).alias("subdirectories"), names(True).alias("pages"))
