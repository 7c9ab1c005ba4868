"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Sources in code-point order, null last, get the weights in turn and share ``total`` times all words. A target
stops at ``cap`` times its source's words and the excess is reshared by weight: the targets are
min(cap * size, level * weight) with the one level that makes them add up. A document of a source is copied
target / size times on average: the whole part always, the fraction by rounding.

Rounding works on words. Two fractions meet; mass moves from one to the other, at random in the direction that
keeps both expectations, until one is 0 or 1, so their sum of words doesn't change. Longer documents go first, so that
what is left undecided is short. A block of documents folds this way
into decided copies and one document with a fraction left; these residuals are the leaves of the next level
of a reduction tree, ``fan`` to a block, until one for each source remains, which is rounded to the nearer whole number. A source's
words therefore differ from its target by half a document at most.

Random numbers are hashes of doc_id, words, level and the number of a row among those alike in source, doc_id and words, so reruns agree.
Edge cases: null text has no words; a document without words takes none; a very long text counts whole; null is a source of its own;
repeated rows, and rows that share a null doc_id, are numbered, dealt to blocks and rounded one by one; a source without
words has target 0; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

ITEM = "struct<neg:bigint,doc_id:bigint,size:bigint,turn:bigint,base:bigint,p:double>"
DONE = "struct<doc_id:bigint,size:bigint,copies:bigint>"


def source_targets(sized: DataFrame, weights: tuple[int, ...], total: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, size, many: rows of that size). The windows are over a row a source."""
    sums = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights)).cast("int") + 1)
    by = sums.withColumn("weight", weight)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("need", F.lit(total) * F.sum("source_size").over(every.orderBy("source")))
    # sources that stop first come first; the level if exactly those before this one have stopped
    up = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    by = by.withColumn("level", (F.col("need") - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest))
    by = by.withColumn("stops", F.col("level") * F.col("weight") > F.lit(cap) * F.col("source_size"))
    by = by.withColumn("rank", F.row_number().over(up))
    # beyond the first source that doesn't stop, the levels are of no use
    level = F.min_by(F.col("level"), F.when(~F.col("stops"), F.col("rank"))).over(every.orderBy("source"))
    target = F.when(F.col("stops") | level.isNull(), F.lit(cap) * F.col("source_size")).otherwise(level * F.col("weight"))
    return by.withColumn("target", F.least(target, F.lit(cap) * F.col("source_size"))).select("source", "source_size", "target")


def _uniform(*on: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*on), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def _fold(items: Column, seed: Column) -> Column:
    """struct<cur: ITEM or null, out: array<DONE>>: folds items into decided copies and one residual at most."""

    def decided(item: Column, up: Column) -> Column:
        return F.array(F.struct(item.doc_id.alias("doc_id"), item.size.alias("size"), (item.base + up).alias("copies")))

    def with_p(item: Column, p: Column) -> Column:
        return F.struct(item.neg.alias("neg"), item.doc_id.alias("doc_id"), item.size.alias("size"), item.turn.alias("turn"), item.base.alias("base"), p.cast("double").alias("p"))

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    nobody = F.lit(None).cast(ITEM)

    def state(cur: Column, out: Column) -> Column:
        return F.struct(cur.cast(ITEM).alias("cur"), out.cast(f"array<{DONE}>").alias("out"))

    def meet(s: Column, x: Column) -> Column:
        c = s.cur
        to_c = F.least(c.size * (1 - c.p), x.size * x.p)  # words that can move from x to c
        to_x = F.least(c.size * c.p, x.size * (1 - x.p))
        up = _uniform(seed, c.doc_id, x.doc_id, c.size, x.size, c.turn, x.turn) * (to_c + to_x) < to_x
        c_fills, x_empties = c.size * (1 - c.p) <= x.size * x.p, c.size * (1 - c.p) >= x.size * x.p
        x_fills, c_empties = x.size * (1 - x.p) <= c.size * c.p, x.size * (1 - x.p) >= c.size * c.p
        return (
            F.when(c.isNull(), state(x, s.out))
            .when(up & c_fills & x_empties, state(nobody, F.concat(s.out, decided(c, one), decided(x, zero))))
            .when(up & c_fills, state(with_p(x, x.p - to_c / x.size), F.concat(s.out, decided(c, one))))
            .when(up, state(with_p(c, c.p + to_c / c.size), F.concat(s.out, decided(x, zero))))
            .when(x_fills & c_empties, state(nobody, F.concat(s.out, decided(x, one), decided(c, zero))))
            .when(x_fills, state(with_p(c, c.p - to_x / c.size), F.concat(s.out, decided(x, one))))
            .otherwise(state(with_p(x, x.p + to_x / x.size), F.concat(s.out, decided(c, zero))))
        )

    return F.aggregate(items, state(nobody, F.array()), meet)


def numbered(alike: DataFrame, piece: int = 65_536) -> DataFrame:
    """A row of (source, doc_id, size, turn) for each of the ``many`` alike ones; more than ``piece`` are made by several tasks."""
    few = alike.filter(F.col("many") <= piece).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)))
    pieces = alike.filter(F.col("many") > piece).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / piece))))
    last = F.least(F.col("many"), (F.col("part") + 1) * piece) - 1
    rest = pieces.repartition("source", "doc_id", "size", "part").withColumn("turn", F.explode(F.sequence(F.col("part") * piece, last))).drop("part")
    return few.unionByName(rest).select("source", "doc_id", "size", "turn")


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, cap: float = 2.0, fan: int = 128) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    sized = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"))
    alike = materialise(sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("many")), "sizes")
    targets = materialise(source_targets(alike.select("source", "size", "many"), weights, total, cap), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = targets.select(F.col("source").alias("_s"), (rate).alias("rate"))
    items = numbered(alike).join(F.broadcast(known) if targets.count() <= 100_000 else known, F.col("source").eqNullSafe(F.col("_s"))).select(
        "source", F.struct((-F.col("size")).alias("neg"), "doc_id", "size", "turn", F.floor("rate").alias("base"), (F.col("rate") - F.floor("rate")).alias("p")).alias("item")
    )
    whole = (F.col("item.p") <= 0) | (F.col("item.size") == 0)
    done = [items.filter(whole).select("source", "item.doc_id", "item.size", F.col("item.base").alias("copies"))]
    open_ = items.filter(~whole)
    most = open_.groupBy("source").count().agg(F.max("count")).collect()[0][0] or 0
    level = 0
    while most > 0:
        blocks = -(-most // fan)
        seed = F.lit(level)
        # a source's rows are dealt to as many blocks as the largest source needs; sources with fewer have smaller blocks
        block = F.pmod(F.xxhash64(seed, F.col("item.doc_id"), F.col("item.size"), F.col("item.turn")), F.lit(blocks))
        cells = open_.groupBy("source", block.alias("block")).agg(F.array_sort(F.collect_list("item")).alias("items"))
        folded = materialise(cells.select("source", _fold(F.col("items"), seed).alias("f")), f"level_{level}")
        done.append(folded.select("source", F.explode("f.out").alias("o")).select("source", "o.*"))
        open_ = folded.filter(F.col("f.cur").isNotNull()).select("source", F.col("f.cur").alias("item"))
        if blocks == 1:
            up = F.col("item.p") >= 0.5
            done.append(open_.select("source", "item.doc_id", "item.size", (F.col("item.base") + up.cast("long")).alias("copies")))
            break
        most, level = blocks, level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    return out.join(F.broadcast(t) if targets.count() <= 100_000 else t, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
