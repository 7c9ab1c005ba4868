"""Graphs as edge tables: weights, co-mentions, PageRank, components, centrality, persistence, gaps, distances, sketches' pairs."""

from __future__ import annotations

import atexit
import itertools
import pickle
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset, as in tests on one machine."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="loomstone-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(made)
        return shared_dir(spark)
    return current.get().rstrip("/")


def held(df: DataFrame, name: str) -> DataFrame:
    """Ends the lineage in a table in the shared folder: loops over it stay linear and it survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/graph/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``held`` wrote and that no plan needs any more."""
    for df in tables:
        if df is not None and (path := getattr(df, "stored_at", None)):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join for loops over tables that grow with the input. Held tables pack well and look small, so Spark would send one side through the driver, round after round."""
    return left.join(right.hint("merge"), on, how)


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, w) with a < b: parallel and opposite edges summed, self loops dropped."""
    return edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("w"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "w").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def co_mentions(mentions: DataFrame, low: int = 2, high: int = 30, weight: float = 0.25) -> DataFrame:
    """(src, dst, weight): pairs of pages for each entity on low..high distinct pages; the bound keeps pairs linear in mentions."""
    m = mentions.filter("entity IS NOT NULL").select("page", "entity").repartition("entity").distinct()
    # one shuffle; at most high + 1 pages of an entity are taken together, however many it is on
    place = F.row_number().over(Window.partitionBy("entity").orderBy("page"))
    by = m.withColumn("place", place).filter(F.col("place") <= high + 1).groupBy("entity").agg(F.count(F.lit(1)).alias("df"), F.sort_array(F.collect_list("page")).alias("pages"))
    by = by.filter(F.col("df").between(low, high)).select("pages", F.posexplode("pages").alias("at", "src"))
    return by.select("src", F.explode(F.slice("pages", F.col("at") + 2, F.size("pages"))).alias("dst"), F.lit(weight).alias("weight"))


def pagerank(pairs: DataFrame, seeds: DataFrame, damping: float = 0.5, iterations: int = 20, tolerance: float = 1e-6, held_every: int = 5, near: int = 200_000) -> DataFrame:
    """(node, score), summing to 1: personalised by seeds (node, mass above 0).

    A seed outside the graph keeps its mass, which it has nowhere to pass on: it goes back to all seeds. As nothing flows to such seeds, their
    part is one number a round. Each round is one join and one sum on the same key; every few rounds the scores are written to the shared folder, and
    the rounds end where the last changed less than ``tolerance`` in all. Mass never leaves what the seeds reach: while that is at most ``near``
    nodes it is found first, by steps that read the pairs but shuffle none, and only its edges are weighed.
    """
    edges = both_ways(held(pairs.filter("a <> b").select("a", "b", "w"), "pairs"))
    reached = held(seeds.filter("mass > 0").select(F.col("node").cast(pairs.schema["a"].dataType).alias("a")).distinct(), "reached0")
    many, turn = reached.count(), 0
    while many <= near and turn < iterations:
        turn, before = turn + 1, many
        step = edges.join(F.broadcast(reached), "a", "left_semi").select(F.col("b").alias("a"))  # at most ``near`` nodes
        reached = held(reached.unionByName(step).distinct(), f"reached{turn}")
        many = reached.count()
        if many == before:
            break
    if many <= near:
        edges = held(edges.join(F.broadcast(reached), "a", "left_semi"), "edges")
    step = edges.join(edges.groupBy("a").agg(F.sum("w").alias("out")), "a").select("a", "b", (F.col("w") / F.col("out")).alias("p"))
    step = held(step.repartition("a"), "step")
    kind = pairs.schema["a"].dataType
    mass = held(seeds.filter("mass > 0").groupBy(F.col("node").cast(kind).alias("node")).agg(F.sum("mass").alias("mass")), "seeds")
    total = mass.agg(F.sum("mass")).collect()[0][0]
    if not total:
        return mass.select("node", F.col("mass").cast("double").alias("score"))
    s = mass.select("node", (F.col("mass") / total).alias("s"))
    outside = mass.join(step.select(F.col("a").alias("node")).distinct(), "node", "left_anti").agg(F.coalesce(F.sum("mass") / total, F.lit(0.0))).collect()[0][0]
    rank, last, still = s.select("node", F.col("s").alias("score")), None, outside
    for i in range(1, iterations + 1):
        flow = rank.join(step, rank["node"] == step["a"]).select(F.col("b").alias("node"), (F.col("score") * F.col("p") * damping).alias("score"))
        back = (1 - damping) + damping * still
        still = outside * back
        rank = flow.unionByName(s.select("node", (F.col("s") * back).alias("score"))).groupBy("node").agg(F.sum("score").alias("score"))
        if i % held_every == held_every - 1 and i + 1 < iterations:
            last = rank = held(rank, f"rank{i}")
        elif i % held_every == 0 and i < iterations:
            new = held(rank, f"rank{i}")
            moved = new.select("node", "score").unionByName(last.select("node", (-F.col("score")).alias("score"))).groupBy("node").agg(F.abs(F.sum("score")).alias("d")).agg(F.sum("d")).collect()[0][0]
            discard(last)
            rank = new
            if moved < tolerance:
                break
    return rank


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Of edges with a > b. large: link every larger neighbour of u to the least of u and its neighbours; small: link the smaller ones and u itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = met(both, least, "u")
    out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def fingerprint(edges: DataFrame) -> tuple:
    """Number and exclusive-or of hashes of distinct edges (a, b): a sum of hashes would leave the range of a long at some millions of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).collect()[0])


def components(pairs: DataFrame) -> DataFrame:
    """(node, label): the least node of each component, by large-star and small-star steps until nothing changes."""
    pairs = pairs if hasattr(pairs, "stored_at") else held(pairs.select("a", "b"), "pairs")
    edges, before, step = pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), None, 0
    while True:
        step, old = step + 1, edges
        edges = held(_star(_star(edges, large=True), large=False), f"edges{step}")
        discard(old)
        now = fingerprint(edges)
        if now == before or not now[0]:
            break
        before = now
    # stars name every node that has a neighbour; the others are on loops, or beside a null
    alone = pairs.filter("a = b OR a IS NULL OR b IS NULL")
    ends = [edges.select("a", "b"), *[df.select(F.col(x).alias("a"), F.col(x).alias("b")) for df, x in ((edges, "b"), (alone, "a"), (alone, "b"))]]
    rows = ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3])
    return rows.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))


def component_sizes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(label, size) of all components, nodes without edges being their own."""
    label = met(nodes.select("node").distinct(), components(pairs), "node", "left").select(F.coalesce("label", "node").alias("label"))
    return label.groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def path_shares(near: np.ndarray, first: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """What all nodes carry of the shortest paths from ``sources``, which are followed side by side, a column each. near: neighbours in the order of
    their nodes; first: where each node's begin, and the end. A level sums over the neighbours of nodes that it can reach, for all sources at once."""
    n, wide, degree = len(first) - 1, len(sources), np.diff(first)

    def sums(rows: np.ndarray, values: np.ndarray, tile: int = 4096) -> np.ndarray:
        """Each row's sum of ``values`` over its neighbours: k-th neighbours of many rows are added together, what few rows have beyond that row by row."""
        out, got = np.zeros((len(rows), wide)), np.empty((tile, wide))
        order = np.argsort(-degree[rows], kind="stable")
        for lo in range(0, len(rows), tile):
            here = rows[order[lo : lo + tile]]
            many, at, sum_ = degree[here], first[here], np.zeros((len(here), wide))
            most = many[min(len(here) - 1, 32)]
            for k, m in enumerate(np.searchsorted(-many, -np.arange(most))):
                sum_[:m] += np.take(values, near[at[:m] + k], axis=0, out=got[:m], mode="clip")
            for i in range(np.searchsorted(-many, -most)):
                for k in range(at[i] + most, at[i] + many[i], tile):
                    sum_[i] += values[near[k : min(k + tile, at[i] + many[i])]].sum(0)
            out[order[lo : lo + tile]] = sum_
        return out

    def beside(rows: np.ndarray) -> np.ndarray:
        many = degree[rows]
        found = np.zeros(n, bool)
        found[near[np.repeat(first[rows] - np.cumsum(many) + many, many) + np.arange(many.sum())]] = True
        return np.flatnonzero(found)

    depth, paths, values = np.full((n, wide), -1, np.int32), np.zeros((n, wide)), np.zeros((n, wide))
    for table, value in ((depth, 0), (paths, 1.0), (values, 1.0)):
        table[sources, np.arange(wide)] = value
    levels = [np.unique(sources)]
    while len(rows := beside(levels[-1])) and len(rows := rows[(depth[rows] < 0).any(1)]):
        new, found = depth[rows], sums(rows, values)
        fresh = (found > 0) & (new < 0)
        if not fresh.any():
            break
        found[~fresh], new[fresh] = 0.0, len(levels)
        paths[rows] += found
        depth[rows] = new
        values[levels[-1]] = 0.0
        values[rows] = found
        levels.append(rows[fresh.any(1)])
    share, before = np.zeros((n, wide)), levels[-1]
    values[before] = 0.0
    for d in range(len(levels) - 1, 1, -1):  # what a level passes on to the one before it; sources themselves carry nothing
        ends, rows = levels[d], levels[d - 1]
        at = depth[ends] == d
        values[before], before = 0.0, ends
        values[ends] = np.divide(1.0 + share[ends], paths[ends], out=np.zeros(at.shape), where=at)
        share[rows] += np.where(depth[rows] == d - 1, paths[rows] * sums(rows, values), 0.0)
    return share.sum(1)


def betweenness(pairs: DataFrame, adjacency_bound: int = 64 << 20) -> DataFrame:
    """(node, betweenness): unweighted shortest paths, scaled by (n - 1)(n - 2), six decimals.

    Sources are spread over tasks, which share the adjacency as a broadcast if it takes at most ``adjacency_bound`` bytes; beyond that the
    same sums are made by joins, block by block of sources, so nothing but the tables grows. The cost is nodes times edges either way; a task
    follows up to 64 sources side by side.
    """
    spark = pairs.sparkSession
    links = held(pairs.select("a", "b").distinct(), "links")
    nodes = held(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct(), "nodes")
    name = F.octet_length(F.col("node").cast("string"))
    n, bytes_ = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum(name + 16), F.lit(0))).collect()[0]
    if bytes_ + 8 * links.count() > adjacency_bound:
        return _betweenness_by_joins(links, nodes, n)
    names = np.sort(nodes.toArrow()["node"].to_numpy())  # at most adjacency_bound
    known = spark.sparkContext.broadcast(names)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = (np.searchsorted(known.value, batch[c].to_numpy()).astype(np.int32) for c in "ab")
            yield pd.DataFrame({"a": np.concatenate([a, b]), "b": np.concatenate([b, a])})

    # the driver takes the neighbours alone, in the order of their nodes: four bytes for each end of a link
    numbered = held(links.mapInPandas(number, "a int, b int"), "numbered")
    near = numbered.orderBy("a").select("b").toArrow()["b"].to_numpy()
    many = numbered.groupBy("a").agg(F.count(F.lit(1)).alias("many")).toArrow()
    count = np.zeros(n, np.int64)
    count[many["a"].to_numpy()] = many["many"].to_numpy()
    first = np.concatenate([[0], np.cumsum(count)])
    shared = spark.sparkContext.broadcast((names, near, first))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, near, first = shared.value
        total, wide = np.zeros(len(names)), min(64, max(4, (1 << 21) // len(names)))  # some tables of nodes by ``wide`` sources are held
        for batch in batches:
            sources = np.searchsorted(names, batch["node"].to_numpy())
            for lo in range(0, len(sources), wide):
                total += path_shares(near, first, sources[lo : lo + wide])
        yield pd.DataFrame({"node": names, "c": total})

    kind = pairs.schema["a"].dataType.simpleString()
    part = nodes.repartition(max(1, min(n, spark.sparkContext.defaultParallelism * 4)), "node").mapInPandas(run, f"node {kind}, c double")
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return nodes.join(part.groupBy("node").agg(F.sum("c").alias("c")), "node", "left").select("node", scalars.r6(F.coalesce("c", F.lit(0.0)) * scale).alias("betweenness"))


def _betweenness_by_joins(pairs: DataFrame, nodes: DataFrame, n: int, sources: int = 1_000) -> DataFrame:
    """betweenness with tables (source, node) for ``sources`` sources at a time: paths are counted level by level, shares come back."""
    edges = held(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    blocks = -(-n // sources)
    total = None
    for block in range(blocks):
        front = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(blocks)) == block).select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths"))
        levels = [held(front, "level0")]
        seen = levels[0].select("s", "node")
        while not levels[-1].isEmpty():
            step = levels[-1].join(edges, levels[-1]["node"] == edges["a"]).groupBy("s", F.col("b").alias("node")).agg(F.sum("paths").alias("paths"))
            levels.append(held(step.join(seen, ["s", "node"], "left_anti"), f"level{len(levels)}"))
            seen = held(seen.unionByName(levels[-1].select("s", "node")), "seen")
        share = levels[-1].withColumn("share", F.lit(0.0))
        for i in range(len(levels) - 2, 0, -1):
            # what a level passes on to the one before it: paths(v) (1 + share(w)) / paths(w) for each edge v-w
            mine = levels[i].join(share.select("s", "node", "share"), ["s", "node"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
            mine = held(mine, "share")
            part = mine.groupBy("node").agg(F.sum("share").alias("c"))
            total = part if total is None else held(total.unionByName(part).groupBy("node").agg(F.sum("c").alias("c")), "total")
            down = mine.select("s", F.col("node").alias("w"), ((1 + F.col("share")) / F.col("paths")).alias("f")).join(edges, F.col("w") == F.col("a"))
            before = levels[i - 1].select("s", F.col("node").alias("b"), "paths")
            share = down.join(before, ["s", "b"]).groupBy("s", F.col("b").alias("node")).agg(F.sum(F.col("f") * F.col("paths")).alias("share"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return nodes.join(total, "node", "left").select("node", scalars.r6(F.coalesce("c", F.lit(0.0)) * scale).alias("betweenness"))


def heaviest_forest(edges: DataFrame) -> DataFrame:
    """The edges (src, dst, weight) of the spanning forest that a sweep from heavy to light, ties by (src, dst), would keep.

    Rounds: every component takes the first of its outgoing edges in that order, and components linked by those become one.
    Components at least halve each round.
    """
    left = held(edges.filter("src <> dst").withColumn("la", F.col("src")).withColumn("lb", F.col("dst")), "left")
    forest, turn = None, 0
    while not left.isEmpty():
        ends = left.select(F.struct((-F.col("weight")).alias("light"), "src", "dst", "la", "lb").alias("e"), F.explode(F.array("la", "lb")).alias("c"))
        best = ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct()
        best = held(best.select("src", "dst", (-F.col("light")).alias("weight"), "la", "lb"), f"best{turn}")
        took = best.select("src", "dst", "weight")
        forest = took if forest is None else forest.unionByName(took)
        label = held(components(best.select(F.col("la").alias("a"), F.col("lb").alias("b"))), f"label{turn}")
        x, y = label.select(F.col("node").alias("la"), F.col("label").alias("na")), label.select(F.col("node").alias("lb"), F.col("label").alias("nb"))
        moved = met(met(left, x, "la", "left"), y, "lb", "left").select("src", "dst", "weight", F.coalesce("na", "la").alias("la"), F.coalesce("nb", "lb").alias("lb"))
        old, left, turn = left, held(moved.filter("la <> lb"), f"left{turn}"), turn + 1
        discard(old, label)
    return edges.limit(0).select("src", "dst", "weight") if forest is None else forest


def _ranked(forest: DataFrame) -> DataFrame:
    """The edges with their place (rank, from 0) in the order from heavy to light, ties by (src, dst): a range sort and the sizes of its partitions."""
    keyed = forest.select("src", "dst", F.col("weight").cast("double").alias("weight")).withColumn("light", -F.col("weight"))
    sorted_ = held(keyed.repartitionByRange("light", "src", "dst").sortWithinPartitions("light", "src", "dst").select("src", "dst", "weight", F.monotonically_increasing_id().alias("at")), "sorted")
    part = F.shiftright("at", 33)
    sizes = sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    ahead = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    return sorted_.withColumn("part", part).join(F.broadcast(ahead), "part").select("src", "dst", "weight", (F.col("ahead") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))


def persistence(edges: DataFrame, leaf: int = 4096) -> DataFrame:
    """(src, dst, weight, small_side, large_side): merges of a sweep from heavy to light edges, ties by (src, dst).

    The merges are the edges of the heaviest spanning forest, which is found by joins. In the order of the sweep they are halved again and again: of
    each run of edges the heavier half is contracted to its components, for all runs at once, and the lighter half goes on between
    those, which carry their sizes. Runs of at most ``leaf`` edges, each with the sizes of its ends, are then swept side by side.
    """
    state = held(_ranked(heaviest_forest(edges.groupBy("src", "dst").agg(F.max("weight").alias("weight")))).select("rank", "src", "dst", "weight", F.col("src").alias("u"), F.lit(1).cast("long").alias("su"), F.col("dst").alias("v"), F.lit(1).cast("long").alias("sv")), "ranked")
    shift = max(0, (state.count() - 1).bit_length())
    while 1 << shift > leaf:
        run, lighter = F.shiftright("rank", shift).alias("run"), F.shiftright("rank", shift - 1).bitwiseAND(F.lit(1)) == 1
        heavy = state.filter(~lighter).select(run, "u", "su", "v", "sv")
        node = lambda side: F.struct("run", F.col(side).alias("node"))
        label = held(components(heavy.select(node("u").alias("a"), node("v").alias("b"))), f"halves{shift}")
        sizes = heavy.select(node("u").alias("node"), F.col("su").alias("size")).unionByName(heavy.select(node("v").alias("node"), F.col("sv").alias("size"))).distinct()
        whole = met(label, sizes, "node").groupBy("label").agg(F.sum("size").alias("size"))
        into = held(met(label, whole, "label").select(F.col("node.run").alias("run"), F.col("node.node").alias("old"), F.col("label.node").alias("new"), "size"), f"into{shift}")
        light = state.filter(lighter).withColumn("run", run)
        for side in "uv":
            to = into.select("run", F.col("old").alias(side), F.col("new").alias("new" + side), F.col("size").alias("size" + side))
            light = met(light, to, ["run", side], "left").withColumn(side, F.coalesce("new" + side, side)).withColumn("s" + side, F.coalesce("size" + side, "s" + side))
        following = held(state.filter(~lighter).unionByName(light.select(*state.columns)), f"state{shift}")
        discard(state, label, into)
        state, shift = following, shift - 1
    kind = edges.schema["src"].dataType.simpleString()

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        """A run of edges whose ends are components of all heavier ones."""
        up: dict = {}
        size: dict = {}

        def top(x, known):
            if x not in up:
                up[x], size[x] = x, known
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for row in pdf.sort_values("rank").itertuples(index=False):
            lo, hi = sorted((top(row.u, row.su), top(row.v, row.sv)), key=size.get)
            out.append((row.src, row.dst, row.weight, size[lo], size[hi]))
            up[lo], size[hi] = hi, size[hi] + size[lo]
        return pd.DataFrame(out, columns=["src", "dst", "weight", "small_side", "large_side"])

    return state.groupBy(F.shiftright("rank", shift)).applyInPandas(sweep, f"src {kind}, dst {kind}, weight double, small_side long, large_side long")


def fragile_bridges(edges: DataFrame, limit: int = 10, leaf: int = 4096) -> DataFrame:
    return persistence(edges, leaf).filter("small_side >= 2").orderBy("weight", "src", "dst").limit(limit)


def structural_gaps(edges: DataFrame, community: DataFrame, articulation: DataFrame, limit: int = 8, min_size: int = 2, first: int = 64) -> DataFrame:
    """(ca, cb, rep_a, rep_b, deficit, expected, actual): pairs of communities with less weight between them than degrees suggest.

    community: (node, community); articulation: (node, betweenness). Exact at any number of communities, without listing their pairs.
    """
    ends = edges.select(F.col("src").alias("node"), "weight").unionByName(edges.select(F.col("dst").alias("node"), "weight"))
    degree = held(ends.groupBy("node").agg(F.sum("weight").alias("k")), "degree")
    total = degree.agg(F.coalesce(F.nullif(F.sum("k") / 2, F.lit(0.0)), F.lit(1.0)).alias("total"))
    who = community.join(degree, "node", "left").join(articulation, "node", "left")
    by = who.groupBy("community").agg(F.sum(F.coalesce("k", F.lit(0.0))).alias("k"), F.count(F.lit(1)).alias("size"), F.max_by("node", F.struct(F.coalesce("betweenness", F.lit(0.0)), F.hash("node"))).alias("any"), F.max(F.coalesce("betweenness", F.lit(0.0))).alias("top"))
    rep = who.join(by.select("community", "top"), "community").filter(F.coalesce("betweenness", F.lit(0.0)) == F.col("top")).groupBy("community").agg(F.min("node").alias("rep"))
    by = by.join(rep, "community").filter((F.col("size") >= min_size) & (F.col("community") >= 0)).select("community", "k", "rep")
    c = lambda side, n: community.select(F.col("node").alias(side), F.col("community").alias(n))
    inter = edges.join(c("src", "x"), "src").join(c("dst", "y"), "dst").filter("x <> y").groupBy(F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb")).agg(F.sum("weight").alias("actual"))
    by, inter = held(by, "communities"), held(inter, "between")
    m = total.collect()[0][0]
    c2 = lambda n: by.select(F.col("community").alias(n), F.col("k").alias("k" + n), F.col("rep").alias("rep_" + n[1]))
    near = inter.join(c2("ca"), "ca").join(c2("cb"), "cb")

    def ranked(pairs: DataFrame) -> DataFrame:
        x = pairs.withColumn("expected", F.col("kca") * F.col("kcb") / (2 * m)).withColumn("deficit", F.col("expected") - F.col("actual")).filter("deficit > 0")
        return x.orderBy(F.desc("deficit"), "ca", "cb").limit(limit)

    # Pairs with an edge are looked at one by one. Of the others the gap is the expected weight, so the greatest are among the heaviest
    # communities: once the limit-th gap found reaches what the heaviest and the first left out could have, no pair is missed.
    many = by.count()
    while True:
        heavy = by.orderBy(F.desc("k"), "community").limit(first)
        one = heavy.agg(F.collect_list(F.struct("community", "k", "rep")).alias("xs"))  # at most ``first`` rows
        two = one.select("xs", F.explode("xs").alias("x")).select("x", F.explode("xs").alias("y")).filter(F.col("x.community") < F.col("y.community"))
        far = two.select(F.col("x.community").alias("ca"), F.col("y.community").alias("cb"), F.col("x.k").alias("kca"), F.col("y.k").alias("kcb"), F.col("x.rep").alias("rep_a"), F.col("y.rep").alias("rep_b"))
        far = far.join(inter.select("ca", "cb"), ["ca", "cb"], "left_anti").withColumn("actual", F.lit(0.0))
        top = ranked(near.select(*far.columns).unionByName(far))
        if many <= first:
            break
        edge = by.orderBy(F.desc("k"), "community").limit(first + 1).select("k").collect()  # rows in order
        found = top.agg(F.count(F.lit(1)).alias("n"), F.min("deficit").alias("least")).collect()[0]
        if found.n == limit and found.least > edge[0].k * edge[-1].k / (2 * m):
            break
        first *= 2
    return top.select("ca", "cb", "rep_a", "rep_b", *[scalars.r6(F.col(x)).alias(x) for x in ("deficit", "expected", "actual")])


def distances(pairs: DataFrame, root, most: int = 3) -> DataFrame:
    """(node, distance) from root, up to ``most`` steps."""
    pairs = pairs if hasattr(pairs, "stored_at") else held(pairs, "pairs")
    edges = both_ways(pairs).select("a", "b")
    seen = front = held(edges.filter(F.col("a") == root).select(F.col("a").alias("node")).distinct().withColumn("distance", F.lit(0)), "front0")
    for d in range(1, most + 1):
        step = front.join(edges, front.node == edges.a).select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = held(step.withColumn("distance", F.lit(d)), f"front{d}")  # of known size: a small one goes to the edges, not they to it
        seen = seen.unionByName(front)
    return seen


def degrees(pairs: DataFrame) -> DataFrame:
    return both_ways(pairs).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def hubs(pairs: DataFrame, at_least: int = 8) -> DataFrame:
    """Nodes whose degree exceeds max(p99, at_least); p99 is the sorted degree at index floor(0.99 (n - 1))."""
    d = degrees(pairs)
    of = d.groupBy("degree").agg(F.count(F.lit(1)).alias("many"))  # a row a degree: far fewer than nodes
    upto = of.select("degree", F.sum("many").over(Window.orderBy("degree")).alias("upto"))
    n = of.agg(F.coalesce(F.sum("many"), F.lit(0))).collect()[0][0]
    nth = upto.filter(F.col("upto") > int(0.99 * (n - 1))).agg(F.min("degree").alias("degree"))
    return d.crossJoin(F.broadcast(nth.select(F.greatest("degree", F.lit(at_least)).alias("cut")))).filter("degree > cut").select("node", "degree")


def canonical_labels(labels: DataFrame) -> DataFrame:
    """Communities renumbered from 0 by their least member; -1 stays."""
    first = labels.filter("community >= 0").groupBy("community").agg(F.min("node").alias("first"))
    new = first.withColumn("new", F.dense_rank().over(Window.orderBy("first")) - 1)
    return labels.join(new, "community", "left").select("node", F.coalesce("new", F.lit(-1)).cast("int").alias("community"))


def close_sketches(sketches: DataFrame, most: int = 8, agree: int = 2) -> DataFrame:
    """(a, b, bits): pairs of (id, h) at most ``most`` bits apart, exactly.

    A sketch is cut into most + agree bands; two sketches that differ in ``most`` bits agree in ``agree`` bands at least, so they meet under
    a key of some ``agree`` bands. More bands a key make more keys and smaller buckets. Equal sketches are represented once (least id);
    the members of such a class follow it. A constant sketch, 0, is that of empty texts and is left out.
    """
    solid = held(sketches.filter("h <> 0").select("id", "h"), "sketches")
    reps = solid.groupBy("h").agg(F.min("id").alias("id"))
    n = most + agree
    cut = [round(64 * i / n) for i in range(n + 1)]
    band = [F.shiftrightunsigned("h", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in itertools.pairwise(cut)]
    keys = F.array(*[F.xxhash64(F.lit(i), *[band[k] for k in which]) for i, which in enumerate(itertools.combinations(range(n), agree))])
    b = held(reps.select("id", "h", F.explode(keys).alias("key")), "bands")
    x, y = b.select("key", F.col("id").alias("a"), F.col("h").alias("ha")), b.select("key", F.col("id").alias("b"), F.col("h").alias("hb"))
    bits = scalars.hamming(F.col("ha"), F.col("hb"))
    far = x.join(y, "key").filter((F.col("a") < F.col("b")) & (bits <= most)).select("a", "b", bits.alias("bits")).distinct()
    same = solid.join(reps.select("h", F.col("id").alias("a")), "h").filter("id <> a").select("a", F.col("id").alias("b"), F.lit(0).alias("bits"))
    return far.unionByName(same)


def dense_codes(members: DataFrame, most: int = 1024) -> tuple[DataFrame, int] | None:
    """(id, codes) of (id, name) and the number of names, if they are at most ``most``; else nothing. No more than ``most`` + 1 names reach the driver."""
    names = sorted(r.name for r in members.select("name").distinct().filter("name IS NOT NULL").limit(most + 1).collect())
    if len(names) > most:
        return None
    code = members.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"name {members.schema['name'].dataType.simpleString()}, code int")
    return members.distinct().join(F.broadcast(code), "name").groupBy("id").agg(F.collect_list("code").alias("codes")), len(names)


def dense_overlaps(sets: DataFrame, width: int, keep: Callable, block: int = 4096) -> DataFrame:
    """(a, b, s, na, nb): pairs of sets (id, codes below ``width``) that ``keep`` (of arrays s shared, na, nb members) accepts, a < b.

    Where names are few nearly all sets meet, so pairs are not listed under names: blocks of sets meet once, as a matrix product, a strip at a
    time; only what is kept leaves it. A block is packed to a bit a name, and beyond 48 blocks of ``block`` sets blocks grow instead of their number,
    up to 65,536 sets (fewer if names are many): what travels is the packed sets, once for each block.
    """
    sets = held(sets, "sets")
    many = sets.count()
    blocks = max(1, min(-(-many // block), 48), -(-many // max(1, min(1 << 16, (1 << 23) // max(width, 1)))))
    kind = sets.schema["id"].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        bits = np.zeros((len(pdf), width), bool)
        bits[np.repeat(np.arange(len(pdf)), pdf["codes"].map(len)), np.concatenate([np.asarray(x, np.int64) for x in pdf["codes"]])] = True
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "data": [zlib.compress(pickle.dumps((pdf["id"].to_numpy(), np.packbits(bits, axis=1))), 1)]})

    placed = sets.select("id", "codes", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("i"))
    packed = held(placed.groupBy("i").applyInPandas(pack, "i int, data binary"), "packed")
    one = packed.select("i", F.explode(F.sequence("i", F.lit(blocks - 1))).alias("j"), F.col("data").alias("x"), F.lit(None).cast("binary").alias("y"))
    two = packed.select(F.explode(F.sequence(F.lit(0), F.col("i"))).alias("i"), F.col("i").alias("j"), F.lit(None).cast("binary").alias("x"), F.col("data").alias("y"))
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as few bytes make many pairs
    cells = one.unionByName(two).repartition(tasks, "i", "j").groupBy("i", "j").agg(F.first("x", ignorenulls=True).alias("x"), F.first("y", ignorenulls=True).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")

    def matrix(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        ids, bits = pickle.loads(zlib.decompress(data))
        return ids, np.unpackbits(bits, axis=1, count=width).astype(np.float32)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, j, x, y in zip(batch["i"], batch["j"], batch["x"], batch["y"]):
                (xs, mine), (ys, theirs) = matrix(x), matrix(y)
                nx, ny = mine.sum(1).astype(np.int32), theirs.sum(1).astype(np.int32)
                strip = max(1, (1 << 21) // len(ys))
                for at in range(0, len(xs), strip):
                    s = (mine[at : at + strip] @ theirs.T).astype(np.int32)  # counts are exact
                    ok = (s > 0) & keep(s, nx[at : at + strip, None], ny[None, :])
                    if i == j:
                        ok &= xs[at : at + strip, None] < ys[None, :]
                    p, q = np.nonzero(ok)
                    if len(p):
                        yield pd.DataFrame({"x": xs[at + p], "y": ys[q], "s": s[p, q].astype(np.int64), "nx": nx[at + p].astype(np.int64), "ny": ny[q].astype(np.int64)})

    met = cells.mapInPandas(meet, f"x {kind}, y {kind}, s long, nx long, ny long")
    first = F.col("x") < F.col("y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "s", F.when(first, F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(first, F.col("ny")).otherwise(F.col("nx")).alias("nb"))


def in_blocks(rows: DataFrame, most_rows: int, most_ids: int) -> DataFrame:
    """(id, block, at, many) of rows (id): neighbours in the order of ids share a block of at most about ``most_rows`` rows and ``most_ids`` ids;
    ``at`` is an id's place in its block, ``many`` its number of rows. An id with more rows than that has a block nearly to itself."""
    counts = held(rows.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("many")), "counts")
    share = F.greatest(F.ceil(F.col("many") * most_ids / most_rows), F.lit(1))
    part = counts.repartitionByRange(max(1, min(counts.count() // 1000, 1000)), "id").withColumns({"share": share, "part": F.spark_partition_id()})
    part = held(part.withColumn("upto", F.sum("share").over(Window.partitionBy("part").orderBy("id"))), "parts")
    ahead = part.groupBy("part").agg(F.max("upto").alias("all")).select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("ahead"))  # a row a part
    block = F.floor((F.col("ahead") + F.col("upto") - F.col("share")) / most_ids).cast("int")
    placed = part.join(F.broadcast(ahead), "part").select("id", block.alias("block"), "many")
    return held(placed.withColumn("at", F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1), "blocks")


def _packed(rows: DataFrame, placed: DataFrame, codes: DataFrame, parts: int) -> DataFrame:
    """(block, part, data, ids, many) of rows (name, id, v): the rows of a block whose names have codes, in the order of codes, with the block's ids
    and their numbers of rows. A row takes a few bytes: codes are told by their distance, values are listed once."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["code", "at"], kind="stable")
        values, which = np.unique(pdf["v"].to_numpy(), return_inverse=True)
        step = np.diff(pdf["code"].to_numpy(), prepend=0)
        far = np.flatnonzero(step >= 1 << 16)
        leap, step[far] = step[far], 0
        least = lambda x: x.astype(np.min_scalar_type(int(x.max())))
        data = zlib.compress(pickle.dumps((least(step), far, leap, least(pdf["at"].to_numpy()), least(which), values)), 1)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [pdf["part"].iloc[0]], "data": [data]})

    kept = rows.join(codes, "name").join(placed.select("id", "block", "at"), "id").select("block", F.pmod(F.hash("code"), F.lit(parts)).alias("part"), "code", "at", "v")
    data = held(kept.groupBy("block", "part").applyInPandas(pack, "block int, part int, data binary"), "packed")
    ids = placed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "id", "many"))).alias("x"))  # a block's ids have a bound
    return data.join(ids.select("block", F.col("x.id").alias("ids"), F.col("x.many").alias("many")), "block")


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    step, far, leap, at, which, values = pickle.loads(zlib.decompress(data))
    step = step.astype(np.int64)
    step[far] = leap
    return np.cumsum(step), at.astype(np.int32), values[which]


def shared_names(left: DataFrame, right: DataFrame, block: int = 2048, rows: int = 1 << 21, keep: Callable | None = None, without: DataFrame | None = None) -> DataFrame:
    """(a, b, s): the sum of ``v`` over the names that a and b share. left: (name, a); right: (name, b, v); rows that repeat count again.

    Pairs are made and summed where they meet: ids are cut to blocks of at most about ``block`` ids and ``rows`` rows, a block is packed to a few bytes a row,
    and blocks that may share names meet in cells (block of a, block of b). So packed rows travel, once for each such block of the other side; pairs
    never do. ``keep`` (of s and the numbers of rows of a and b) tells which pairs leave a cell; pairs of ``without`` (a, b) don't. An id of more
    than about ``rows`` rows makes blocks be cut by name as well; only then are pairs added up and judged outside.
    """
    left, right = left.filter("name IS NOT NULL"), right.filter("name IS NOT NULL")
    at_a, at_b = (in_blocks(df.select(F.col(c).alias("id")), rows, block) for df, c in ((left, "a"), (right, "b")))
    sizes = at_a.groupBy("block").agg(F.sum("many").alias("n")).unionByName(at_b.groupBy("block").agg(F.sum("many").alias("n")))
    most = sizes.agg(F.max("n")).collect()[0][0] or 1
    parts = 1 if most <= 2 * rows else -(-most // rows)
    names = held(left.select("name").distinct().join(right.select("name").distinct(), "name", "left_semi"), "names")
    ranges = max(1, min(names.count() // 1000, 256))
    codes = held(names.repartitionByRange(ranges, "name").sortWithinPartitions("name").select("name", F.monotonically_increasing_id().alias("code")), "codes")
    # blocks meet if they have names in a common range of names
    near = [df.join(codes, "name").join(at.select(F.col("id").alias(c), F.col("block").alias(b)), c).select(b, F.shiftright("code", 33).alias("range")).distinct() for df, at, c, b in ((left, at_a, "a", "i"), (right, at_b, "b", "j"))]
    cells = near[0].join(near[1], "range").select("i", "j").distinct()
    if without is not None:
        ends = [at.select(F.col("id").alias(c), F.col("block").alias(b), F.col("at").alias(f"at_{c}")) for at, c, b in ((at_a, "a", "i"), (at_b, "b", "j"))]
        out = without.select("a", "b").distinct().join(ends[0], "a").join(ends[1], "b").groupBy("i", "j").agg(F.collect_list(F.struct("at_a", "at_b")).alias("out"))
        cells = cells.join(out, ["i", "j"], "left").select("i", "j", F.col("out.at_a").alias("out_a"), F.col("out.at_b").alias("out_b"))
    cells = held(cells, "cells")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as few bytes make many pairs
    x = _packed(left.select("name", F.col("a").alias("id"), F.lit(1.0).alias("v")), at_a, codes, parts).withColumnRenamed("block", "i").join(cells, "i")
    y = _packed(right.select("name", F.col("b").alias("id"), F.col("v").cast("double").alias("v")), at_b, codes, parts).withColumnRenamed("block", "j").join(cells.select("i", "j"), "j")
    x, y = (df.repartition(tasks, "i", "j", "part").groupBy("i", "j", "part") for df in (x, y))
    kinds = [df.schema[n].dataType.simpleString() for df, n in ((left, "a"), (right, "b"))]
    whole, barred = parts == 1, without is not None

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = {"a": [], "b": [], "s": []}
        if len(x) and len(y):
            x, y = x.iloc[0], y.iloc[0]
            (mine, a, _), (theirs, b, v) = _unpacked(x["data"]), _unpacked(y["data"])
            first = np.searchsorted(theirs, mine)
            many = np.searchsorted(theirs, mine, "right") - first
            order = np.argsort(a, kind="stable")
            order = order[many[order] > 0]
            a, first, many = a[order], first[order], many[order]
            as_, bs, wide = x["ids"], y["ids"], len(y["ids"])
            out = np.zeros(0, np.int64)
            if whole and barred and x["out_a"] is not None:
                out = np.sort(x["out_a"].astype(np.int64) * wide + x["out_b"])
            strip = max(1, (1 << 21) // wide)
            upto = np.cumsum(many)
            for lo in range(0, len(as_), strip):
                e0, e1 = np.searchsorted(a, [lo, lo + strip])
                if e0 == e1:
                    continue
                begin = upto[e0] - many[e0]
                cuts = np.searchsorted(upto[e0:e1], np.arange(begin + (1 << 21), upto[e1 - 1], 1 << 21), "right") + e0
                height = min(strip, len(as_) - lo)
                dense = (upto[e1 - 1] - begin) * 16 >= height * wide
                total, seen, sparse = np.zeros(height * wide if dense else 0), np.zeros(height * wide if dense else 0, bool), []
                for p, q in itertools.pairwise(np.unique([e0, *cuts, e1])):  # about two million pairs at a time
                    m = many[p:q]
                    at = np.repeat(first[p:q] - np.cumsum(m) + m, m) + np.arange(m.sum())
                    pair = np.repeat((a[p:q].astype(np.int64) - lo) * wide, m) + b[at]
                    if dense:
                        total += np.bincount(pair, v[at], len(total))
                        seen[pair] = True
                    else:
                        sparse.append((pair, v[at]))
                if dense:
                    pair = np.flatnonzero(seen)
                    total = total[pair]
                else:
                    pair, which = np.unique(np.concatenate([p for p, _ in sparse]), return_inverse=True)
                    total = np.bincount(which, np.concatenate([w for _, w in sparse]))
                p, q = np.divmod(pair, wide)
                p += lo
                ok = np.ones(len(pair), bool)
                if len(out):
                    ok = out[np.minimum(np.searchsorted(out, pair + lo * wide), len(out) - 1)] != pair + lo * wide
                if keep and whole:
                    ok &= keep(total, x["many"][p], y["many"][q])
                for name, values in (("a", as_[p[ok]]), ("b", bs[q[ok]]), ("s", total[ok])):
                    found[name].append(values)
        if not any(map(len, found["s"])):
            return pd.DataFrame()
        return pd.DataFrame({n: np.concatenate(v) for n, v in found.items()})

    met = x.cogroup(y).applyInPandas(meet, f"a {kinds[0]}, b {kinds[1]}, s double")
    if whole:
        return met
    met = met.groupBy("a", "b").agg(F.sum("s").alias("s"))
    if without is not None:
        met = met.join(without.select("a", "b"), ["a", "b"], "left_anti")
    if keep:
        met = met.join(at_a.select(F.col("id").alias("a"), F.col("many").alias("na")), "a").join(at_b.select(F.col("id").alias("b"), F.col("many").alias("nb")), "b").filter(keep(F.col("s"), F.col("na"), F.col("nb"))).select("a", "b", "s")
    return met


def match_themes(old: DataFrame, new: DataFrame, tau: float = 1 / 3) -> DataFrame:
    """(old, new, jaccard) of (theme, page) and (community, page) that overlap enough: members meet in cells of themes by communities."""
    a = old.groupBy("theme").agg(F.countDistinct("page").alias("na"))
    b = new.groupBy("community").agg(F.countDistinct("page").alias("nb"))
    left, right = old.select(F.col("page").alias("name"), F.col("theme").alias("a")).distinct(), new.select(F.col("page").alias("name"), F.col("community").alias("b"), F.lit(1.0).alias("v")).distinct()
    alike = lambda s, na, nb: s / (na + nb - s) >= tau  # noqa: E731  # few pairs leave a cell, so blocks are large
    shared = shared_names(left, right, 1 << 14, 1 << 22, alike).select(F.col("a").alias("theme"), F.col("b").alias("community"), F.col("s").cast("long").alias("s"))
    j = shared.join(a, "theme").join(b, "community").withColumn("jaccard", F.col("s") / (F.col("na") + F.col("nb") - F.col("s")))
    return j.filter(F.col("jaccard") >= tau).select("theme", "community", "jaccard", "na", "nb", "s")


def theme_events(old: DataFrame, new: DataFrame, tau: float = 1 / 3) -> DataFrame:
    """(event, theme, community): what became of each old theme, and which communities are new."""
    m = match_themes(old, new, tau)
    m = m.withColumn("fan", F.count(F.lit(1)).over(Window.partitionBy("theme"))).withColumn("merge", F.count(F.lit(1)).over(Window.partitionBy("community")))
    m = m.withColumn("best", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("jaccard"), F.desc("theme"))))
    kept = m.filter("fan = 1")
    event = F.when((F.col("merge") > 1) & (F.col("best") == 1), "merged").when(F.col("merge") > 1, "died").when((F.col("s") == F.col("na")) & (F.col("s") == F.col("nb")), F.lit(None)).when(F.col("nb") > F.col("na"), "grew").otherwise("shrank")
    events = kept.select(event.alias("event"), "theme", "community").filter("event IS NOT NULL")
    split = m.filter("fan > 1").select(F.lit("split").alias("event"), "theme", F.lit(None).cast(m.schema["community"].dataType).alias("community")).distinct()
    births = m.filter("fan > 1").select(F.lit("born").alias("event"), F.lit(None).cast(m.schema["theme"].dataType).alias("theme"), "community")
    died = old.select("theme").distinct().join(m.select("theme"), "theme", "left_anti").select(F.lit("died").alias("event"), "theme", F.lit(None).cast(m.schema["community"].dataType).alias("community"))
    born = new.select("community").distinct().join(m.select("community"), "community", "left_anti").select(F.lit("born").alias("event"), F.lit(None).cast(m.schema["theme"].dataType).alias("theme"), "community")
    return events.unionByName(split).unionByName(births).unionByName(died).unionByName(born)
