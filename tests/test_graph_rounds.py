"""Graph loops by joins against plain loops: PageRank with seeds outside, merge sizes of a sweep, communities by modularity."""

import random
from collections import Counter, defaultdict

import pytest

from loomstone.operators import communities, graph, workflows


def walk(pairs, seeds, damping=0.5, iterations=20):
    adjacency = defaultdict(dict)
    for a, b, w in pairs:
        adjacency[a][b] = adjacency[b][a] = w
    nodes, total = set(adjacency) | set(seeds), sum(seeds.values())
    restart = {n: seeds.get(n, 0.0) / total for n in nodes}
    rank = dict(restart)
    for _ in range(iterations):
        back = (1 - damping) + damping * sum(rank[n] for n in nodes if not adjacency.get(n))
        rank = {n: restart[n] * back + damping * sum(rank[u] * w / sum(adjacency[u].values()) for u, w in adjacency.get(n, {}).items()) for n in nodes}
    return rank


@pytest.mark.parametrize("damping", [0.5, 0.2])
def test_pagerank(spark, damping):
    rng = random.Random(1)
    pairs = [(a, b, float(rng.randint(1, 4))) for a in range(25) for b in range(a + 1, 25) if rng.random() < 0.12]
    seeds = {0: 2.0, 7: 1.0, 900: 4.0, 901: 0.5}
    got = graph.pagerank(spark.createDataFrame(pairs, "a long, b long, w double"), spark.createDataFrame([*seeds.items(), (902, 0.0)], "node long, mass double"), damping, held_every=3)
    rank = {r.node: r.score for r in got.collect()}
    want = walk(pairs, seeds, damping)
    assert abs(sum(rank.values()) - 1) < 1e-9 and rank.keys() <= want.keys()
    assert all(abs(rank.get(n, 0.0) - want[n]) < 2e-6 for n in want)


def sweep(edges):
    up, size, out = {}, Counter(), []

    def top(x):
        up.setdefault(x, x)
        size[x] = size[x] or 1
        return x if up[x] == x else top(up[x])

    for s, d, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        a, b = sorted((top(s), top(d)), key=lambda x: size[x])
        if a != b:
            out.append((s, d, w, size[a], size[b]))
            up[a] = b
            size[b] += size[a]
    return sorted(out)


@pytest.mark.parametrize("leaf", [2, 8, 4096])
def test_merge_sizes(spark, leaf):
    rng = random.Random(leaf)
    edges = list({(a, b): (a, b, float(rng.randint(1, 3))) for a, b in ((rng.choice("abcdefghijklmnopqrstuv"), rng.choice("abcdefghijklmnopqrstuv")) for _ in range(45)) if a < b}.values())
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    assert sorted(map(tuple, graph.persistence(df, leaf).collect())) == sweep(edges)
    assert graph.persistence(df.limit(0), leaf).collect() == []
    plan = graph.persistence(df, leaf)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def quality(edges, label):
    m, k = sum(w for _, _, w in edges), Counter()
    for a, b, w in edges:
        k[label[a]] += w
        k[label[b]] += w
    return sum(w for a, b, w in edges if label[a] == label[b]) / m - sum(x * x for x in k.values()) / (4 * m * m)


def louvain(edges, seed):
    """Local moving and contraction on one machine."""
    adj = defaultdict(Counter)
    for a, b, w in edges:
        adj[a][b] += w
        adj[b][a] += w
    m, members, loops = sum(w for _, _, w in edges), {v: {v} for v in adj}, Counter()
    while True:
        k = {v: sum(adj[v].values()) + 2 * loops[v] for v in adj}
        c, total, order, moved = {v: v for v in adj}, Counter(k), random.Random(seed).sample(list(adj), len(adj)), False
        busy = True
        while busy:
            busy = False
            for v in order:
                by = Counter({c[v]: 0.0})
                for u, w in adj[v].items():
                    by[c[u]] += w
                total[c[v]] -= k[v]
                to = max(by, key=lambda x: (by[x] / m - k[v] * total[x] / (2 * m * m), x == c[v], x))
                busy, moved, c[v] = busy or to != c[v], moved or to != c[v], to
                total[to] += k[v]
        if not moved:
            return {x: min(s) for s in members.values() for x in s}
        new, inner, joined = defaultdict(Counter), Counter(), defaultdict(set)
        for v in adj:
            joined[c[v]] |= members[v]
            inner[c[v]] += loops[v]
            new[c[v]]
            for u, w in adj[v].items():
                if c[u] == c[v]:
                    inner[c[v]] += w / 2
                else:
                    new[c[v]][c[u]] += w
        adj, members, loops = new, joined, inner


def planted(rng, n, groups, inside, between):
    return [(i, j, 1.0 + rng.random()) for i in range(n) for j in range(i) if rng.random() < (inside if i % groups == j % groups else between)]


def test_communities(spark):
    edges = planted(random.Random(3), 120, 5, 0.35, 0.03)
    pairs = spark.createDataFrame(edges, "a long, b long, w double")
    found = communities.communities(pairs)
    label = {r.node: r.community for r in found.collect()}
    best = max(quality(edges, louvain(edges, s)) for s in range(3))
    assert label.keys() == {x for e in edges for x in e[:2]} and quality(edges, label) >= 0.98 * best
    assert all(label[label[v]] == label[v] and label[v] <= v for v in label)
    parts = {r.node: r.label for r in graph.components(pairs).collect()}
    assert quality(edges, label) >= quality(edges, parts)
    again = {r.node: r.community for r in communities.communities(pairs.repartition(7)).collect()}
    assert again == label
    q = communities.modularity(pairs, found).collect()[0].modularity
    assert abs(q - quality(edges, label)) < 1e-9


def test_communities_of_odd_graphs(spark):
    kind = "a string, b string, w double"
    assert communities.communities(spark.createDataFrame([], kind)).collect() == []
    two = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 2.0), ("y", "x", 1.0), ("z", "z", 5.0)]
    got = {r.node: r.community for r in communities.communities(spark.createDataFrame(two, kind)).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}


def test_no_round_lowers_modularity(spark):
    rng = random.Random(9)
    edges = planted(rng, 60, 1, 0.12, 0.0) + [(100, i, 3.0) for i in range(60)]  # and a hub
    pairs = spark.createDataFrame(edges, "a long, b long, w double")
    m, both = sum(w for _, _, w in edges), graph.held(graph.both_ways(pairs), "both")
    k = Counter()
    for a, b, w in edges:
        k[a] += w
        k[b] += w
    nodes, moved = graph.held(spark.createDataFrame([(v, v, float(x), 0) for v, x in k.items()], "node long, c long, k double, parent long"), "nodes"), 0
    for turn in range(5):
        before = {r.node: r.c for r in nodes.collect()}
        after = communities._round(both, nodes, m, turn, False)
        now = {r.node: r.c for r in after.collect()}
        gained = sum(r.gain for r in after.collect())
        moved += sum(now[v] != before[v] for v in now)
        assert quality(edges, now) - quality(edges, before) >= gained - 1e-9 >= -1e-9
        nodes = after.drop("gain")
    assert moved > 20


def test_the_community_job_takes_either_partition(spark):
    edges = planted(random.Random(5), 40, 2, 0.5, 0.05)
    pairs = spark.createDataFrame(edges, "a long, b long, w double")
    nodes, themes = spark.range(45).withColumnRenamed("id", "node"), spark.createDataFrame([("t", 0), ("t", 2)], "theme string, page long")
    one = workflows.community_job(pairs, nodes, themes)
    sizes = Counter(r.community for r in one["community"].collect())
    assert len(sizes) >= 2 and sum(sizes.values()) + one["unplaced"].count() == 45
    whole = workflows.community_job(pairs, nodes, themes, "components")["community"]
    assert len({r.community for r in whole.collect()}) == 1
