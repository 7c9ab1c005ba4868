"""The graph queries over all orders of a small table, against brute force."""

import inspect
import random
from collections import Counter, defaultdict, deque

import pytest

from loomstone.operators import graph
from loomstone.plans import registry

ORDERS = {1: (1, 2, 3), 2: (3, 4), 7: (4, 5, 6), 40: (6, 7), 41: (10, 11), 43: (11, 12, 13), 80: (13, 14), 81: (2, 5), 82: (20, 24), 83: (21, 25), 84: (24, 25)}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("lineitem"))
    rows = [(o, p) for o, parts in ORDERS.items() for p in parts]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{at}/lineitem.parquet")
    near = defaultdict(set)
    for parts in ORDERS.values():
        for a in parts:
            near[a] |= set(parts) - {a}
    return at, near


def steps(near, root):
    """Distances and numbers of shortest paths from root."""
    d, paths, todo = {root: 0}, defaultdict(int, {root: 1}), deque([root])
    while todo:
        v = todo.popleft()
        for w in near[v]:
            if w not in d:
                d[w] = d[v] + 1
                todo.append(w)
            if d[w] == d[v] + 1:
                paths[w] += paths[v]
    return d, paths


def test_components_and_distances(spark, table):
    at, near = table
    got = {r.node: r.label for r in registry.QUERIES["j04_components"](spark, at).collect()}
    assert got == {v: min(steps(near, v)[0]) for v in near}
    got = {r.node: r.distance for r in registry.QUERIES["j08_distances"](spark, at).collect()}
    assert got == {v: d for v, d in steps(near, 1)[0].items() if d <= 3}


def test_betweenness(spark, table):
    at, near = table
    all_ = {v: steps(near, v) for v in near}
    want = dict.fromkeys(near, 0.0)
    for s, (d, paths) in all_.items():
        for t in d:
            for v in d:
                if v not in (s, t) and s != t and d[v] + all_[v][0][t] == d[t]:
                    want[v] += paths[v] * all_[v][1][t] / paths[t]
    n = len(near)
    got = {r.node: r.betweenness for r in registry.QUERIES["j03_betweenness"](spark, at).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v] / ((n - 1) * (n - 2))) < 1e-6 for v in want)


def test_bridges(spark, table):
    at, near = table
    up, size, want = {v: v for v in near}, dict.fromkeys(near, 1), []

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in sorted((a, b) for a in near for b in near[a] if a < b):  # all weights are equal
        lo, hi = sorted((top(a), top(b)), key=lambda x: size[x])
        if lo != hi:
            if size[lo] >= 2:
                want.append((a, b, size[lo], size[hi]))
            up[lo] = hi
            size[hi] += size[lo]
    got = [(r.src, r.dst, r.small_side, r.large_side) for r in registry.QUERIES["j06_bridges"](spark, at).collect()]
    assert got == want[:10] and want


def test_components_of_a_long_path(spark):
    names = list(range(100))
    random.Random(1).shuffle(names)
    got = graph.components(spark.createDataFrame(list(zip(names, names[1:])) + [(200, 200), (300, 301)], "a long, b long")).collect()
    assert {(r.node, r.label) for r in got} == {(v, 0) for v in names} | {(200, 200), (300, 300), (301, 300)}


def test_hubs_take_the_exact_rank(spark):
    edges = [(0, i) for i in range(1, 301)] + [(i, i + 1) for i in range(1, 40)] + [(1, i) for i in range(100, 112)] + [(2, i) for i in range(200, 211)] + [(3, i) for i in range(220, 228)]
    pairs = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "a long, b long, w double")
    degree = Counter(v for e in edges for v in e)
    cut = max(8, sorted(degree.values())[int(0.99 * (len(degree) - 1))])
    assert {(r.node, r.degree) for r in graph.hubs(pairs).collect()} == {(v, k) for v, k in degree.items() if k > cut}
    assert "percentile_approx" not in inspect.getsource(graph.hubs)
