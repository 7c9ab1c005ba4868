"""Shares of shortest paths, many sources a pass, against the plain loop of one source at a time."""

import random

import numpy as np
import pytest

from loomstone.operators import graph


def plain(near, sources):
    total = np.zeros(len(near))
    for source in sources:
        depth, paths, order = {source: 0}, {source: 1}, [source]
        for v in order:
            for w in near[v]:
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if depth[v] == depth[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
        for v in order[1:]:
            total[v] += share[v]
    return total


RANDOM = random.Random(5)
SHAPES = {
    "path": [(i, i + 1) for i in range(60)],
    "star": [(0, i) for i in range(1, 70)],
    "parts": [(0, 1), (2, 3), (3, 4), (4, 2), (5, 6), (6, 7), (7, 8), (8, 5)],
    "random": list({tuple(sorted(RANDOM.sample(range(80), 2))) for _ in range(260)}),
    "hubs": [(i, j) for i in range(3) for j in range(3, 60)] + [(59, 60), (60, 61)],
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("wide", [1, 7, 64])
def test_shares_of_many_sources(shape, wide):
    names = {x: i for i, x in enumerate(sorted({x for e in SHAPES[shape] for x in e}))}
    near = [[] for _ in names]
    for a, b in SHAPES[shape]:
        near[names[a]].append(names[b])
        near[names[b]].append(names[a])
    flat, first = np.array([w for ws in near for w in ws], np.int32), np.concatenate([[0], np.cumsum([len(ws) for ws in near])])
    got = sum(graph.path_shares(flat, first, np.arange(at, min(at + wide, len(near)))) for at in range(0, len(near), wide))
    assert np.allclose(got, plain(near, range(len(near))), rtol=1e-12, atol=1e-9)
