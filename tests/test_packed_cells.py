"""Pairs leave their cells only if they are wanted, and blocks travel packed: no row of a name or pair goes through a shuffle of cells."""

import random
from collections import Counter

import pytest

from loomstone.operators import graph, retrieval


@pytest.mark.parametrize("block, rows", [(5, 1000), (6, 9)])
def test_cells_judge_pairs(spark, block, rows):
    draw = random.Random(rows)
    left = sorted({(draw.randrange(40), f"a{draw.randrange(24)}") for _ in range(300)})
    right = sorted({(draw.randrange(40), draw.randrange(24)) for _ in range(300)})
    na, nb = Counter(a for _, a in left), Counter(b for _, b in right)
    shared = Counter((a, b) for n, a in left for m, b in right if n == m)
    out = draw.sample(sorted(shared), 30)
    want = {p: s for p, s in shared.items() if s / (na[p[0]] + nb[p[1]] - s) >= 0.2 and p not in set(out)}
    x, y = spark.createDataFrame(left, "name long, a string"), spark.createDataFrame([(n, b, 1.0) for n, b in right], "name long, b long, v double")
    barred = spark.createDataFrame([*out, *out, ("none", 1)], "a string, b long")
    got = graph.shared_names(x, y, block, rows, lambda s, p, q: s / (p + q - s) >= 0.2, barred).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.s for r in got} == want


def test_pairs_without_ranks_are_not_shuffled(spark):
    m = spark.createDataFrame([(p, e, 1) for p in range(30) for e in range(3)], "page long, entity long, n long")
    got = retrieval.related_pages(m, spark.createDataFrame([(0, 1)], "src long, dst long"), limit=1000).select("page", "other", "score")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "LeftAnti" not in plan and "data#" in plan
    assert got.count() == 30 * 29 - 2


def test_dense_sets_travel_as_bits(spark):
    """Cells get blocks of bits, not the rows of sets, and blocks are not more than 48 as long as they may grow."""
    draw = random.Random(3)
    sets = {i: draw.sample(range(11), draw.randint(1, 6)) for i in range(400)}
    frame = spark.createDataFrame(list(sets.items()), "id long, codes array<int>")
    got = graph.dense_overlaps(frame, 11, lambda s, na, nb: s / (na + nb - s) >= 0.5, 2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "codes" not in plan and "data#" in plan and " 47" in plan
    want = {(a, b, s, len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and (s := len({*sets[a]} & {*sets[b]})) / len({*sets[a]} | {*sets[b]}) >= 0.5}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
