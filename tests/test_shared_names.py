"""Names that two sides share, in cells of blocks, against the plain double loop."""

import random
from collections import defaultdict

import pytest

from loomstone.operators import graph, retrieval


@pytest.mark.parametrize("block, rows, far", [(4, 50, 2**60), (512, 1 << 20, 0), (7, 11, -5)])
def test_cells_sum_what_pairs_share(spark, block, rows, far):
    draw = random.Random(block)
    left = [(draw.choice([0, 0, *range(40)]), far + draw.randrange(30)) for _ in range(400)]
    right = [(draw.choice([0, 0, *range(40)]), str(draw.randrange(25)), draw.random()) for _ in range(300)]
    want = defaultdict(float)
    for n, a in left:
        for m, b, v in right:
            if n == m:
                want[a, b] += v
    x = spark.createDataFrame([*left, (None, 3), (2, None)], "name long, a long")
    y = spark.createDataFrame([*right, (None, "z", 1.0)], "name long, b string, v double")
    got = {(r.a, r.b): r.s for r in graph.shared_names(x, y, block, rows=rows).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert graph.shared_names(x.limit(0), y).count() == 0


def test_pairs_of_pages_are_not_shuffled_under_names(spark):
    """No join under entities has both pages: pairs appear where cells meet."""
    m = spark.createDataFrame([(p, e, 1) for p in range(30) for e in range(3)], "page long, entity long, n long")
    plan = retrieval.related_pages(m, spark.createDataFrame([], "src long, dst long"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan
