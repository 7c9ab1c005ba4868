"""Loops over graphs join tables without sending one through the driver."""

import random

from loomstone.operators import graph


def test_no_loop_broadcasts_a_table_that_grows(spark, monkeypatch):
    plans, held = [], graph.held

    def watched(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return held(df, name)

    monkeypatch.setattr(graph, "held", watched)
    rng = random.Random(4)
    edges = {(a, b): float(rng.randint(1, 3)) for a, b in ((rng.randrange(20), rng.randrange(20)) for _ in range(40)) if a < b}
    found = graph.persistence(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double"), leaf=8)
    assert found.count() and {"best0", "label0", "left0", "edges1"} <= {name for name, _ in plans}
    # the order of the forest takes a row a partition
    assert [name for name, plan in plans if "Broadcast" in plan and name != "ranked"] == []


def test_component_sizes_join_without_a_broadcast(spark):
    sizes = graph.component_sizes(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long"), spark.range(1, 9).withColumnRenamed("id", "node"))
    assert "Broadcast" not in sizes._jdf.queryExecution().executedPlan().toString()
    assert {(r.label, r.size) for r in sizes.collect()} == {(1, 3), (4, 1), (5, 1), (6, 1), (7, 2)}


def test_components_of_loops_and_nulls(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (2, 2), (5, 5), (None, 6), (7, None), (None, 2)], "a long, b long")
    assert {(r.node, r.label) for r in graph.components(pairs).collect()} == {(1, 1), (2, 1), (5, 5), (6, 6), (7, 7), (None, None)}
