"""States of derivations against a plain walk, at any depth, with branches and cycles."""

import random

from loomstone.operators import governance, graph


def walk(checkpoints, sources, current):
    up = {}
    for d, s in sources:
        up.setdefault(d, set()).add(s)
    own = {d: "absent" if d not in checkpoints else "stale" if checkpoints[d] != now else "fresh" for d, now in current.items()}
    out = {}
    for d in own:
        seen, todo = set(), list(up.get(d, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        out[d] = "stale_upstream" if own[d] == "fresh" and any(own.get(x) == "stale" for x in seen) else own[d]
    return out


def states(spark, checkpoints, sources, current):
    kind = "derivation string, input_state string"
    got = governance.derivation_states(spark.createDataFrame([*checkpoints.items()], kind), spark.createDataFrame(sources, "derivation string, source string"), spark.createDataFrame([*current.items()], kind))
    return {r.derivation: r.state for r in got.collect()}


def test_graphs_with_branches_and_a_cycle(spark):
    rng = random.Random(2)
    names = [f"d{i}" for i in range(40)]
    sources = [(names[i], names[rng.randrange(i)]) for i in range(1, 40) for _ in range(rng.randrange(3))] + [("d3", "d20"), ("d20", "d3")]
    current = {n: "x" for n in names}
    checkpoints = {n: rng.choice(["x", "x", "x", "x", "x", "old"]) for n in names if rng.random() < 0.85}
    assert states(spark, checkpoints, sources, current) == walk(checkpoints, sources, current)
    assert "stale_upstream" in walk(checkpoints, sources, current).values()


def test_what_is_absent_taints_nothing_itself(spark):
    current = {n: "x" for n in "abc"}
    assert states(spark, {"b": "x", "c": "x"}, [("b", "a"), ("c", "b")], current) == {"a": "absent", "b": "fresh", "c": "fresh"}
    assert states(spark, {"a": "old", "c": "x"}, [("b", "a"), ("c", "b")], current) == {"a": "stale", "b": "absent", "c": "stale_upstream"}
    assert states(spark, {"a": "x"}, [], {"a": "x"}) == {"a": "fresh"}


def test_a_chain_of_ten_thousand(spark, monkeypatch):
    n, rounds = 10_000, []
    held = graph.held
    monkeypatch.setattr(graph, "held", lambda df, name: rounds.append(name) or held(df, name))
    sources = spark.range(1, n).selectExpr("id AS derivation", "id - 1 AS source")
    every = spark.range(n).selectExpr("id AS derivation", "'x' AS input_state")
    checkpoints = every.selectExpr("derivation", "IF(derivation = 0, 'old', 'x') AS input_state")
    got = {r.state: r["count"] for r in governance.derivation_states(checkpoints, sources, every).groupBy("state").count().collect()}
    assert got == {"stale": 1, "stale_upstream": n - 1} and sum(x.startswith("jump") for x in rounds) <= 20


def test_cycles_are_reported(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", "f")]
    got = governance.endless_derivations(spark.createDataFrame(edges, "derivation string, source string"))
    assert sorted(r.derivation for r in got.collect()) == ["a", "b", "c", "d"]
