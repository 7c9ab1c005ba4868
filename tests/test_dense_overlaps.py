"""Sets over few names meet as matrices: each pair is found once and nothing is listed under a name."""

import random

from loomstone.operators import consolidate, governance, graph


def test_overlaps_are_those_of_a_loop(spark):
    rng = random.Random(9)
    sets = {f"é{i}" if i % 9 == 0 else f"s{i}": set(rng.sample(range(12), rng.randint(1, 6))) for i in range(150)}
    rows = spark.createDataFrame([(i, str(x)) for i, xs in sets.items() for x in [*xs, *xs]], "id string, name string")
    codes, width = graph.dense_codes(rows)
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 2}
    for block in (7, 4096):
        got = [tuple(r) for r in graph.dense_overlaps(codes, width, lambda s, na, nb: s >= 2, block).collect()]
        assert len(got) == len(want) and set(got) == want
    assert graph.dense_codes(rows, 11) is None


def test_few_names_give_no_join_of_pairs(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(40)], "theme long, page long")
    got = governance.same_themes(rows)
    assert got.count() == 13 * 14 // 2 + 2 * (12 * 13 // 2) and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    ids, none = spark.range(40).select("id"), spark.createDataFrame([], "id long, name string")
    named = rows.selectExpr("theme AS id", "CAST(page AS STRING) AS name")
    links = consolidate.converging(ids, ids.selectExpr("id", "0L AS h"), named, none, least=1)
    assert links.count() == got.count()
