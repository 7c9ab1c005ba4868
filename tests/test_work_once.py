"""Texts are cut once, and PageRank weighs only the edges that its mass can reach."""

from loomstone.operators import graph, retrieval


def test_descend_cuts_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    pages = spark.createDataFrame([(i, f"d{i % 5}", "the head", "the body of it " * (i % 4)) for i in range(40)], "page long, dir string, l0 string, l1 string")
    assert retrieval.descend(pages.mapInPandas(run, pages.schema), ["the", "of"]).count()
    assert seen.value == 40


def test_pagerank_weighs_what_its_seeds_reach(spark, monkeypatch):
    pairs = spark.createDataFrame([(10 * k + i, 10 * k + i + 1, 1.0 + i) for k in range(30) for i in range(6)], "a long, b long, w double")
    seeds = spark.createDataFrame([(11, 1.0), (35, 2.0), (-1, 1.0)], "node long, mass double")
    sizes, held = {}, graph.held

    def watched(df, name):
        out = held(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(graph, "held", watched)
    near = {r.node: r.score for r in graph.pagerank(pairs, seeds, tolerance=0.0).collect()}
    assert sizes["step"] == 2 * 12
    whole = {r.node: r.score for r in graph.pagerank(pairs, seeds, tolerance=0.0, near=0).collect()}
    assert sizes["step"] == 2 * 180
    assert near.keys() == whole.keys() and all(abs(near[k] - whole[k]) < 1e-12 for k in whole) and abs(sum(near.values()) - 1) < 1e-9
