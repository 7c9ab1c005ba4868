"""The graph of co-mentions is made once a query: its steps read what was stored."""

from pyspark.sql import functions as F

from loomstone.operators import graph
from loomstone.plans import registry

SF = "/root/testdata/sf0.001"


def _counted(monkeypatch, spark):
    """Rows of the co-mention graph that were made, seen as its links pass."""
    made, links = spark.sparkContext.accumulator(0), registry._links

    def watched(*args):
        df = links(*args)

        def run(batches):
            for batch in batches:
                made.add(len(batch))
                yield batch

        return df.mapInPandas(run, df.schema)

    monkeypatch.setattr(registry, "_links", watched)
    return made, links(spark, SF).count()


def test_distances_and_gaps_make_their_graph_once(spark, monkeypatch):
    made, once = _counted(monkeypatch, spark)
    registry.QUERIES["j08_distances"](spark, SF).collect()
    assert made.value == once
    registry.QUERIES["e14_structural_gaps"](spark, SF).collect()
    assert made.value == 2 * once


def test_co_mentions_bounds_nulls_and_repeats(spark):
    rows = [(p, 1) for p in (3, 1, 2, 1)] + [(p, 2) for p in range(5)] + [(9, 3), (None, 3), (9, None), (8, None), (4, 4)] + [(p % 50, 5) for p in range(5000)]
    m = spark.createDataFrame(rows, "page long, entity long")
    got = sorted((r.src, r.dst) for r in graph.co_mentions(m, high=4).collect())
    assert got == [(1, 2), (1, 3), (2, 3)]
    text = m.select(F.col("page").cast("string").alias("page"), "entity")
    assert sorted((r.src, r.dst) for r in graph.co_mentions(text, high=5).filter("dst = '4'").collect()) == [(str(i), "4") for i in range(4)]
