"""Steps of graph operators that only large tables reach."""

from loomstone.operators import graph
from pyspark.sql import functions as F


def test_fingerprint_of_twenty_million_edges(spark):
    edges = spark.range(20_000_000).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    n, first = graph.fingerprint(edges)
    assert n == 20_000_000 and first != graph.fingerprint(edges.filter("a <> 7"))[1]


def test_betweenness_sends_the_driver_no_table_of_links(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    taken, plain = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: taken.append(plain(df)) or taken[-1])
    monkeypatch.setattr(DataFrame, "toPandas", lambda df: 1 / 0)
    n = 300
    pairs = spark.range(n).selectExpr("concat('n', id) AS a", f"concat('n', (id + 1) % {n}) AS b", "1.0D AS w").filter("a <> b").filter("a <> 'n7'")
    got = {r.node: r.betweenness for r in graph.betweenness(pairs).collect()}
    # a path of n nodes from n8 to n7
    want = {f"n{(8 + i) % n}": 2 * i * (n - 1 - i) / ((n - 1) * (n - 2)) for i in range(n)}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)
    assert sum(t.nbytes for t in taken if t.column_names == ["b"]) <= 8 * n
