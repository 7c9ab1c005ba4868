"""Scores that differ in their last bits only by how they were added."""

from loomstone.operators import cognitive, textindex
from pyspark.sql import functions as F


def test_rows_alike_score_alike_whatever_the_order_of_terms(spark, tmp_path):
    words = [f"w{i}" for i in range(7)]
    other = [f"x{i % 3} " + " ".join(words[j] for j in range(7) if i % (j + 2) == 0) for i in range(300)]
    rows = spark.createDataFrame([(i, " ".join(words)) for i in range(600)] + [(1000 + i, x) for i, x in enumerate(other)], "id long, text string")
    index = textindex.TextIndex(spark, f"{tmp_path}/index")
    index.add(rows.repartition(7), "id", "text")
    got = index.search(words, 600).collect()
    assert [r.key for r in got] == list(range(600)) and len({r.score for r in got}) == 1


def test_items_equal_to_nine_decimals_go_by_cost(spark):
    rows = [("1", 0.3, 5.0), ("2", 0.1 + 0.2, 4.0), ("3", 0.3 - 1e-16, 3.0)]
    scored = spark.createDataFrame([(p, "concept", s, c, False) for p, s, c in rows], "page string, type string, score double, cost_min double, pinned boolean")
    got = cognitive.working_set(scored, "0", cognitive.BUDGETS | {"max_items": 1})
    assert [r.page for r in got.collect()] == ["3"]


def test_a_weight_is_divided_once(spark):
    views = spark.createDataFrame([(str(d), d) for d in range(1, 7)], "page string, distance int").select("page", "distance", F.lit(False).alias("pinned"), F.lit(300).alias("words"), F.lit("critique").alias("level"), F.lit(0).alias("degree"), F.lit(False).alias("review_due"), F.lit(0.0).alias("heat"))
    weights = {k: 0.0 for k in cognitive.WEIGHTS} | {"goal_alignment": 0.18}
    got = {r.distance: r.score for r in cognitive.priority(views, "0", weights=weights).collect()}
    assert got == {d: 0.18 / (1 + d) for d in range(1, 7)}
