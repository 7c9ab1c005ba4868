"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a groupBy-min and one equi-join, so no neighbourhood is ever gathered in one place; each result is
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: link every larger neighbour of u to the least of u and its neighbours; small: link the smaller ones and u itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b) to (id, label): label is the least id of the component; only ids that have an edge appear."""
    edges = materialise(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}_0")
    state, step = None, 0
    while True:
        found = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).collect()[0]
        if (now := (found.n, found.h)) == state or not found.n:
            break
        state, step, before = now, step + 1, edges
        edges = materialise(_star(_star(edges, large=True), large=False), f"{name}_{step}")
        discard(before)
    labels = edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return labels.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
