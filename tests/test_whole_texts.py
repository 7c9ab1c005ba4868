"""Compression distance of whole texts and PageRank of all rounds, against plain Python."""

import random
import zlib

from loomstone.plans import registry


def test_distance_beyond_8000_characters(spark, tmp_path):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    head = word(8000)
    texts = [head + word(3000), head + word(3000), head]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    size = lambda s: len(zlib.compress(s.encode(), 6))
    want = {i: max(0.0, (size(x + texts[0]) - min(size(x), size(texts[0]))) / max(size(x), size(texts[0]))) for i, x in enumerate(texts)}
    assert {r.doc_id: r.ncd for r in registry.QUERIES["c17_compression_distance"](spark, str(tmp_path)).collect()} == want


def test_pagerank_reaches_beyond_two_steps(spark, tmp_path):
    path = [1, 10, 11, 12, 13, 14]
    spark.createDataFrame([(i, p) for i, pair in enumerate(zip(path, path[1:])) for p in pair], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p,) for p in path], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    rank = {p: float(p == 1) for p in path}
    for _ in range(20):
        new = {p: 0.5 * (p == 1) for p in path}
        for i, p in enumerate(path):
            near = path[max(0, i - 1) : i] + path[i + 1 : i + 2]
            for q in near:
                new[q] += 0.5 * rank[p] / len(near)
        rank = new
    got = {r.node: r.score for r in registry.QUERIES["j02_pagerank"](spark, str(tmp_path)).collect()}
    assert got.keys() == rank.keys() and all(abs(got[p] - rank[p]) <= 1e-6 for p in path)
