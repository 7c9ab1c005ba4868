"""Each stage of the pipeline against its operator, and the whole on a small table with hostile rows."""

import random

import corpus_pipeline as cp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    en = [f"the{rng.choice('abcdef')}{rng.choice('ghij')}" for _ in range(200)]
    body = lambda n: " ".join(rng.choice(en) + str(rng.randrange(50)) for _ in range(n))
    passage = body(40)
    texts = [body(60) for _ in range(40)]
    texts += [texts[0], texts[1] + " more", f"{body(30)} {passage} {body(30)}", None, "", "12 34"]
    texts = [f"Common line\n{t}" if t and i % 2 and i < 43 else t for i, t in enumerate(texts)]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = cp.run(spark, str(tmp_path)).collect()
    left = {r.doc_id for r in rows}
    assert left == set(range(46)) - {40, 41, 42, 43, 44, 45}
    assert [name for name, _ in cp.STAGES][2] == "near_dedup"
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    lines = cp.line_dedup(spark, docs, str(tmp_path)).collect()
    assert not any("Common line" in (r.text or "") for r in lines) and all(r.n_chars == len(r.text) for r in lines)
