"""Language-model scores: counts and base against brute force, exact normalisation, gradients, held-out gain, and edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from loomstone.llm import lm
from loomstone.llm.common import table
from loomstone.llm.language import held_out

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = {"words": 8, "classes": 4, "dim": 6, "noise": 5, "rounds": 2}


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(UPPER)) + [lm.END]


def base(rows, training):
    c = Counter(t for text in training for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return {(i, text): (len(tokens(text)), sum(c[t] > 0 for t in tokens(text)), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(text))) for i, text in rows}


def check(spark, rows, training, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS word", "2 AS score")
    got = lm.score_documents(docs, spark.createDataFrame([(t,) for t in training], "text string"), **{**SMALL, **options}).collect()
    want = base(rows, training)
    assert len(got) == len(rows)
    left = Counter(i for i, _ in rows)
    for r in got:
        left[r.doc_id] -= 1
        assert any(w[:3] == (r.n_tokens, r.n_known, r.train_tokens) and math.isclose(w[3], r.base_score, rel_tol=1e-9, abs_tol=1e-9) for (i, _), w in want.items() if i == r.doc_id), r
        assert math.isfinite(r.score)
    assert not +left
    return {r.doc_id: r for r in got}


def test_counts_and_base_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["The", "the", "été", "ÉTÉ", "x\x0by", "don't", "漢", "a b", *[f"w{i}" for i in range(80)]]
    texts = [" ".join(rng.choice(words[: rng.randrange(3, len(words))]) for _ in range(rng.randrange(50))) for _ in range(120)] + ["", None, " \n\t ", "new words only"]
    rows = [(i if i % 40 else None, t) for i, t in enumerate(texts)] + [(5, texts[5]), (6, "another text under a used id"), (900, "long " * 60_000 + "tail")]
    plain = check(spark, rows, texts[:100])
    by_join = check(spark, rows, texts[:100], frequent=12)  # most words go through the join
    none_held = check(spark, rows, texts[:100], frequent=0)
    assert all(math.isclose(plain[i].score, by_join[i].score, rel_tol=1e-9) for i in plain if i not in (None, 5, 6))
    assert all(none_held[i].n_known == plain[i].n_known for i in plain if i not in (None, 5, 6))


def test_empty_tables(spark):
    rows = [(1, "some words"), (2, None)]
    got = check(spark, rows, [])
    assert got[1].base_score == got[2].base_score == 0 and got[1].n_known == 0 and got[1].train_tokens == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_documents(empty, empty, **SMALL).collect() == []


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    counts = Counter({f"w{i}": 100 - i for i in range(60)})
    classes, words = 5, 20
    per = {}
    for w, n in counts.items():
        k = zlib.crc32(w[-3:].encode()) % classes
        per[k] = tuple(np.add(per.get(k, (0, 0)), (n, 1)))
    v = lm.Vocabulary(list(counts.items()), 7, 7 + sum(counts.values()), 1 + len(counts), per, words, classes)
    model = lm.LogBilinear.fresh(v.outcome_counts, 4)
    model = model.moved(rng.standard_normal(model.rows.shape).astype(np.float32))
    m = v.outcomes
    for last, before in ((m, m), (0, 3), (m - 1, 2)):
        p = 10 ** model.log10(np.full(m, last), np.full(m, before), np.arange(m))
        a, b, q, bias = model.split(model.rows.astype(np.float64))
        s = np.exp(q[:-1] @ (a[last] + b[before]) + bias[:-1])
        assert abs(p.sum() - 1) < 1e-5 and np.allclose(p, s / s.sum(), rtol=1e-4)
    inside = [sum((n + 0.1) * 10 ** -v.class_log[k] for w, n in counts.items() if w.encode() not in v.short and lm.class_of(w.encode(), classes) == k) + 0.1 * 10 ** -v.class_log[k] for k in range(classes)]
    assert np.allclose(inside, 1)


def test_training_climbs_the_nce_objective():
    v = lm.LogBilinear.fresh(np.array([4.0, 10, 20, 5, 9]), 3, seed=2)
    rng = np.random.default_rng(0)
    outcome = rng.integers(0, 5, 4000)
    last, before = np.roll(outcome, 1), np.roll(outcome, 2)
    outcome[1:] = np.where(rng.random(3999) < 0.7, (last[1:] + 1) % 5, outcome[1:])  # what follows depends on the last
    last = np.roll(outcome, 1)
    start = v.log10(last, before, outcome).mean()
    t = lm.Trainer(v, 0.1, 20, 1, batch=100)
    for _ in range(5):
        t.feed(last, before, outcome)
    assert v.moved(t.rows).log10(last, before, outcome).mean() > start + 0.1
    assert t.used[:, 0].sum() == 20_000 and (t.used[:5] > 0).all()


def test_contexts_stop_at_texts():
    last, before = lm.contexts(np.array([4, 0, 0, 5, 6, 0]), np.array([2, 3, 6]), 9)
    assert last.tolist() == [9, 4, 9, 9, 5, 6] and before.tolist() == [9, 9, 9, 9, 9, 5]


def test_held_out_texts_gain(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    out = lm.score_documents(docs, docs.filter(~held_out(0, 10))).join(docs.filter(held_out(0, 10)).select("doc_id"), "doc_id").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.05 * sum(r.n_tokens for r in out)
