"""Fill-in-the-middle against a loop over regex matches, and its edge cases."""

import hashlib
import random
import re

import pyarrow as pa

from loomstone.llm import fim

DOCS = "doc_id long, text string, lang string"


def plain_version(doc_id, text, seed=1, fim_percent=90, spm_percent=20):
    text = text or ""
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= fim_percent:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm_percent else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def made(df, **kw):
    out = fim.fill_in_middle(df, **kw)
    back = out.withColumn("restored", fim.restore(out["output"], out["form"]))
    return [(r.doc_id, r.text, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.restored) for r in back.collect()]


def test_equals_the_loop(spark):
    rng = random.Random(4)
    bits = ["a", "Zb", " ", "\n", "é", "漢字", "😀", "<", "<P", ">", "S>", "<M>", "`", "[", "@", "\x00", "don't", "x1y"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(400)]
    texts += ["", None, "a", "é", "<S>", "abc" * 5, "​", "ÿà"]
    rows = [(i if i % 50 else None, t, "en") for i, t in enumerate(texts)]
    rows += rows[:7] + [(3, "another text under a used id", "en")]
    for kw in ({}, {"seed": 7, "fim_percent": 100, "spm_percent": 50}, {"fim_percent": 0}):
        got = made(spark.createDataFrame(rows, DOCS), **kw)
        assert sorted(map(repr, got)) == sorted(repr((i, t, plain_version(i, t, **kw), t or "")) if t is not None else repr((i, t, plain_version(i, t, **kw), "")) for i, t, _ in rows)
    forms = {g[2][1] for g in made(spark.createDataFrame(rows, DOCS))}
    assert forms == {"plain", "psm", "spm"}


def test_batch_of_one_long_text_equals_many():
    rng = random.Random(5)
    long = "".join(rng.choice(["word ", "é", "漢", "\n", "x"]) for _ in range(300_000))
    draws = fim.np.array([[rng.randrange(1 << 32) for _ in range(4)] for _ in range(3)])
    alone = [c[0].as_py() for c in fim.rewrite(pa.array([long]), draws[:1], 100, 20)]
    together = [c[0].as_py() for c in fim.rewrite(pa.array([long, "", "b c"]), draws, 100, 20)]
    assert alone == together and alone[0] == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", long)) and len(alone[4]) == len(long) + 9


def test_columns_and_empty_tables(spark):
    odd = spark.createDataFrame([(1, "one two", "mine", 5), (None, None, "x", None)], "doc_id long, text string, output string, n long").selectExpr("*", "doc_id AS `a b`")
    got = fim.fill_in_middle(odd)
    assert got.columns == ["doc_id", "text", "output", "n", "a b", "form", "prefix_chars", "middle_chars"]
    assert {(r["a b"], r.n, r.output == "mine") for r in got.collect()} == {(1, 3, False), (None, 0, False)}
    assert fim.fill_in_middle(odd.limit(0)).collect() == []
