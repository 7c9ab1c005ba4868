"""The source audit against a brute-force version in Python integers, its sketch, and edge cases."""

import random
import re
from collections import Counter, defaultdict

from loomstone.llm import divergence

DOCS = "doc_id long, text string, lang string, source string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(rows, min_docs, top):
    df, n, all_n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source, t = lang or "", source or "", terms(text)
        groups.add((lang, source))
        df[lang].update(set(t)), n[lang, source].update(t), all_n[lang].update(t)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in df[lang].items() if k >= min_docs]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + (10**9 * (c[t] + 5)) // (total + 5 * len(kept)) for t in kept}

        q, p = shares(all_n[lang]), {g[1]: shares(n[g]) for g in groups if g[0] == lang}
        for s in p:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s]
            over = [(p[s][t] - q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, values in (("pair", pairs), ("term", over)):
                for rank, (value, item) in enumerate(sorted(values, key=lambda v: (-v[0], v[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


def made(rng, n):
    words = ["Alpha", "beta", "gamma-delta", "été", "ÉTÉ", "漢字", "x1y", "𝒳", "Zeta", "\x7f", "a_b", *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]]
    rows = [(i if i % 9 else None, " ".join(rng.choice(words[: rng.randrange(5, len(words))]) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S3", "ß", None])) for i in range(n)]
    return rows + [(1, None, "en", "only here"), (2, "", "fr", "s1"), (2, "123 --", "fr", "s2"), (3, "alpha " * 50_000, "en", "s1"), rows[0], rows[0]]


def test_equals_brute_force(spark):
    rows = made(random.Random(2), 300)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    for min_docs, top, depth, width in ((5, 50, 3, 1 << 21), (12, 3, 2, 1 << 12), (400, 50, 3, 1 << 12), (1, 4, 1, 1 << 12)):
        got = divergence.audit_sources(df, min_docs, top, depth, width).collect()
        assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == brute(rows, min_docs, top)


def test_sketch_never_underestimates_and_drops(spark):
    rows = [(i, " ".join(f"t{'abcdefghij'[j]}{'abcdefghij'[i % 7]}" for j in range(8)) + f" rare{'abcdefghijklmnop'[i % 16]}{'abcdefghijklmnop'[i // 16]}", "en", "s") for i in range(140)]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    true = Counter(t for r in rows for t in set(terms(r[1])))
    may = divergence.sketch(df, 20, 3, 1 << 14)
    listed = list(true)
    passed = may[divergence.cells_of("en", [t.encode() for t in listed], 3, 1 << 14)].all(1)
    assert all(ok for t, ok in zip(listed, passed, strict=True) if true[t] >= 20)
    assert sum(passed) <= sum(c >= 20 for c in true.values()) + 2 < len(true)
    left = {r.term for r in divergence.surviving_counts(df, may, 3, 1 << 14).collect()}
    assert left == {t for t, ok in zip(listed, passed, strict=True) if ok} | {None}
    assert divergence.sketch(df, 300, 2, 1 << 12).sum() == 0


def test_small_buffers_and_edge_tables(spark):
    rows = made(random.Random(3), 80)
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS term", "1 AS n", "2 AS rank", "3 AS value")
    may = divergence.sketch(df, 5, held=3)
    assert (may == divergence.sketch(df, 5)).all()
    pick = lambda c: sorted(map(repr, c.collect()))
    assert pick(divergence.surviving_counts(df, may, held=3)) == pick(divergence.surviving_counts(df, may))
    assert set(map(tuple, divergence.audit_sources(df, 5).collect())) == brute(rows, 5, 50)
    assert divergence.audit_sources(df.limit(0)).collect() == []


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    c, n, v = 9_000_000_000_000, 123_456_789_012_345, 77_777
    got = spark.range(1).select(divergence.share(F.lit(c), F.lit(n), F.lit(v)).alias("p")).collect()[0].p
    assert got == 1 + (10**9 * (c + 5)) // (n + 5 * v)
