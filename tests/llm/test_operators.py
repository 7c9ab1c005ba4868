"""Each operator against a brute-force version, SQL, an exact round trip or held-out accuracy, and its edge cases."""

import hashlib
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from loomstone.llm import chat, decontaminate, extract, fingerprint, language, licenses, line_dedup, mixing, near_dedup, toxicity
from loomstone.llm.common import table
from loomstone.llm.graph import components
from loomstone.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(texts, threshold=0.8):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            union = sum((sets[i] | sets[j]).values())
            if union and sum((sets[i] & sets[j]).values()) >= threshold * union:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall())


def test_toxicity(spark):
    bad, rng = ["zubbernut", "gralk"], random.Random(1)
    texts, labels = [], []
    for i in range(300):
        words = prose(rng, 60).replace("w", "ko").split()
        if i % 4 == 0:
            words[5] = words[30] = rng.choice(bad)
        texts.append(" ".join(words)), labels.append((i, int(i % 4 == 0)))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    lex = toxicity.fit_lexicon(docs(spark, texts), lab)
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs(spark, texts), lex).collect()}
    assert got == dict(labels)
    assert lex.score("a Zуbb3rnut and gr@lk here") >= 0.7 > 0.3 > lex.score("") == lex.score(None)
    assert toxicity.ToxicLexicon({"trash": 3.0}).mass("the trash can")[0] == 0 < toxicity.ToxicLexicon({"trash": 3.0}).mass("you trash")[0]
    assert toxicity.score_toxicity(docs(spark, []), lex).collect() == []
    assert toxicity.fit_lexicon(docs(spark, texts), lab.limit(0)).score("gralk") == 0.05
    odd = spark.createDataFrame([(None, "gralk"), (1, "gralk"), (1, "gralk")], "doc_id long, text string").selectExpr("*", "0.5 AS score", "'x' AS predicted")
    assert len({r.score for r in toxicity.score_toxicity(odd, lex).collect()}) == 1
    start = time.perf_counter()
    trash = toxicity.ToxicLexicon({"trash": 3.0})
    assert trash.mass("trash can and you trash " * 50_000) == (150_000.0, 250_000) and time.perf_counter() - start < 20


def naive_mass(text, weights, exceptions):
    folded = toxicity.fold(text)
    hits = [(m.start(), m.start() + len(w), v) for w, v in weights.items() for m in re.finditer(rf"(?=(?<![^\W\d_]){w})", folded)]
    spared = [(m.start(), m.start() + len(x)) for x in exceptions for m in re.finditer(rf"(?=(?<![^\W\d_]){x}(?![^\W\d_]))", folded)]
    return sum(v for a, b, v in hits if not any(s <= a and b <= e for s, e in spared))


def test_toxicity_matches_naive_search():
    rng = random.Random(9)
    lex = toxicity.ToxicLexicon({"trash": 3.0, "scum": 2.0, "can": 1.0}, ("trash can", "pond scum", "trash can lid"))
    for _ in range(300):
        text = " ".join(rng.choice(["trash", "can", "lid", "pond", "scum", "Tr4sh", "trashy", "ѕcum", "xscum", "!"]) for _ in range(rng.randrange(12)))
        assert abs(lex.mass(text)[0] - naive_mass(text, lex.weights, lex.exceptions)) < 1e-9


def test_language_held_out(spark):
    rows = QUERIES["op2_language_id"](spark, SF).join(table(spark, SF, "documents"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows)
    model = language.LanguageModel.fit([("en", "the", 9), ("en", "thing", 3), ("de", "der", 9), ("de", "ding", 3)])
    assert model.predict("the things")[0] == "en" and model.predict("derer")[0] == "de"
    assert [model.predict(t) for t in (None, "", "12 34!", "½ ² Ⅷ ①", "٣٤")] == [("und", 0.0)] * 5
    assert language.words_of("aⅧb c½") == ["a", "b", "c"] and model.predict("the " * 300_000)[0] == "en"
    p = model.predict("the der zz")[1]
    assert 0.25 <= p <= 1
    assert language.LanguageModel.fit([]).predict("word") == ("und", 0.0)
    odd = spark.createDataFrame([(1, "the thing", 5), (2, None, 6), (None, "der", 7)], "doc_id long, text string, score long")
    assert sorted(r.doc_id or 0 for r in language.keep_identified(odd, model, 0.3).collect()) == [0, 1]


def winnow(text, k=4, w=8):
    """Entries of a text by the plain definition: (hash, place) of the rightmost least of each window of grams of tokens."""
    rotate = lambda x, by: (x << by | x >> (64 - by)) & (1 << 64) - 1
    alone = [(0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2600, 0x27BF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0x10000, 0x10FFFF)]
    tokens, run = [], ""
    for x in text:
        if any(a <= ord(x) <= b for a, b in alone):
            tokens += [run, x] if run else [x]
            run = ""
        elif ord(x) <= 0xBF and not (x.isascii() and x.isalpha()) or 0x2000 <= ord(x) <= 0x206F or x in "GJKQVXZgjkqvxz":
            tokens.append(run + x)
            run = ""
        else:
            run += x
    tokens += [run] if run else []
    h = [xxhash.xxh64_intdigest(c.encode(), seed=42) for c in tokens]
    grams = []
    for i in range(len(h) - k + 1):
        g = 0
        for j in range(k):
            g ^= rotate(h[i + j], k - 1 - j)
        grams.append(g)
    if len(h) < k:
        grams = [xxhash.xxh64_intdigest(text.encode(), seed=42)]
    grams = [g >> 32 & (1 << 31) - 1 for g in grams]
    picked = [min((grams[j], -j) for j in range(i, min(len(grams), i + w))) for i in range(max(1, len(grams) - w + 1))]
    return list(dict.fromkeys((g, -j) for g, j in picked))


def entries(fingerprint_text):
    return [(int(fingerprint_text[i : i + 8], 16), fingerprint.PLACES - int(fingerprint_text[i + 8 : i + 16], 16)) for i in range(0, len(fingerprint_text), 16)]


def jaccard(a, b):
    one = lambda x, y: len(x & y) / len(x | y)
    return max(one(set(a), set(b)), one({h for h, _ in a}, {h for h, _ in b}))


def test_fingerprint_equals_plain_winnowing(spark, tmp_path):
    rng = random.Random(3)
    chinese = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(1200))
    texts = [prose(rng, n) for n in (1, 3, 40, 200)] + [None, "", "é" * 300, "ab" * 90, chinese, "x" + chinese, "😀ü " * 30]
    texts.append(texts[3])
    rows = [(10 + i, t) for i, t in enumerate(texts)] + [(None, "a null id"), (None, "another")] + [(40, prose(rng, 5)) for _ in range(9)] + [(40, "same")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_chars", "2 AS ord")
    for per_bucket in (1_000, 4):
        got = fingerprint.fingerprints_of_edits(df, per_bucket).withColumn("f", fingerprint.fingerprint_string(fingerprint.F.col("fp"))).withColumn("g", fingerprint.fingerprint_string(fingerprint.F.col("efp"))).collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t or "") for i, t in rows)
        followers = {}
        for r in got:
            q = len(r.text) // 4
            assert r.edited == r.text[: len(r.text) - q] + r.next[:q]
            assert entries(r.f) == winnow(r.text) and entries(r.g) == winnow(r.edited)
            assert abs(r.near_edited - jaccard(winnow(r.text), winnow(r.edited))) < 1e-12 and abs(r.near_next - jaccard(winnow(r.text), winnow(r.next))) < 1e-12
            followers.setdefault(r.doc_id, []).append((r.text, r.next))
        whole = {i: t or "" for i, t in rows}
        for i in range(10, 21):
            assert followers[i] == [(whole[i], whole[i + 1])]
        # rows of one id follow each other and the last leads to the next id; the last row of all leads to the first
        for i, after in ((None, {texts[0]}), (40, {"a null id", "another"})):
            mine, nexts = [t for t, _ in followers[i]], [n for _, n in followers[i]]
            (out,) = (Counter(nexts) - Counter(mine)).elements()
            assert out in after
    by = {r.doc_id: r for r in got if r.doc_id}
    assert by[13].f == by[21].f != by[12].f and by[14].f == by[15].f and by[14].near_next == 1
    assert by[18].near_next > 0.95  # one character before a text without spaces moves nothing


def test_fingerprint_query(spark, tmp_path):
    docs(spark, ["a b", None, "c" * 600]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = fingerprint.op4_fingerprint(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_chars for r in rows} == {0: 3, 1: 0, 2: 600} and {r.edited_sha256 for r in rows if r.doc_id == 1} == {hashlib.sha256(b"").hexdigest()}
    docs(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert fingerprint.op4_fingerprint(spark, f"{tmp_path}/none").collect() == []


def brute_edits(pattern, text):
    d = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        prev, d[0] = d[0], i
        for j, t in enumerate(text, 1):
            prev, d[j] = d[j], min(prev + (p != t), d[j] + 1, d[j - 1] + 1)
    return min(d)


def test_decontaminate(spark):
    rng = random.Random(5)
    items = [prose(rng, n) for n in (25, 40, 60)] + ["tiny", ""]
    texts = []
    for k in range(40):
        x = list(rng.choice(items[:3]))
        for _ in range(k % 12):
            i = rng.randrange(len(x))
            x[i : i + 1] = rng.choice((["q"], [], ["z", "z"]))
        texts.append(prose(rng, 30) + "\n" + "".join(x).upper() + " " + prose(rng, 30))
    texts += [prose(rng, 80) for _ in range(10)] + [None, "", "so tiny a word", "destiny"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(docs(spark, texts), bench).collect()}
    want = set()
    for i, t in enumerate(texts):
        for j, item in enumerate(items[:3]):
            p = decontaminate.normalise(item)
            e = min(int(0.1 * len(p)), (len(p) - 8) // 8)
            if brute_edits(p, decontaminate.normalise(t)) <= e:
                want.add((i, j))
    assert got == want | {(52, 3)}
    blocks = decontaminate.contaminations(docs(spark, texts), bench, block_chars=100)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == got
    clean = decontaminate.drop_contaminated(docs(spark, texts), bench)
    assert clean.columns == docs(spark, []).columns and {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {i for i, _ in got}
    twice = spark.createDataFrame([(None, texts[0]), (7, texts[0]), (7, texts[0])], "doc_id long, text string").selectExpr("*", "1 AS item_id", "'x' AS start")
    assert sorted(str(r.doc_id) for r in decontaminate.contaminations(twice, bench).collect()) == ["7", "7", "None"] and decontaminate.drop_contaminated(twice, bench).columns == twice.columns
    assert decontaminate.contaminations(docs(spark, []), bench).collect() == [] == decontaminate.contaminations(docs(spark, texts), bench.limit(0)).collect()


def test_decontaminate_many_items_and_repetitive_texts():
    rng = random.Random(6)
    items = [(i, " ".join(f"{rng.randrange(1 << 40):x}" for _ in range(4))) for i in range(17_000)]
    block = decontaminate.Block(items, 8, 0.1)
    bits = block.table()
    planted = [rng.randrange(17_000) for _ in range(120)]
    texts = [" ".join(f"w{rng.randrange(99)} {items[i][1]}" for i in planted[:60]), " ".join(f"{items[i][1]} q" for i in planted[60:])]
    got = {(d, i) for d, i, *_ in decontaminate._match(block, bits, [0, 1], texts)}
    assert {(0, i) for i in planted[:60]} | {(1, i) for i in planted[60:]} <= got
    # sums by chunk are those of one piece
    codes = decontaminate._codes(texts[0] + "\0" + texts[1] + "\0")
    hit = np.searchsorted(block.values, decontaminate.gram_hashes(codes, 8))
    good = (hit < len(block.values)) & (block.values[np.minimum(hit, len(block.values) - 1)] == decontaminate.gram_hashes(codes, 8))
    where, hit = np.flatnonzero(good), hit[good]
    doc = (where > len(texts[0])).astype(np.int64)
    assert sorted(map(tuple, block.bands(doc, where, hit).tolist())) == sorted(map(tuple, block.bands(doc, where, hit, chunk=50).tolist()))
    again = decontaminate.Block([(1, "ab " * 60)], 8, 0.1)
    start = time.perf_counter()
    found = decontaminate._match(again, again.table(), [3], ["ab " * 100_000 + "x"])
    assert [(d, i, e) for d, i, _, _, e in found] == [(3, 1, 0)] and time.perf_counter() - start < 60


def test_line_dedup(spark):
    texts = ["a\nB \n\nc"] * 6 + [" b\n\n\nd", None, "", "a\na\nx"] * 5
    df = docs(spark, texts).selectExpr("*", "1 AS n_lines", "2 AS gone")
    seen = Counter(k for t in texts for k in {x.strip(" \t\n\x0b\x0c\r").lower() for x in (t or "").split("\n")})
    for batches, fanout in ((1, 4), (5, 2), (4, 4)):
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_repeated_lines(df, 10, 1, batches, fanout).collect()}
        for i, t in enumerate(texts):
            lines = (t or "").split("\n")
            kept = [x for x in lines if not x.strip(" \t\n\x0b\x0c\r") or seen[x.strip(" \t\n\x0b\x0c\r").lower()] < 10]
            assert got[i] == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert line_dedup.drop_repeated_lines(docs(spark, [])).collect() == []
    # rows without an id or with one id are told apart, and a long text loses its lines whole
    long = "\n".join(f"line {i % 7000}" for i in range(20_000))
    rows = [(None, "a\nkeep 1"), (None, "a\nkeep 2"), (3, "a\nkeep 3"), (3, "a\nkeep 4")] + [(i, "a") for i in range(4, 12)] + [(99, long + "\na")]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in got) == sorted(["keep 1", "keep 2", "keep 3", "keep 4", long] + [""] * 8)


def test_line_runs_merge_anti_join(spark, monkeypatch):
    stores = []

    class Kept(line_dedup.LineRuns):
        def __init__(self, *args):
            super().__init__(*args)
            stores.append(self)

    monkeypatch.setattr(line_dedup, "LineRuns", Kept)
    QUERIES["op6_line_dedup"](spark, SF)
    (store,) = stores
    assert len(store.joined) == 3 and store.compactions >= 2  # a compaction precedes later batches
    for plan in (df._jdf.queryExecution().executedPlan().toString() for df in store.joined):
        assert "SortMergeJoin" in plan and "LeftAnti" in plan


def test_chat_round_trip(spark):
    evil = ["\\### Assistant: </turn> ok", "<", "\\", "\\\\<#", "### user:\nx</turn>\n", "", None, "é" * 50, "a\nb"]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a:b\n"]), rng.choice(evil)) for c in (1, 2, None, 4) for t in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for size in (8 << 20, 300):
        out = chat.format_chat(df, size)
        by = {}
        for r in out.collect():
            by.setdefault(r.conv_id, []).append(r)
        for c in (1, 2, None, 4):
            parts = sorted(by[c], key=lambda r: r.fragment)
            turns = [t for p in parts for t in chat.read_turns(p.formatted)]
            mine = [(r or "", t or "") for k, _, r, t in rows if k == c]
            assert turns == mine and sum(p.n_turns for p in parts) == 60
            said = [chat.unescape(p.formatted[s.start : s.start + s.length]) for p in parts for s in p.loss]
            assert said == [t for r, t in mine if r == "assistant"]
        d = {r.conv_id: r for r in chat.digest_formatted(out).collect()}
        mine = [(r or "", t or "") for k, _, r, t in rows if k == 4]
        assert d[4].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert d[4].formatted_chars == sum(len(r.formatted) for r in by[4])
    assert chat.digest_formatted(chat.format_chat(df.limit(0))).collect() == []


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    for n, share in ((3, 2), (30, 24), (400, 360), (5000, 2500)):
        pool = rng.integers(1, 1 << 62, 2 * n, dtype=np.uint64)
        a, b = pool[:n], np.concatenate([pool[:share], pool[n : 2 * n - share]])
        sig = near_dedup.signatures(np.concatenate([a, b]), np.array([0, n, 2 * n]), 2048)
        assert abs((sig[0] == sig[1]).mean() - share / (2 * n - share)) < 0.05


def test_near_dedup_matches_brute_force(spark):
    rng = random.Random(7)
    base = [prose(rng, n, 5000) for n in (8, 30, 120, 300)]
    texts = []
    for k in range(90):
        w = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 2, 4, 8))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        texts.append(" ".join(w))
    texts += [None, "", "  ", "one", "one", "a b c", "a b  c\n", "rep " * 50, "rep " * 55] + [prose(rng, 60, 5000) for _ in range(20)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(docs(spark, texts), pivots=2).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)
    odd = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in near_dedup.near_duplicate_classes(odd).collect() if r.doc_id) == [(5, 5), (5, 5)]
    assert near_dedup.near_duplicate_classes(docs(spark, [])).collect() == []


def test_near_dedup_crowded_buckets_match_brute_force(spark, monkeypatch):
    rng, crowds, plain = random.Random(11), [], near_dedup.prefix_lists
    monkeypatch.setattr(near_dedup, "prefix_lists", lambda held, *rest: crowds.append(held.count()) or plain(held, *rest))
    passage = prose(rng, 80, 5000)
    texts = [f"{passage} {prose(rng, n, 5000)}" for n in (20, 25, 30, 35) * 8]
    texts += [t.replace(t.split()[-9], "other") for t in texts[::5]]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(docs(spark, texts), pivots=2).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts) and crowds[0] > 20


def test_components(spark):
    rng, n = random.Random(4), 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    label = {i: i for e in edges for i in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: label[i] for e in edges if e[0] != e[1] for i in e}


def targets(sizes, weights=(3, 1, 2)):
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        left, open_ = left - sum(2 * sizes[s] for s in over), open_ - over


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(0, 40)), rng.choice(["a", "b", "b", "b", "b", "é", None, "", "z"])) for i in range(700)] + [(None, None, "b"), (3, "x y", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = mixing.mix_sources(df, fan=16).collect()
    assert sorted(map(str, a)) == sorted(map(str, mixing.mix_sources(df.repartition(7), fan=16).collect()))
    assert len(a) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, took = targets(sizes), Counter()
    for r in a:
        took[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
    assert all(abs(took[s] - want[s]) <= 20 for s in sizes)
    assert mixing.mix_sources(df.limit(0)).collect() == []
    alike = spark.createDataFrame([(None, "w " * 4, "a")] * 900 + [(i, "w " * 6, "b") for i in range(300)], "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS turn", "3 AS target")
    by = Counter()
    for r in mixing.mix_sources(alike, fan=16).collect():
        by[r.source] += r.taken
    want = targets({"a": 3600, "b": 1800})
    assert all(abs(by[s] - want[s]) <= 6 for s in "ab")
    one = spark.createDataFrame([("a", 1, 2, 10)], "source string, doc_id long, size long, many long")
    assert sorted(r.turn for r in mixing.numbered(one, 4).collect()) == list(range(10))


def test_mixing_keeps_expectation(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), f"{i % 2}") for i in range(4000)], "doc_id long, text string, source string")
    by = {}
    for r in mixing.mix_sources(df).collect():
        by.setdefault((r.source, r.size, r.target / r.source_size), []).append(r.taken / r.size)
    assert all(abs(np.mean(x) - rate) < 0.12 for (_, _, rate), x in by.items())


def test_extract(spark):
    field = extract.train_on_made_pages()
    pages = extract.labelled_pages(150, seed=77)
    assert sum(extract.main_text(p, field) == "\n\n".join(m) for p, m in pages) >= 120
    page = '<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>A &amp; b title here</h1><p>Some  long\n paragraph of text, with a few <b>bold</b> words.<br>And more of it.<p>Another paragraph &eacute; that is not closed, and goes on.</article><div class="comments"><p>First comment!</p></div><footer>&copy; x</footer><script>var x = "<p>no</p>";</script>'
    assert extract.main_text(page, field) == "A & b title here\n\nSome long paragraph of text, with a few bold words. And more of it.\n\nAnother paragraph é that is not closed, and goes on."
    assert extract.main_text(None, field) == extract.main_text("", field) == ""
    hidden = "<p>The first words stand here.</p><datalist><option value=a></datalist><p>The rest of the page follows, in a long and whole sentence.</p>"
    assert "The rest of the page" in extract.main_text(hidden, field)
    for hostile in ("<a " * 300_000, "<div>" * 200_000 + "x", "<div>x" * 150_000, "<a '>' " * 150_000, "<p class='a b'>" * 60_000, "<option>" * 100_000, "<!--" * 250_000, "<script>" * 100_000, "&amp;" * 200_000):
        start = time.perf_counter()
        assert isinstance(extract.main_text(hostile, field), str) and time.perf_counter() - start < 20
    for odd in ("<", "<p", "<!--", "</div></div>x", "<a b='", "<script>", "plain", "<p>" * 500):
        assert isinstance(extract.main_text(odd, field), str)
    df = spark.createDataFrame([(1, None, page), (1, None, page), (None, "u", None)], "page_id long, url string, html string")
    got = extract.extract_main_text(df, field).collect()
    assert sorted(r.n_chars for r in got) == sorted(len(r.text) for r in got) and got[0].text == got[1].text
    assert extract.extract_main_text(df.limit(0), field).collect() == []


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, step, start = rng.integers(1, 7), rng.normal(size=(2, 2)), rng.normal()
        w = {f"f{i}": float(rng.normal()) for i in range(n)}
        field = extract.Field(w, step, start)

        def value(y, n=n, w=w, step=step, start=start):
            return start * y[0] + sum(w[f"f{i}"] * y[i] for i in range(n)) + sum(step[y[i], y[i + 1]] for i in range(n - 1))

        best = max(([(k >> i) & 1 for i in range(n)] for k in range(1 << n)), key=value)
        assert field.decode([[f"f{i}"] for i in range(n)]) == best


def test_license_scan(spark):
    mit = next(b for i, b in licenses.KNOWN if b.startswith("MIT License"))
    noisy = "Copyright (c) 2020 Some One\n" + mit.upper().replace("LICENSE", "LICENCE").replace(",", " ;; ") + "\nCopyright 2021 Other"
    texts = [noisy, "prose\nReleased under the MIT Licence\nRELEASED under the mit license!", "licensed under nothing", None, "", mit + " more"]
    got = {(r.doc_id, r.license_id, r.unit, r.n) for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert got == {(0, "MIT", "text", 1), (1, "MIT", "line", 2)}
    assert licenses.scan_licenses(docs(spark, [])).collect() == []
    gpl, bsd = (licenses.TEXTS / "GPL-3.0.txt").read_text(), licenses._BSD3
    rewrapped = " ".join(licenses._APACHE_HEADER.format("http").split())
    mit_body = licenses._MIT_GRANT
    texts = [gpl, "BSD 3-Clause License\n\nCopyright Foo Inc.\nAll rights reserved.\n\n" + bsd, "Copyright (c) 1999-2003, The Foo Authors. All rights reserved.\n" + rewrapped, "All rights reserved.\nprose\nALL RIGHTS RESERVED", "All rights reserved.\nReleased under the MIT License.", "Copyright Foo\n" + mit_body, "word " * 200_000]
    got = {(r.doc_id, r.license_id, r.unit, r.n) for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert got == {(0, "GPL-3.0", "text", 1), (1, "BSD-3-Clause", "text", 1), (2, "Apache-2.0", "text", 1), (2, "Apache-2.0", "line", 1), (3, "Proprietary", "line", 2), (4, "MIT", "text", 1), (4, "MIT", "line", 1), (5, "MIT", "text", 1)}
    con = duckdb.connect()
    rows = list(enumerate(texts))
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert set(con.sql(licenses.oracle()).fetchall()) == got


def test_near_dedup_compares_rows_not_ids(spark):
    rng = random.Random(21)
    a, b = prose(rng, 60, 5000), prose(rng, 70, 5000)
    near = lambda t: " ".join([*t.split()[:-1], "other"])
    rows = [(5, a), (5, b), (7, near(b)), (8, near(a)), (5, a), (9, "x " * 40_000), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS t", "'x' AS bands")
    classes = near_dedup.near_duplicate_classes(df)
    got = classes.collect()
    by = {}
    for r in got:
        by.setdefault(r.key, []).append(r.doc_id)
    assert sorted((sorted(v, key=str) for v in by.values()), key=str) == [[5, 5, 8], [5, 7], [9], [None]]
    assert {(r.doc_id, r.class_id) for r in got} == {(5, 5), (7, 5), (8, 5), (9, 9), (None, None)}
    kept = near_dedup.one_of_each_class(df, classes)
    assert kept.columns == df.columns and sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("5", a), ("5", b), ("9", "x " * 40_000), ("None", a)])


def test_extra_columns_and_repeated_ids_change_nothing(spark):
    """op3, op7, op9 and op10 with columns named like their results, null and repeated ids, and a very long text."""
    rows = [(1, "Released under the MIT License.", "a"), (1, "Released under the MIT License.", "a"), (None, "Released under the MIT License.", None), (2, "x " * 300_000, "a"), (3, None, "b"), (4, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS license_id", "2 AS unit", "3 AS n", "4 AS row", "5 AS digest", "6 AS size", "7 AS rate", "8 AS item", "9 AS block")
    assert Counter((r.doc_id, r.license_id, r.unit, r.n) for r in licenses.scan_licenses(df).collect()) == Counter({(1, "MIT", "text", 1): 2, (1, "MIT", "line", 1): 2, (None, "MIT", "text", 1): 1, (None, "MIT", "line", 1): 1})
    mixed = mixing.mix_sources(df).collect()
    assert Counter(r.doc_id for r in mixed) == Counter(r[0] for r in rows) and {r.size for r in mixed if r.doc_id == 2} == {300_000}
    talk = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b" * 500_000)], "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS fragment", "2 AS loss", "3 AS formatted")
    (d,) = chat.digest_formatted(chat.format_chat(talk)).collect()
    assert (d.n_turns, d.loss_chars) == (3, 500_000)
    page = "<article><p>Words of some length stand here, as they do.</p></article>"
    pages = spark.createDataFrame([(1, "u", page), (1, "u", page)], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    assert [r.text for r in extract.extract_main_text(pages, extract.train_on_made_pages()).collect()] == ["Words of some length stand here, as they do."] * 2


def test_hot_ids_of_language_fingerprints_and_lines(spark):
    many = spark.range(100_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('der mann ', id) AS text", "'de' AS lang")
    some = spark.range(2_000).selectExpr("id AS doc_id", "concat('the man ', id) AS text", "'en' AS lang")
    labelled = many.unionByName(some)
    drawn = labelled.filter(language.in_sample(("doc_id", "text"), 6_000, 102_000)).groupBy("lang").count().collect()
    assert 4_000 < sum(r["count"] for r in drawn) < 8_000 and len(drawn) == 2
    model = language.fit_language_model(labelled)
    assert model.predict("der mann")[0] == "de" and model.predict("the man")[0] == "en"
    assert len(language.fit_language_model(labelled, max_words=3).words) <= 3
    copies = [(None, "b c d e f " * 4)] * 60 + [(None, "x y z " * 5)] * 3 + [(4, "p q r s")] + [(None, None)] * 5 + [(7, "same words here")] * 40
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(4)
    pick = lambda per: Counter((r.doc_id, r.text, r.next, r.edited, str(r.fp), str(r.efp), r.near_edited, r.near_next) for r in fingerprint.fingerprints_of_edits(df, per).collect())
    assert pick(8) == pick(1_000) and sum(pick(8).values()) == len(copies)
    keys = spark.range(500).selectExpr("id AS k1", "id * 7 AS k2", "id % 3 AS h1", "0L AS h2")
    repeated = spark.createDataFrame([(0, 0), (2, 0)], "h1 long, h2 long")
    rows = lambda most: sorted(map(tuple, line_dedup._with_any(keys, repeated, most).select("k1", "k2", "h1", "h2").collect()))
    assert rows(10) == rows(0) and len(rows(0)) == 333


def test_disguises_and_two_labels(spark):
    lex = toxicity.ToxicLexicon({"scum": 2.0, "stupid": 3.0, "loser": 1.5, "eté": 9.0})
    mass = lambda t: lex.mass(t)[0]
    assert [mass(t) for t in ("$cum", "stúpid", "ştupid", "1oser", "stup1d", "(@loser)", "you $cum!", "s¢um", "xscum", "a 1 b $5")] == [2, 3, 3, 1.5, 3, 0, 2, 0, 0, 0]
    assert mass("été là où ça stúpid") == 0  # marks are usual here
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    texts = docs(spark, ["x", "bad gralk words here", "plain words here"])
    runs = [toxicity.fit_lexicon(texts, labels.repartition(n)).curve for n in (1, 3)]
    assert runs[0] == runs[1] is not None
