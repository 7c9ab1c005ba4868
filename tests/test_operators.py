"""Operators without SQL against plain Python versions, golden values and properties."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomstone.functions import checksums, scalars, text
from loomstone.operators import cognitive, curation, detect, graph, quotes, usage
from loomstone.sources import bundle
from loomstone.streaming import events as stream


def one(spark, *columns):
    return spark.range(1).select(*columns).collect()[0]


def test_checksums(spark):
    ids = ["529.982.247-25", "529.982.247-24", "111.111.111-11", "11.222.333/0001-81", "11.222.333/0001-80", "0-306-40615-2", "978-0-306-40615-7", "978-0-306-40615-8", "0378-5955", "0378-5954", "0000-0002-1825-0097", "0000-0002-1825-0098", "GB82WEST12345698765432", "GB82WEST12345698765431"]
    df = spark.createDataFrame([(i,) for i in ids], "s string")
    for kind, f in (("cpf", checksums.valid_cpf), ("cnpj", checksums.valid_cnpj), ("isbn", checksums.valid_isbn), ("issn", checksums.valid_issn), ("orcid", checksums.valid_orcid), ("iban", checksums.valid_iban)):
        got = {r.s for r in df.filter(f(F.col("s"))).collect()}
        want = {"cpf": {ids[0]}, "cnpj": {ids[3]}, "isbn": {ids[5], ids[6]}, "issn": {ids[8]}, "orcid": {ids[10]}, "iban": {ids[12]}}[kind]
        assert got == want
        assert all(detect.checks_out(kind, i) for i in want)
    assert one(spark, checksums.valid_ean13(F.lit("4006381333931"))).asDict().popitem()[1]


def test_scalars(spark):
    assert one(spark, scalars.normalised_entropy(F.array(F.lit(1.0), F.lit(1.0))))[0] == 1
    assert one(spark, scalars.normalised_entropy(F.array(F.lit(3.0))))[0] == 0
    r = one(spark, scalars.surprisal(F.lit(2), F.lit(8)), scalars.review_gain(F.lit(0.5)), scalars.hamming(F.lit(7), F.lit(8)), scalars.same_author(F.lit("M. Tulli Cicero"), F.lit("Marcus Tullius Cicero")), scalars.same_author(F.lit("J Cicero"), F.lit("Marcus Cicero")))
    assert tuple(r) == (2, 1, 4, True, False)
    assert one(spark, scalars.invalid_citations(F.lit("[1] [99] [100] [10](x) [3]"), F.lit(3)))[0] == [99]
    ids = spark.range(0, 1 << 62, 1 << 56).select("id", scalars.parse_id(scalars.render_id(F.col("id"))).alias("b"), F.char_length(scalars.render_id(F.col("id"))).alias("n"))
    assert all(r.id == r.b and r.n == 13 for r in ids.collect())


def packed(body, sep, most=1200):
    out, cur = [], ""
    for p in body.split(sep):
        if cur and len(cur) + len(p) > most:
            out.append(cur)
            cur = p
        else:
            cur = f"{cur}\n\n{p}" if cur else p
    return [c.strip() for c in [*out, cur] if c.strip()]


def test_chunks(spark):
    rng = random.Random(1)
    bodies = ["\n".join("x" * rng.choice((0, 10, 400, 1300)) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    df = spark.createDataFrame([(b,) for b in bodies], "b string").select("b", text.chunks(F.col("b"), "\n").alias("c"))
    assert all(r.c == packed(r.b, "\n") for r in df.collect())


def test_links(spark):
    body = 'See [a](/x.md "rel:refines") and ![i](img.png) [b](../y#part) [[Page|alias]] [[Other]]'
    got = one(spark, text.links(F.lit(body)))[0]
    assert [(x.text, x.target, x.kind, x.title) for x in got] == [("a", "/x.md", "markdown", "rel:refines"), ("i", "img.png", "markdown", None), ("b", "../y#part", "markdown", None), ("alias", "Page", "wikilink", None), ("Other", "Other", "wikilink", None)]
    df = spark.createDataFrame([("../y#part", "a/b.md", "y.md"), ("/x.md", "a/b.md", "x.md"), ("c", "a/b.md", "a/c.md")], "t string, s string, want string")
    assert all(r.r == r.want for r in df.withColumn("r", text.resolve("t", "s")).collect())
    assert one(spark, text.md_link(F.lit("Array[] in\nGo"), F.lit("p.md")))[0] == "[Array() in Go](/p.md)"
    assert one(spark, text.relation(F.lit("rel:refines")), text.is_internal(F.lit("https://x")))[:] == ("refines", False)


def test_sketches(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(300)}" for _ in range(200)] for _ in range(6)]
    rows = []
    for i in range(48):
        w = list(rng.choice(base))
        for _ in range(i % 4):
            w[rng.randrange(200)] = "zz"
        rows.append((i, " ".join(w)))
    rows.append((99, ""))
    df = spark.createDataFrame(rows, "id long, t string").select("id", text.simhash(F.col("t")).alias("h")).cache()
    h = {r.id: r.h for r in df.collect()}
    assert h[99] == 0
    near = {(i, j) for i in h for j in h if i < j and h[i] and h[j] and bin((h[i] ^ h[j]) & (1 << 64) - 1).count("1") <= 8}
    pairs = [(r.a, r.b) for r in graph.close_sketches(df).collect()]
    comp = lambda ps: {frozenset(c) for c in _classes(ps)}
    assert set(pairs) <= near and comp(pairs) == comp(near)


def _classes(pairs):
    label = {}
    for a, b in pairs:
        x, y = label.setdefault(a, {a}), label.setdefault(b, {b})
        if x is not y:
            x |= y
            for k in y:
                label[k] = x
    return label.values()


def test_graph(spark):
    star = spark.createDataFrame([("c", x, 1.0) for x in "abde"], "src string, dst string, weight double")
    b = {r.node: r.betweenness for r in graph.betweenness(graph.undirected(star)).collect()}
    assert b == {"c": 1.0, "a": 0, "b": 0, "d": 0, "e": 0}
    path = graph.undirected(spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, weight double"))
    seeds = spark.createDataFrame([("a", 2.0), ("outside", 1.0)], "node string, mass double")
    rank = {r.node: r.score for r in graph.pagerank(path, seeds, iterations=20).collect()}
    assert math.isclose(sum(rank.values()), 1, abs_tol=1e-9) and rank["a"] > rank["b"] > rank["c"]
    two = [("a", "b", 1.0), ("c", "d", 1.0), ("b", "c", 0.15), ("a", "a", 1.0)]
    bridge = graph.fragile_bridges(spark.createDataFrame(two, "src string, dst string, weight double")).collect()
    assert [(r.src, r.dst, r.small_side, r.large_side) for r in bridge] == [("b", "c", 2, 2)]
    rng = random.Random(6)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame([(a, b) for a, b in edges if a != b], "a long, b long")).collect()}
    assert {frozenset(c) for c in _classes(edges) if len(c) > 1} == {frozenset(k for k in got if got[k] == v) for v in set(got.values())}


def test_theme_events(spark):
    old = spark.createDataFrame([("t1", p) for p in "abcdef"] + [("t2", p) for p in "xyz"] + [("t3", p) for p in "mn"], "theme string, page string")
    new = spark.createDataFrame([(0, p) for p in "abc"] + [(1, p) for p in "def"] + [(2, p) for p in "xyzw"] + [(3, p) for p in "qr"], "community int, page string")
    got = Counter((r.event, r.theme, r.community) for r in graph.theme_events(old, new).collect())
    assert got == Counter([("split", "t1", None), ("born", None, 0), ("born", None, 1), ("grew", "t2", 2), ("died", "t3", None), ("born", None, 3)])


def test_expert_weights_match_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), f"2024-01-{rng.randint(1, 9):02d} 00:00:{rng.randint(0, 59):02d}", rng.choice((-1.0, 1.0, 0.5))) for _ in range(300)]
    df = spark.createDataFrame(rows, "expert string, ts string, loss double").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {}
    for e, _, x in sorted(rows, key=lambda r: (r[1], r[2])):
        want[e] = min(2.0, max(0.5, want.get(e, 1.0) * math.exp(-0.25 * x)))
    for block in (7, 4096):
        got = {r.expert: r.weight for r in usage.expert_weights(df, block).collect()}
        assert all(math.isclose(got[e], want[e], abs_tol=1e-9) for e in want)
    assert one(spark, usage.hedge(F.array(*[F.lit(-9.0)] * 3)))[0] == 2.0


def test_practice(spark):
    i = lambda r, c, p, h=90.0: one(spark, cognitive.next_interval(F.lit(r), F.lit(c), F.lit(p), F.lit(h)))[0]
    assert i("failure", 0.9, 4.0) == 0.5 and i("failure", 0.1, 4.0) == 1.0 and i("partial", 0.5, 5.0) == 6.0 and i("success", 0.5, 20.0) == 30.0
    items = spark.createDataFrame([("a", 1.0, 10.0), ("b", 0.9, 8.0), ("c", 0.2, 3.0), ("d", 0.1, 9.0)], "page string, value double, cost double")
    assert [r.page for r in cognitive.fill_budget(items, 14.0).collect()] == ["b", "c"]
    x = spark.createDataFrame([(1, "a/1"), (2, "a/2"), (3, "b/1"), (4, "a/3")], "n int, page string")
    got = cognitive.interleave(x, F.substring_index("page", "/", 1), "n").orderBy("position").collect()
    assert [r.n for r in got] == [1, 3, 2, 4]
    d = cognitive.depth_progress(spark.createDataFrame([("explain", "explanation")], "exercise string, level string"), {"conceptual": 3, "historical": 1, "practical": 0})
    assert {(r.dimension, r.validated, r.progress) for r in d.collect()} == {("conceptual", 2, 0.67), ("historical", None, None)}


def test_detect():
    kinds = lambda t, **k: [(m[3], m[5], m[6]) for m in detect.analyse(t, **k)]
    assert kinds("25/12/2024") == [("date", "2024-12-25", "extracted")]
    assert kinds("12/03/2024") == [("date", "2024-03-12", "inferred")] and kinds("12/03/2024", locale="en") == [("date", "2024-12-03", "inferred")]
    assert kinds("13/13/2024")[0][2] == "ambiguous" and kinds("10 de março de 2024")[0][1] == "2024-03-10"
    assert detect.number_of("1.234,56") == (1234.56, "extracted") and detect.number_of("1,234", "en") == (1234.0, "inferred")
    assert kinds("250 ms") == [("qty", "250 ms", "extracted")] and kinds("5 g")[0][2] == "inferred"
    assert kinds("see RFC 0793 and ISO 8601:2019") == [("rfc", "RFC 793", "extracted"), ("iso", "ISO 8601:2019", "extracted")]
    assert kinds("`RFC 793`\n> RFC 1\n```\nRFC 2") == []
    gaz = {"k8s": "Kubernetes", "nodejs": "Node.js"}
    assert detect.rewrite("k8s at nodejs. not [x](/k8s.md)", gazetteer=gaz) == "Kubernetes at Node.js. not [x](/k8s.md)"
    assert detect.rewrite(detect.rewrite("k8s", gazetteer=gaz), gazetteer=gaz) == "Kubernetes"
    assert detect.ground_spans("Rust e R: ação", ["R", "acao"]) == [(7, 8), (10, 14)]


def test_bundle(spark, tmp_path):
    meta = {"type": "concept", "title": "A: b", "tags": ["x", "y"], "privacy": "local_only"}
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/p.md").write_text(bundle.render(meta, "Body\n"))
    (tmp_path / "a/q.md").write_text("no head")
    (tmp_path / "index.md").write_text("x")
    rows = {r.path: r for r in bundle.parse(bundle.scan(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a/b/p.md", "a/q.md"} and rows["a/q.md"].error
    p = rows["a/b/p.md"]
    assert (p.meta.title, p.meta.tags, p.body, p.extra) == ("A: b", ["x", "y"], "Body\n", '{"privacy": "local_only"}')
    with pytest.raises(Exception, match="malformed"):
        bundle.concepts(spark, str(tmp_path), strict=True).collect()
    new = spark.createDataFrame([("My Note.md", "1", False), ("my note.md", "Mg==", True), ("x.exe", "", False)], "filename string, content string, base64 boolean")
    got = {(r.name, r.content, r.error) for r in bundle.ingest(spark.createDataFrame([("my-note.md",)], "name string"), new).collect()}
    assert got == {("my-note-2.md", "1", None), ("my-note-3.md", "2", None), ("x.exe", "", "unsupported suffix")}


def test_curation(spark):
    v = spark.createDataFrame([("a", 1, "put", "x"), ("a", 2, "put", "y"), ("b", 1, "put", "z"), ("b", 2, "remove", None)], "page string, version int, op string, body string")
    assert [(r.page, r.body) for r in curation.current(v).collect()] == [("a", "y")]
    assert {(r.page, r.body) for r in curation.at_version(v, 1).collect()} == {("a", "x"), ("b", "z")}
    assert [(r.page, r.body) for r in curation.current(curation.undo(v, "a", 3)).collect()] == [("a", "x")]
    pages = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y"])], "page string, tags array<string>")
    assert [r.tags for r in curation.rename_tag(pages, "x", "y").orderBy("page").collect()] == [["y"], ["y"]]
    m = "struct<title:string,description:string,tags:array<string>,entities:array<string>,confidence:string,valid_at:string>"
    x = spark.createDataFrame([(("T", "", ["a"], None, "extracted", "2024"), ("S", "d", ["b"], ["e"], "inferred", "2023"))], f"t {m}, s {m}")
    got = x.select(curation.merge_meta(F.col("t"), F.col("s")).alias("m")).collect()[0].m
    assert tuple(got) == ("T", "d", ["a", "b"], ["e"], "inferred", "2023")


def test_quotes(spark):
    q = spark.createDataFrame([(1, "To be, or not to be"), (2, "short one")], "item_id long, text string")
    d = spark.createDataFrame([(1, "He said: to be or NOT to be!"), (2, "to be or not")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in quotes.quotations(d, q).collect()] == [(1, 1)]


def test_stream_ladder_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(4), i, rng.choice(list(cognitive.EXERCISE_LEVEL)), rng.choice(("success", "failure", "partial"))) for i in range(200)]
    schema = "item long, at long, exercise string, result string"
    for k in range(4):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = {(r.item, r.level, r.streak, r.attempts) for r in cognitive.accessibility(spark.createDataFrame(rows, schema)).collect()}
    live = stream.ladder(stream.read_events(spark, str(tmp_path / "in")))
    got = {(r.item, r.level, r.streak, r.attempts) for r in stream.run_to_table(live, "update").collect()}
    assert got == batch


def test_checksums_agree_with_each_other(spark):
    rng = random.Random(5)
    kinds = {"cpf": checksums.valid_cpf, "cnpj": checksums.valid_cnpj, "isbn": checksums.valid_isbn, "issn": checksums.valid_issn, "orcid": checksums.valid_orcid, "iban": checksums.valid_iban}
    sizes = {"cpf": (11,), "cnpj": (14,), "isbn": (10, 13), "issn": (8,), "orcid": (16,), "iban": (22,)}
    rows = []
    for kind in kinds:
        for _ in range(400):
            digits = "".join(rng.choice("0123456789") for _ in range(rng.choice(sizes[kind])))
            if kind == "isbn" and len(digits) == 13:
                digits = "978" + digits[3:]
            rows.append((kind, "GB" + digits[2:] if kind == "iban" else digits[:-1] + rng.choice("0123456789X") if kind in ("issn", "orcid") else digits))
    df = spark.createDataFrame(rows, "kind string, s string")
    for kind, f in kinds.items():
        for r in df.filter(F.col("kind") == kind).select("s", f(F.col("s")).alias("ok")).collect():
            assert r.ok == checksums.checks_out(kind, r.s), (kind, r.s)


def test_detect_every_rule():
    text_ = (
        "cpf 529.982.247-25 cnpj 11.222.333/0001-81 doi 10.1000/ABC. arXiv:2101.00001v2 ISBN 0-306-40615-2 ISSN 0378-5955 0000-0002-1825-0097 CVE-2021-44228 "
        "123e4567-e89b-12d3-a456-426614174000 v1.2.3 GB82WEST12345698765432 commit abcdef1 ISO/IEC 27001:2013 NBR ISO 9001:2015 NIST SP 800-53 Rev. 5 IEEE 802.11ac Regulation (EU) 2016/679 under lgpd in Brazil, SP. CEP 01310100 Avenida Paulista, 1578"
    )
    got = {(m[3], m[5]) for m in detect.analyse(text_)}
    assert got >= {
        ("cpf", "529.982.247-25"), ("cnpj", "11.222.333/0001-81"), ("doi", "10.1000/abc"), ("arxiv", "arXiv:2101.00001v2"), ("isbn", "ISBN 0306406152"), ("issn", "ISSN 0378-5955"), ("orcid", "ORCID 0000-0002-1825-0097"), ("cve", "CVE-2021-44228"),
        ("uuid", "123e4567-e89b-12d3-a456-426614174000"), ("semver", "1.2.3"), ("iban", "GB82WEST12345698765432"), ("git_sha", "abcdef1"), ("iso", "ISO/IEC 27001:2013"), ("nbr", "ABNT NBR ISO 9001:2015"), ("nist", "NIST SP 800-53 Rev. 5"), ("ieee", "IEEE 802.11ac"),
        ("eu_reg", "Regulation (EU) 2016/679"), ("regulator", "Lei nº 13.709/2018 (LGPD)"), ("country", "Brasil"), ("uf", "SP"), ("cep", "01310-100"), ("address", "Avenida Paulista, 1578"),
    }
    assert not any(m[3] == "isbn" for m in detect.analyse("isbn 0-306-40615-2"))
    m = next(m for m in detect.analyse("1.234,5 km"))
    assert m[5] == "1234.5 km" and '"value": 1234500.0' in m[7]
    assert [x[8] for x in detect.analyse("529.982.247-24")] == [False]
    assert detect.rewrite("“RFC 0793”: (`“keep”`)") == '"RFC 793": (`“keep”`)'


def test_governance_helpers(spark):
    from loomstone.operators import governance, sessions

    defaults = {"weights": {"a": 0.5}, "gates": {"allow": False}}
    assert governance.validate_policy({"weights": {"a": 1}}, defaults) == {"weights": {"a": 1}, "gates": {"allow": False}}
    for bad in ({"weights": {"b": 1}}, {"weights": {"a": -1}}, {"gates": {"allow": 3}}, {"other": {}}):
        with pytest.raises(ValueError):
            governance.validate_policy(bad, defaults)
    assert governance.validate_pipeline("weekly-run", [{"job": "index"}], {"index"}) == []
    assert governance.validate_pipeline("Bad name", [], {"index"}) == ["name", "stages"]
    assert governance.adopt_legacy_policy({"exclude_stale": True, "x": 1}) == {"allow_stale": False, "x": 1}
    log = governance.run_pipeline([("a", lambda r: 1, "stop"), ("b", lambda r: r["missing"], "continue"), ("c", lambda r: r["a"], "stop"), ("d", lambda r: 1 / 0, "stop"), ("e", lambda r: 1, "stop")])
    assert [(x["stage"], x["ok"]) for x in log] == [("a", True), ("b", False), ("c", True), ("d", False)]
    diff = one(spark, governance.unified_diff(F.lit("a\nb"), F.lit("a\nc"), F.lit("p.md")))[0]
    assert diff.split("\n") == ["--- a/p.md", "+++ b/p.md", "@@ -1,2 +1,2 @@", " a", "-b", "+c"]
    delay = one(spark, sessions.retry_delay(F.lit(3), F.lit("job")))[0]
    assert 20 <= delay < 21 and delay == one(spark, sessions.retry_delay(F.lit(3), F.lit("job")))[0]
    p = spark.createDataFrame([("a", "x", None)], "page string, body string, superseded_by string").withColumn("invalid_at", F.lit(None).cast("string"))
    with pytest.raises(ValueError):
        governance.merge_pages(p, "a", "a", "2024")
    with pytest.raises(ValueError):
        governance.edit_page(p, "a", patch={"page": "b"})
    with pytest.raises(ValueError):
        governance.close_question(p, "a", "b", "2024", p.select("page"))


def test_quotations_of_any_length(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "cat", "catalog", "dog", "he", "the", "then"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    items = [(i, " ".join(rng.choice(["alpha", "beta", "cat", "log", "dog", "he", "the", "en"]) for _ in range(rng.randint(1, 7)))) for i in range(40)] + [(99, "!!")]
    got = {(r.doc_id, r.item_id) for r in quotes.quotations(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, i) for d, t in texts for i, q in items if q != "!!" and q in t}


def test_graph_beyond_bounds(spark):
    rng = random.Random(12)
    edges = list({tuple(sorted((rng.randrange(30), rng.randrange(30)))) for _ in range(55)})
    pairs = graph.undirected(spark.createDataFrame([(a, b, float(rng.randint(1, 4))) for a, b in edges if a != b], "src long, dst long, weight double"))
    near = {r.node: r.betweenness for r in graph.betweenness(pairs).collect()}
    far = {r.node: r.betweenness for r in graph.betweenness(pairs, adjacency_bound=0).collect()}
    assert near.keys() == far.keys() and all(abs(near[k] - far[k]) <= 2e-6 for k in near)
    seeds = spark.createDataFrame([(edges[0][0], 2.0), (edges[1][1], 1.0), (999, 5.0)], "node long, mass double")
    alone = graph.pagerank(pairs, seeds.filter("node = 999")).collect()
    assert [(r.node, r.score) for r in alone] == [(999, 1.0)] and graph.components(pairs.limit(0)).collect() == []
    assert graph.pagerank(pairs, seeds.limit(0)).collect() == []


def test_structural_gaps_without_all_pairs(spark):
    rng = random.Random(13)
    edges = spark.createDataFrame([(rng.randrange(120), rng.randrange(120), 1.0) for _ in range(200)], "src long, dst long, weight double").filter("src <> dst")
    community = spark.range(120).select(F.col("id").alias("node"), (F.col("id") % 40).cast("int").alias("community"))
    between = spark.range(120).select(F.col("id").alias("node"), F.lit(0.0).alias("betweenness"))
    rows = lambda first: [tuple(r) for r in graph.structural_gaps(edges, community, between, first=first).collect()]
    assert rows(2) == rows(64) and len(rows(2)) == 8


def test_plans_of_one_person(spark):
    rng = random.Random(14)
    items = [(f"p{i}", rng.random(), float(rng.choice((0, 1, 3, 7, 20)))) for i in range(300)]
    left, want = 60.0, []
    for p, v, cost in sorted(items, key=lambda x: (-x[1] / max(x[2], 0.1), x[2], x[0])):
        if cost == 0 or cost <= left:
            left -= cost
            want.append(p)
    got = cognitive.fill_budget(spark.createDataFrame(items, "page string, value double, cost double"), 60.0, block=16).collect()
    assert sorted(r.page for r in got) == sorted(want)
    x = spark.createDataFrame([(i, f"b{rng.randrange(6)}") for i in range(80)], "n int, b string")
    rounds, order = {}, []
    for n, b in sorted((r.n, r.b) for r in x.collect()):
        rounds.setdefault(b, []).append(n)
    while any(rounds.values()):
        order += [v.pop(0) for v in rounds.values() if v]
    assert [r.n for r in cognitive.interleave(x, F.col("b"), "n").orderBy("position").collect()] == order


def test_close_sketches_find_every_pair(spark):
    rng = random.Random(15)
    base = [rng.getrandbits(63) for _ in range(12)]
    hs = []
    for i in range(120):
        h = rng.choice(base)
        for _ in range(rng.randrange(12)):
            h ^= 1 << rng.randrange(63)
        hs.append((i, h))
    got = {(r.a, r.b) for r in graph.close_sketches(spark.createDataFrame(hs, "id long, h long")).collect()}
    near = {(i, j) for i, a in hs for j, b in hs if i < j and bin(a ^ b).count("1") <= 8}
    equal = {(i, j) for i, j in near if hs[i][1] == hs[j][1]}
    reps = {h: min(i for i, x in hs if x == h) for _, h in hs}
    assert {p for p in near if reps[hs[p[0]][1]] == p[0] and reps[hs[p[1]][1]] == p[1]} <= got <= near and all((reps[hs[j][1]], j) in got for _, j in equal)


def test_sketch_is_the_plain_one():
    import hashlib

    words_ = "the cat sat on the mat and the cat sat".split()
    votes = [0] * 64
    for i in range(len(words_) - 2):
        h = int.from_bytes(hashlib.blake2b(" ".join(words_[i : i + 3]).encode(), digest_size=8).digest(), "big")
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    want = sum(1 << b for b in range(64) if votes[b] > 0)
    assert text.sketch_of_words(words_) & (1 << 64) - 1 == want and text.sketch_of_words([]) == 0
