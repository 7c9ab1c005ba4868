"""All queries of the library by name, over the driver's tables, with the SQL of those that SQL can express.

Stand-ins: documents are pages, sources their directories; parts bought in one order mention each other; events are usage facts.
Doubles leave through r6 in both engines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..functions.scalars import r6
from ..operators import cognitive, communities, curation, graph, quotes, readmodels, retrieval, textindex, usage, vectors
from ..sources import bundle
from ..streaming import events as stream

QUERIES: dict = {}
ORACLE_SQL: dict = {}
R6 = "floor(({}) * 1e6 + 0.5) / 1e6"
QUESTION = ["pathetic", "moron", "disgusting"]
#: Fold and cut into terms, in DuckDB.
TERMS = f"regexp_extract_all(lower(translate(text, '{text.ACCENTED}', '{text.PLAIN}')), '[\\p{{L}}\\p{{N}}]+')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- retrieval

BM25_SQL = f"""
WITH d AS (SELECT doc_id, {TERMS} AS ts FROM documents),
c AS (SELECT doc_id, len(ts)::DOUBLE AS l, {', '.join(f"len([x FOR x IN ts IF x = '{q}'])::DOUBLE AS f{i}" for i, q in enumerate(sorted(QUESTION)))} FROM d),
s AS (SELECT count(*)::DOUBLE AS n, avg(l) AS a, {', '.join(f'count(*) FILTER (WHERE f{i} > 0)::DOUBLE AS n{i}' for i in range(3))} FROM c),
b AS (SELECT doc_id, {' + '.join(f'(-(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / a)))' for i in range(3))} AS score
  FROM c, s WHERE f0 > 0 OR f1 > 0 OR f2 > 0)
"""


@query(BM25_SQL + f"SELECT doc_id, {R6.format('score')} AS score FROM b")
def k01_bm25(spark, sf):
    return retrieval.bm25(t(spark, sf, "documents"), "doc_id", "text", QUESTION).select("doc_id", r6(F.col("score")).alias("score"))


@query(f"""SELECT doc_id, {R6.format("len(list_intersect(['moron', 'pathetic', 'thing'], ts)) / 3.0")} AS score FROM (SELECT doc_id, {TERMS} AS ts FROM documents)""")
def c26_overlap(spark, sf):
    q = F.array(*[F.lit(w) for w in ("thing", "moron", "pathetic")])
    return t(spark, sf, "documents").select("doc_id", r6(scalars.overlap_score(q, text.terms(F.col("text")))).alias("score"))


def _streams(spark, sf) -> DataFrame:
    docs = t(spark, sf, "documents")
    rank = lambda df, name, i, order: df.orderBy(*order).limit(20).withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1).select(F.lit(name).alias("stream"), F.lit(i).alias("ord"), F.lit(1.0).alias("credit"), F.col("doc_id").alias("chunk_id"), "rank")
    words = retrieval.bm25(docs, "doc_id", "text", QUESTION).select("doc_id", r6(F.col("score")).alias("score"))
    long = docs.filter("n_chars > 100").select("doc_id", "n_chars")
    return rank(words, "fts", 1, ["score", "doc_id"]).unionByName(rank(long, "dense", 2, [F.desc("n_chars"), "doc_id"]))


@query(BM25_SQL + f""", f AS (SELECT doc_id, row_number() OVER (ORDER BY {R6.format('score')}, doc_id) - 1 AS r FROM b QUALIFY r < 20),
g AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents WHERE n_chars > 100 QUALIFY r < 20),
u AS (SELECT doc_id, 'fts' AS s, 1.0 / (61 + r) AS x, 1 AS o, r FROM f UNION ALL SELECT doc_id, 'dense', 1.0 / (61 + r), 2, r FROM g),
m AS (SELECT doc_id, sum(x) AS raw, min((o, r)) AS first, string_agg(s, ',' ORDER BY s) AS streams FROM u GROUP BY doc_id),
w AS (SELECT m.*, source AS page, raw * CASE WHEN m.doc_id % 5 = 0 THEN 1.15 WHEN m.doc_id % 5 = 1 THEN 0.8 ELSE 1.0 END AS score FROM m JOIN documents USING (doc_id))
SELECT doc_id, {R6.format('score')} AS score, streams, row_number() OVER (ORDER BY score DESC, first, doc_id)::INTEGER AS position FROM w QUALIFY position <= 12""")
def k06_fused_evidence(spark, sf):
    docs = t(spark, sf, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("page"), F.lit(None).cast("string").alias("valid_at"), F.lit(None).cast("string").alias("invalid_at"), F.lit(False).alias("superseded"))
    status = docs.select(F.col("doc_id").alias("page"), F.when(F.col("doc_id") % 5 == 0, "preferred").when(F.col("doc_id") % 5 == 1, "low_yield").alias("status"))
    got = retrieval.fuse(_streams(spark, sf), status, chunks, limit=12)
    return got.select(F.col("chunk_id").alias("doc_id"), r6(F.col("score")).alias("score"), "streams", "position")


FLAGSHIP = k06_fused_evidence


def _mentions(spark, sf, page="l_suppkey"):
    return t(spark, sf, "lineitem").groupBy(F.col(page).alias("page"), F.col("l_partkey").alias("entity")).agg(F.count(F.lit(1)).alias("n"))


MENTIONS = "m AS (SELECT l_suppkey AS page, l_partkey AS entity, count(*) AS n FROM lineitem GROUP BY ALL), df AS (SELECT entity, count(DISTINCT page) AS df FROM m GROUP BY entity), c AS (SELECT count(DISTINCT page) AS corpus FROM m)"


@query(f"WITH {MENTIONS} SELECT page, {R6.format('sum(n * -log2(least(1.0, greatest(df, 1) / (greatest(corpus, 1) + 1))))')} AS weight FROM m JOIN df USING (entity), c WHERE entity <= 40 GROUP BY page")
def k03_entity_weights(spark, sf):
    m = _mentions(spark, sf)
    return retrieval.entity_weights(m, m.filter("entity <= 40").select("entity")).select("page", r6(F.col("weight")).alias("weight"))


@query(f"""WITH x AS (SELECT doc_id, doc_id % 9 AS pos, (doc_id % 11) / 10.0 AS j, (doc_id % 7) / 6.0 AS d, doc_id % 50 = 0 AS s, doc_id % 60 = 1 AS k FROM documents),
y AS (SELECT *, 0.4 / (1 + pos) + 0.3 * j + 0.3 * (1 - d) AS score FROM x)
SELECT doc_id, {R6.format('score')} AS score, CASE WHEN s THEN 'UPDATE' WHEN k THEN 'RECYCLE' WHEN score < 0.55 THEN 'ADD' WHEN score >= 0.82 THEN 'UPDATE' ELSE 'ADD_AMBIGUOUS' END AS op FROM y""")
def k12_reconcile(spark, sf):
    x = t(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 9).alias("pos"), (F.col("doc_id") % 11 / 10.0).alias("jaccard"), (F.col("doc_id") % 7 / 6.0).alias("ncd"), (F.col("doc_id") % 50 == 0).alias("shared_id"), (F.col("doc_id") % 60 == 1).alias("cold_id"))
    return retrieval.reconcile(x).select("doc_id", r6(F.col("score")).alias("score"), "op")


@query("""WITH n AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS q FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS b FROM documents)
SELECT DISTINCT doc_id, item_id FROM d, n WHERE contains(b, q)""")
def e19_quotations(spark, sf):
    return quotes.quotations(t(spark, sf, "documents"), t(spark, sf, "benchmark"))


# ---- text

@query(f"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TERMS}) AS word FROM documents) GROUP BY word HAVING count(DISTINCT doc_id) >= 5")
def k14_inverted_index(spark, sf):
    p = retrieval.postings(t(spark, sf, "documents"), "doc_id", "text").filter("term IS NOT NULL")
    return p.groupBy(F.col("term").alias("word")).agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df")).filter("df >= 5")


PHRASES = [["of", "the"], ["moron"], ["pathetic", "fool"], ["en", "the", "of"]]


def _phrase_sql(i: int, phrase: list[str]) -> str:
    test = " AND ".join(f"ts[j + {k}] = '{w}'" for k, w in enumerate(phrase))
    return f"len([j FOR j IN range(1, len(ts) + 1) IF {test}])::DOUBLE AS f{i}"


PHRASE_SQL = f"""
WITH d AS (SELECT doc_id, {TERMS} AS ts FROM documents), c AS (SELECT doc_id, len(ts)::DOUBLE AS l, {', '.join(_phrase_sql(i, p) for i, p in enumerate(PHRASES))} FROM d),
s AS (SELECT count(*)::DOUBLE AS n, avg(l) AS a, {', '.join(f'count(*) FILTER (WHERE f{i} > 0)::DOUBLE AS n{i}' for i in range(len(PHRASES)))} FROM c),
b AS (SELECT doc_id, {' + '.join(f'(-(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / a)))' for i in range(len(PHRASES)))} AS score
  FROM c, s WHERE {' OR '.join(f'f{i} > 0' for i in range(len(PHRASES)))})
SELECT doc_id, {R6.format('score')} AS score, row_number() OVER (ORDER BY score, doc_id)::INTEGER AS rank FROM b QUALIFY rank <= 8"""


@query(PHRASE_SQL)
def k14_phrase_search(spark, sf):
    """The best 8 documents for any of some phrases, by an index of all documents with positions."""
    index = textindex.TextIndex(spark, f"{graph.shared_dir(spark)}/index-{uuid.uuid4().hex}")
    index.add(t(spark, sf, "documents"), "doc_id", "text")
    return index.search_phrases(PHRASES, 8).select(F.col("key").alias("doc_id"), r6(F.col("score")).alias("score"), "rank")


@query(BM25_SQL + f"SELECT doc_id, {R6.format('score')} AS score, row_number() OVER (ORDER BY score, doc_id)::INTEGER AS rank FROM b QUALIFY rank <= 20")
def k14_updated_index(spark, sf):
    """The best 20 documents by an index that first held other texts of a third of the documents, and then was brought up to date."""
    docs = t(spark, sf, "documents")
    before = docs.filter("doc_id % 3 < 2").select("doc_id", F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("moron pathetic "), F.substring("text", 1, 300))).otherwise(F.col("text")).alias("text"))
    index = textindex.TextIndex(spark, f"{graph.shared_dir(spark)}/index-{uuid.uuid4().hex}")
    index.add(before, "doc_id", "text")
    index.add(docs.filter("doc_id % 3 > 0"), "doc_id", "text", before.filter("doc_id % 3 = 1"))
    return index.search(QUESTION, 20).select(F.col("key").alias("doc_id"), r6(F.col("score")).alias("score"), "rank")


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents")
def c27_plain_key(spark, sf):
    return t(spark, sf, "documents").select("doc_id", scalars.plain_key(F.col("text")).alias("key"))


@query()
def c19_simhash(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.simhash(F.col("text")).alias("h"))


@query()
def j11_close_sketches(spark, sf):
    return graph.close_sketches(c19_simhash(spark, sf).withColumnRenamed("doc_id", "id"))


@query()
def c17_compression_distance(spark, sf):
    d = t(spark, sf, "documents")
    first = d.filter("doc_id = 0").select(F.col("text").alias("other"))
    return d.crossJoin(F.broadcast(first)).select("doc_id", text.ncd("text", "other").alias("ncd"))  # one row


@query("SELECT l_partkey AS part, 'thm_' || substr(sha256(string_agg(s, chr(10) ORDER BY s)), 1, 12) AS id FROM (SELECT DISTINCT l_partkey, l_suppkey::VARCHAR AS s FROM lineitem) GROUP BY l_partkey")
def c32_member_id(spark, sf):
    return t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("m")).select("part", scalars.member_id(F.col("m")).alias("id"))


# ---- graph

def _links(spark, sf) -> DataFrame:
    m = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("page"), F.col("l_orderkey").alias("entity"))
    return graph.co_mentions(m)


PAIRS = "m AS (SELECT DISTINCT l_partkey AS page, l_orderkey AS entity FROM lineitem), f AS (SELECT entity FROM m GROUP BY entity HAVING count(*) BETWEEN 2 AND 30), p AS (SELECT a.page AS a, b.page AS b, count(*) * 0.25::DOUBLE AS w FROM m a JOIN m b USING (entity) JOIN f USING (entity) WHERE a.page < b.page GROUP BY ALL), e AS (SELECT a, b, w FROM p UNION ALL SELECT b, a, w FROM p)"


@query(f"WITH {PAIRS} SELECT a, b, w::DOUBLE AS w FROM p")
def e16_co_mentions(spark, sf):
    return graph.undirected(_links(spark, sf))


@query(f"WITH {PAIRS} SELECT a AS node, count(*) AS degree, sum(w)::DOUBLE AS strength FROM e GROUP BY a")
def j09_degrees(spark, sf):
    return graph.degrees(graph.undirected(_links(spark, sf)))


@query(f"WITH {PAIRS}, d AS (SELECT a AS node, count(*) AS degree FROM e GROUP BY a), r AS (SELECT degree, row_number() OVER (ORDER BY degree, node) AS i, count(*) OVER () AS n FROM d), c AS (SELECT greatest(degree, 8) AS cut FROM r WHERE i = floor(0.99 * (n - 1))::BIGINT + 1) SELECT node, degree FROM d, c WHERE degree > cut")
def f19_hubs(spark, sf):
    return graph.hubs(graph.undirected(_links(spark, sf)))


@query()
def j03_betweenness(spark, sf):
    return graph.betweenness(graph.undirected(_links(spark, sf)))


@query()
def j06_bridges(spark, sf):
    return graph.fragile_bridges(graph.undirected(_links(spark, sf)).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("weight")))


@query(f"""WITH {PAIRS}, k AS (SELECT a AS node, sum(w) AS k, count(*) AS degree FROM e GROUP BY a), tot AS (SELECT sum(w) AS total FROM p),
who AS (SELECT p_partkey AS node, (p_partkey % 12)::INTEGER AS c, coalesce(k, 0) AS k, coalesce(degree, 0) AS degree FROM part LEFT JOIN k ON node = p_partkey),
grp AS (SELECT c, sum(k) AS k, count(*) AS size, max(degree) AS top FROM who GROUP BY c), rep AS (SELECT c, min(node) AS rep FROM who JOIN grp USING (c) WHERE who.degree = top GROUP BY c),
i AS (SELECT least(x.c, y.c) AS ca, greatest(x.c, y.c) AS cb, sum(w) AS actual FROM p JOIN who x ON x.node = a JOIN who y ON y.node = b WHERE x.c <> y.c GROUP BY ALL),
g AS (SELECT l.c AS ca, r.c AS cb, l.k * r.k / (2 * total) AS expected, coalesce(actual, 0) AS actual FROM grp l JOIN grp r ON l.c < r.c LEFT JOIN i ON ca = l.c AND cb = r.c, tot)
SELECT ca, cb, x.rep AS rep_a, y.rep AS rep_b, {R6.format('expected - actual')} AS deficit, {R6.format('expected')} AS expected, {R6.format('actual')} AS actual
FROM g JOIN rep x ON x.c = ca JOIN rep y ON y.c = cb WHERE expected > actual ORDER BY expected - actual DESC, ca, cb LIMIT 8""")
def e14_structural_gaps(spark, sf):
    pairs = graph.held(graph.undirected(_links(spark, sf)), "pairs")
    community = t(spark, sf, "part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 12).cast("int").alias("community"))
    top = graph.degrees(pairs).select("node", F.col("degree").cast("double").alias("betweenness"))
    return graph.structural_gaps(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("weight")), community, top)


@query()
def s01_theme_gaps(spark, sf):
    """Gaps between communities by modularity, represented by their most central pages."""
    pairs = graph.held(graph.undirected(_links(spark, sf)), "pairs")
    found = graph.canonical_labels(communities.communities(pairs))
    return graph.structural_gaps(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("weight")), found, graph.betweenness(pairs))


@query(f"""WITH o AS (SELECT DISTINCT l_suppkey AS theme, l_partkey AS page FROM lineitem WHERE l_linenumber <= 5), n AS (SELECT DISTINCT l_suppkey AS community, l_partkey AS page FROM lineitem WHERE l_linenumber >= 2),
a AS (SELECT theme, count(*) AS na FROM o GROUP BY theme), b AS (SELECT community, count(*) AS nb FROM n GROUP BY community), s AS (SELECT theme, community, count(*) AS s FROM o JOIN n USING (page) GROUP BY ALL)
SELECT theme, community, {R6.format('s / (na + nb - s)')} AS jaccard FROM s JOIN a USING (theme) JOIN b USING (community) WHERE s / (na + nb - s) >= 1.0 / 3""")
def e18_match_themes(spark, sf):
    li = t(spark, sf, "lineitem")
    old = li.filter("l_linenumber <= 5").select(F.col("l_suppkey").alias("theme"), F.col("l_partkey").alias("page"))
    new = li.filter("l_linenumber >= 2").select(F.col("l_suppkey").alias("community"), F.col("l_partkey").alias("page"))
    return graph.match_themes(old, new).select("theme", "community", r6(F.col("jaccard")).alias("jaccard"))


# ---- usage

def _outcomes(spark, sf) -> DataFrame:
    e = t(spark, sf, "events")
    verdict = F.when(F.col("event_type").isin("purchase", "signup"), "useful").when(F.col("event_type") == "error", "dead_end")
    return e.select(verdict.alias("verdict"), F.array(F.col("user_id")).alias("pages")).filter("verdict IS NOT NULL")


RATIOS = "r AS (SELECT user_id AS page, count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS useful, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events WHERE event_type IN ('purchase', 'signup', 'error') GROUP BY user_id)"


@query(f"WITH {RATIOS} SELECT * FROM r")
def f01_outcome_ratios(spark, sf):
    return usage.outcome_ratios(_outcomes(spark, sf))


@query(f"WITH {RATIOS} SELECT page, CASE WHEN useful + bad < 3 THEN 'tentative' WHEN useful / (useful + bad) >= 0.75 THEN 'preferred' WHEN bad / (useful + bad) >= 0.5 THEN 'low_yield' ELSE 'tentative' END AS status, useful, bad FROM r")
def f03_overlay(spark, sf):
    return usage.overlay(f01_outcome_ratios(spark, sf))


@query(f"""WITH {RATIOS}, u AS (SELECT user_id AS page, count(*) FILTER (WHERE event_type = 'view') AS reads, count(*) FILTER (WHERE event_type = 'click') AS cites, (epoch(TIMESTAMP '2024-02-01') - floor(epoch(max(ts)))) / 86400.0 AS age FROM events GROUP BY user_id),
s AS (SELECT page, CASE WHEN reads <= 0 THEN 0.0 ELSE 1 / (1 + exp(-least(60.0, greatest(-60.0, ln(reads / 0.5) - 0.5 * ln(greatest(age, 1.0 / 24)))))) END AS recall, least(1.0, cites / 5) AS c, CASE WHEN coalesce(useful, 0) + coalesce(bad, 0) = 0 THEN 0.5 ELSE useful / (useful + bad) END AS o FROM u LEFT JOIN r USING (page))
SELECT page, {R6.format('0.6 * recall + 0.2 * c + 0.2 * o')} AS score FROM s""")
def f02_heat(spark, sf):
    e = t(spark, sf, "events")
    age = (F.unix_timestamp(F.lit("2024-02-01").cast("timestamp")) - F.unix_timestamp(F.max("ts"))) / 86400.0
    u = e.groupBy(F.col("user_id").alias("page")).agg(F.count_if(F.col("event_type") == "view").alias("reads"), F.count_if(F.col("event_type") == "click").alias("cites"), age.alias("age_days"))
    return usage.heat(u, f01_outcome_ratios(spark, sf)).select("page", r6(F.col("score")).alias("score"))


@query("SELECT least(4, floor(value / 20.0))::INTEGER AS bucket, count(*) AS n FROM events GROUP BY 1")
def f05_histogram(spark, sf):
    return usage.histogram(t(spark, sf, "events"), "value", 20.0)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def f07_latest(spark, sf):
    return usage.latest_by(t(spark, sf, "events"), "user_id", "ts", "event_type", tie="event_id")


@query(f"SELECT {R6.format('sum(value)')} AS spent, {R6.format('greatest(0.0, 100000 - sum(value))')} AS remains, greatest(0.0, 100000 - sum(value)) - 5 > 0 AS allowed FROM events WHERE ts::DATE = DATE '2024-01-15'")
def f15_budget(spark, sf):
    b = usage.budget_left(t(spark, sf, "events").withColumnRenamed("value", "usd"), "2024-01-15", 100000.0, 5.0)
    return b.select(r6(F.col("spent")).alias("spent"), r6(F.col("left")).alias("remains"), "allowed")


def _pairs(spark, sf) -> DataFrame:
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    return d.select("source", "n_chars", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("p"), F.col("quality").cast("double").alias("outcome"))


CAL = "c AS (SELECT source, n_chars, least(1.0, n_chars / 5000.0)::DOUBLE AS p, quality::DOUBLE AS o FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {CAL} SELECT count(*) AS n, {R6.format('avg((p - o) * (p - o))')} AS brier, {R6.format('avg(p) - avg(o)')} AS overconfidence FROM c")
def l04_calibration(spark, sf):
    return usage.calibration(_pairs(spark, sf)).select("n", r6(F.col("brier")).alias("brier"), r6(F.col("overconfidence")).alias("overconfidence"))


@query(f"WITH {CAL} SELECT least(4, floor(p * 5))::INTEGER AS bin, count(*) AS n, {R6.format('avg(p)')} AS mean_p, {R6.format('avg(o)')} AS hit_rate FROM c GROUP BY 1")
def l06_calibration_bins(spark, sf):
    return usage.calibration_bins(_pairs(spark, sf)).select("bin", "n", r6(F.col("mean_p")).alias("mean_p"), r6(F.col("hit_rate")).alias("hit_rate"))


@query(f"WITH {CAL}, g AS (SELECT avg(o) AS overall FROM c) SELECT source AS strategy, count(*) AS n, {R6.format('avg(o)')} AS rate, {R6.format('any_value(overall)')} AS overall FROM c, g GROUP BY source HAVING count(*) >= 5 AND avg(o) - any_value(overall) >= 0.05")
def f09_strategy_patterns(spark, sf):
    got = usage.strategy_patterns(_pairs(spark, sf).select(F.col("source").alias("strategy"), F.col("outcome").alias("useful")), gap=0.05)
    return got.select("strategy", "n", r6(F.col("rate")).alias("rate"), r6(F.col("overall")).alias("overall"))


@query(f"""WITH {CAL}, x AS (SELECT n_chars % 5 + 1 >= 4 AS high, 1 - o AS bad FROM c) SELECT count(*) FILTER (WHERE high) AS n_high, count(*) FILTER (WHERE NOT high) AS n_low, {R6.format('avg(bad) FILTER (WHERE high)')} AS bad_high, {R6.format('avg(bad) FILTER (WHERE NOT high)')} AS bad_low FROM x""")
def f10_load_pattern(spark, sf):
    x = _pairs(spark, sf).select((F.col("n_chars") % 5 + 1).alias("load"), (1 - F.col("outcome")).alias("bad"))
    return usage.load_pattern(x, gap=-1.0).select("n_high", "n_low", r6(F.col("bad_high")).alias("bad_high"), r6(F.col("bad_low")).alias("bad_low"))


@query(f"""WITH a AS (SELECT user_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events)
SELECT count(*) AS n, {R6.format("avg((event_type = 'purchase')::INT)")} AS rate FROM a WHERE epoch_us(ts) - epoch_us(b) >= 86400000000""")
def f12_delayed_recall(spark, sf):
    a = t(spark, sf, "events").select(F.col("user_id").alias("item"), F.col("ts").alias("at"), F.when(F.col("event_type") == "purchase", "success").otherwise("failure").alias("result"))
    return usage.delayed_recall(a).select("n", r6(F.col("rate")).alias("rate"))


@query("SELECT user_id AS ask_id, json_extract_string(props, '$.k')::BIGINT AS page, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS streams FROM events GROUP BY ALL")
def s02_trace(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("ask_id"), F.get_json_object("props", "$.k").cast("long").alias("page"), F.col("event_type").alias("stream"))
    none = spark.createDataFrame([], "ask_id long, at long, verdict string")
    return usage.trace(e, none).drop("outcome")


# ---- practice

def _attempts(spark, sf) -> DataFrame:
    e = t(spark, sf, "events")
    exercise = F.element_at(F.array(*[F.lit(x) for x in cognitive.EXERCISE_LEVEL]), (F.col("event_id") % 6 + 1).cast("int"))
    result = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failure").otherwise("partial")
    return e.select(F.col("user_id").alias("item"), F.col("event_id").alias("at"), exercise.alias("exercise"), result.alias("result"), ((F.col("event_id") % 10) / 10.0).alias("confidence"))


@query("""WITH a AS (SELECT user_id AS item, event_id AS eid, event_type, [2, 3, 4, 4, 5, 6][event_id % 6 + 1] AS rung FROM events),
f AS (SELECT item, max(eid) FILTER (WHERE event_type = 'error') AS fell, coalesce(max(rung) FILTER (WHERE event_type = 'purchase'), 0) AS rung, count(*) AS attempts, arg_max(event_type, eid) AS last FROM a GROUP BY item)
SELECT item, ['none', 'recognition', 'recall', 'explanation', 'application', 'transfer', 'critique'][f.rung + 1] AS level, (SELECT count(*) FROM a WHERE a.item = f.item AND event_type = 'purchase' AND (fell IS NULL OR eid > fell)) AS streak, attempts,
CASE last WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' ELSE 'partial' END AS last_result FROM f""")
def m02_accessibility(spark, sf):
    return cognitive.accessibility(_attempts(spark, sf))


def _views(spark, sf) -> DataFrame:
    p, k = t(spark, sf, "part"), F.col("p_partkey")
    flag = lambda n: (k % n == 0)
    level = F.element_at(F.array(*[F.lit(x) for x in cognitive.LEVELS]), (k % 7 + 1).cast("int"))
    return p.select(k.cast("string").alias("page"), flag(11).alias("superseded"), flag(13).alias("invalid"), flag(5).alias("sensitive"), flag(3).alias("stale"), flag(17).alias("low_yield"), (k % 4).alias("distance"), flag(19).alias("pinned"), (k % 9).alias("degree"), (F.col("p_size") * 37).alias("words"), (F.col("p_size") / 50.0).alias("heat"), level.alias("level"), flag(6).alias("review_due"))


@query("""SELECT p_partkey::VARCHAR AS page, concat_ws(',', CASE WHEN p_partkey % 11 = 0 THEN 'superseded' END, CASE WHEN p_partkey % 13 = 0 THEN 'invalid' END, CASE WHEN p_partkey IN (7, 8) THEN 'excluded' END, CASE WHEN p_partkey % 5 = 0 THEN 'privacy' END, CASE WHEN p_partkey % 4 > 2 AND p_partkey % 19 <> 0 AND p_partkey <> 1 THEN 'scope' END) AS refused FROM part""")
def d02_gates(spark, sf):
    return cognitive.gates(_views(spark, sf), "1", ("7", "8")).select("page", F.array_join("refused", ",").alias("refused"))


@query(f"""WITH v AS (SELECT p_partkey AS k, (p_partkey % 19 = 0 OR p_partkey = 1) AS own, p_partkey % 4 AS d, greatest(0.0, (3 - p_partkey % 7) / 3.0) AS gap, least(1.0, (p_partkey % 9) / 6.0) AS unlock, greatest(2.0, floor(p_size * 37 / 150.0 * 10 + 0.5) / 10) AS cost, p_size / 50.0 AS heat FROM part)
SELECT k::VARCHAR AS page, floor(greatest(0.0, 0.22 * CASE WHEN own THEN 1.0 ELSE greatest(0.0, 1.0 - 0.3 * d) * 0.6 END + 0.18 / (1 + d) + 0.22 * gap + 0.12 * unlock + 0.12 * (k % 6 = 0)::INT + 0.04 * least(1.0, heat) + 0.06 * gap * unlock - 0.08 * least(1.0, cost / 30.0)) * 1e3 + 0.5)::BIGINT AS score FROM v""")
def m01_priority(spark, sf):
    return cognitive.priority(_views(spark, sf), "1").select("page", F.floor(F.col("score") * 1e3 + 0.5).alias("score"))


@query("""WITH RECURSIVE v AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS page, (p_partkey % 19 = 0 OR p_partkey = 1) AS own, p_partkey % 4 AS d, greatest(0.0::DOUBLE, (3 - p_partkey % 7) / 3.0::DOUBLE) AS gap, least(1.0::DOUBLE, (p_partkey % 9) / 6.0::DOUBLE) AS unlock, greatest(2.0::DOUBLE, round(p_size * 37 / 150.0::DOUBLE, 1)) AS cost, p_size / 50.0::DOUBLE AS heat FROM part
WHERE NOT (p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR p_partkey % 5 = 0 OR p_partkey % 4 > 2 AND p_partkey % 19 <> 0 AND p_partkey <> 1)),
z AS (SELECT *, greatest(0.0::DOUBLE, 0.22 * CASE WHEN own THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0 - 0.3 * d) * 0.6::DOUBLE END + 0.18::DOUBLE / (1 + d) + 0.22::DOUBLE * gap + 0.12::DOUBLE * unlock + 0.12::DOUBLE * (k % 6 = 0)::INT + 0.04::DOUBLE * least(1.0, heat) + 0.06::DOUBLE * round(gap * unlock, 4) - 0.08::DOUBLE * least(1.0, cost / 30.0)) AS score FROM v),
q AS (SELECT page, 'question' AS kind FROM z WHERE k % 10 = 3 ORDER BY score DESC, cost, page LIMIT 3), o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, cost, page) AS i FROM z WHERE k % 10 <> 3),
r AS (SELECT 0::BIGINT AS i, 0.0::DOUBLE AS spent, 0 AS n, NULL::VARCHAR AS page UNION ALL SELECT o.i, CASE WHEN n < 7 AND (own OR spent + cost <= 90) THEN spent + cost ELSE spent END, CASE WHEN n < 7 AND (own OR spent + cost <= 90) THEN n + 1 ELSE n END, CASE WHEN n < 7 AND (own OR spent + cost <= 90) THEN o.page END FROM r JOIN o ON o.i = r.i + 1)
SELECT page, 'item' AS kind FROM r WHERE page IS NOT NULL UNION ALL FROM q""")
def g07_working_set(spark, sf):
    v = cognitive.gates(_views(spark, sf), "1").filter("eligible")
    scored = cognitive.priority(v, "1").withColumn("type", F.when(F.col("page").cast("int") % 10 == 3, "question").otherwise("concept"))
    return cognitive.working_set(scored, "1")


@query("""WITH x AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn, min(p_partkey) OVER (PARTITION BY p_brand) AS first FROM part)
SELECT p_partkey, row_number() OVER (ORDER BY turn, first)::INTEGER AS position FROM x""")
def g08_interleave(spark, sf):
    return cognitive.interleave(t(spark, sf, "part").select("p_partkey", "p_brand"), F.col("p_brand"), "p_partkey").select("p_partkey", "position")


# ---- validity and curation

@query("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE strftime(o_orderdate, '%Y-%m') <= '1995-06' AND strftime(l_shipdate, '%Y-%m') > '1995-06'""")
def d01_as_of(spark, sf):
    x = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return x.filter(scalars.as_of(iso("o_orderdate"), iso("l_shipdate"), "1995-06")).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 7 = 0 AND doc_id % 11 <> 0 OR doc_id % 11 = 0 AND doc_id % 7 <> 0 OR doc_id % 5 = 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0")
def h01_snapshot_diff(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "text")
    new = d.filter("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return curation.snapshot_diff(d.filter("doc_id % 7 <> 0"), new, "doc_id", "text")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def a11_upsert(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return curation.upsert(c.filter("c_custkey % 2 = 0"), c.filter("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("new")), ["c_custkey"], replace=True)


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 0 OR o_custkey % 3 <> 0")
def d03_only_alive(spark, sf):
    pages = t(spark, sf, "customer").select(F.col("c_custkey").alias("page"), F.when(F.col("c_custkey") % 3 == 0, "x").alias("superseded_by"), F.lit(None).cast("string").alias("invalid_at"))
    items = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("target"))
    return curation.only_alive(items, pages, "target").select("o_orderkey")


@query("SELECT o_custkey::VARCHAR AS identifier, count(DISTINCT o_orderkey) AS pages, min(o_orderkey) AS page FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) >= 2")
def e20_shared_identifiers(spark, sf):
    p = t(spark, sf, "orders").select(F.col("o_orderkey").alias("page"), F.array(F.col("o_custkey").cast("string")).alias("ids"), F.lit(True).alias("human"), F.lit(None).cast("string").alias("superseded_by"), F.lit(None).cast("string").alias("invalid_at"))
    return curation.shared_identifiers(p)


@query("SELECT p_partkey AS page FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7 AND l_suppkey <> l_partkey)")
def f27_orphans(spark, sf):
    e = t(spark, sf, "lineitem").filter("l_linenumber = 7").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("wikilink").alias("kind"))
    return curation.orphans(t(spark, sf, "part").select(F.col("p_partkey").alias("page")), e)


# ---- streams

@query("SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY event_type")
def n01_event_counts(spark, sf):
    e = stream.known_only(stream.read_events(spark, f"{sf}/events.parquet"), ("click", "purchase", "signup", "view"))
    return stream.run_to_table(stream.counts(e), "complete")


@query(f"""WITH q AS (SELECT vec_id AS question, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
x AS (SELECT question, vec_id AS key, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM q, embeddings),
r AS (SELECT question, key, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, key)::INTEGER AS rank FROM x) SELECT question, key, {R6.format('score')} AS score, rank FROM r WHERE rank <= 8""")
def k02_vector_search(spark, sf):
    """The 8 nearest of all vectors for every hundredth one, exactly."""
    e = t(spark, sf, "embeddings")
    index = vectors.VectorIndex.build(e, "vec_id", "embedding")
    ask = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"))
    return index.search(ask, exact=True).select("question", "key", r6(F.col("score")).alias("score"), "rank")


@query()
def k02_vector_index(spark, sf):
    """The same from the cells that the index looks into."""
    e = t(spark, sf, "embeddings")
    index = vectors.VectorIndex.build(e, "vec_id", "embedding")
    return index.search(e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector")))


# ---- queries whose SQL is made of several parts

@query(f"""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, {R6.format('list_cosine_similarity(e.embedding::DOUBLE[], q.v)')} AS score FROM embeddings e, q ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.v) DESC, vec_id LIMIT 8""")
def k02_cosine(spark, sf):
    e = t(spark, sf, "embeddings")
    row = e.filter("vec_id = 0").select("embedding").collect()[0]  # the question's vector
    query_vector = F.array(*[F.lit(float(x)) for x in row.embedding])
    return retrieval.nearest(e, "vec_id", "embedding", query_vector).select("vec_id", r6(F.col("score")).alias("score"))


@query(f"""WITH {MENTIONS}, l AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 50 AS b FROM lineitem WHERE l_linenumber = 7), k AS (SELECT m.*, -log2(least(1.0, df / greatest(corpus, 1))) AS s FROM m JOIN df USING (entity), c WHERE df >= 2),
p AS (SELECT a.page, b.page AS other, sum(b.n * b.s) AS score FROM k a JOIN k b USING (entity) WHERE a.page <> b.page GROUP BY ALL)
SELECT page, other, {R6.format('score')} AS score FROM p WHERE NOT EXISTS (FROM l WHERE l.a = p.page AND l.b = p.other OR l.a = p.other AND l.b = p.page)""")
def e04_related_pages(spark, sf):
    linked = t(spark, sf, "lineitem").filter("l_linenumber = 7").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"))
    return retrieval.related_pages(_mentions(spark, sf), linked, limit=1 << 30).select("page", "other", r6(F.col("score")).alias("score"))


L_TERMS = TERMS.replace("text", "body")


@query(f"""WITH x AS (SELECT doc_id AS page, source AS dir, 0 AS level, string_split(text, chr(10))[1] AS body FROM documents UNION ALL SELECT doc_id, source, 1, text FROM documents),
d AS (SELECT page, dir, level, {L_TERMS} AS ts FROM x), c AS (SELECT page, dir, level, len(ts)::DOUBLE AS l, {', '.join(f"len([w FOR w IN ts IF w = '{q}'])::DOUBLE AS f{i}" for i, q in enumerate(["of", "the", "thing"]))} FROM d),
s AS (SELECT count(*)::DOUBLE AS n, avg(l) AS a, {', '.join(f'count(*) FILTER (WHERE f{i} > 0)::DOUBLE AS n{i}' for i in range(3))} FROM c),
b AS (SELECT page, dir, level, {' + '.join(f'(-(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / a)))' for i in range(3))} AS score FROM c, s WHERE f0 > 0 OR f1 > 0 OR f2 > 0),
top AS (SELECT * FROM b WHERE level = 0 ORDER BY score, page LIMIT 40), best AS (SELECT dir, min(score) AS m FROM top GROUP BY dir ORDER BY m, dir LIMIT 3),
deep AS (SELECT dir, page, score, row_number() OVER (PARTITION BY dir ORDER BY score, page) AS rank FROM b JOIN best USING (dir) WHERE level = 1 QUALIFY rank <= 4),
shallow AS (SELECT dir, page, score, row_number() OVER (PARTITION BY dir ORDER BY score, page) AS rank FROM top JOIN best USING (dir) WHERE dir NOT IN (SELECT dir FROM deep) QUALIFY rank <= 4)
SELECT dir, page, {R6.format('score')} AS score, rank::INTEGER AS rank FROM (FROM deep UNION ALL FROM shallow)""")
def k05_descend(spark, sf):
    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.col("source").alias("dir"), F.substring_index("text", "\n", 1).alias("l0"), F.col("text").alias("l1"))
    return retrieval.descend(docs, ["the", "of", "thing"]).select("dir", "page", r6(F.col("score")).alias("score"), "rank")


@query("""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents),
r AS (SELECT doc_id, list_reduce(ps, lambda acc, x: CASE WHEN length(string_split(acc, chr(31))[-1]) = 0 THEN acc || x WHEN length(string_split(acc, chr(31))[-1]) + length(x) > 1200 THEN acc || chr(31) || x ELSE acc || chr(10) || chr(10) || x END) AS packed FROM p),
c AS (SELECT doc_id, [trim(y, chr(32) || chr(9) || chr(10) || chr(13)) FOR y IN string_split(packed, chr(31)) IF trim(y, chr(32) || chr(9) || chr(10) || chr(13)) <> ''] AS cs FROM r)
SELECT doc_id, i::INTEGER AS ord, cs[i + 1] AS chunk FROM c, LATERAL (SELECT unnest(range(len(cs))) AS i)""")
def b01_chunks(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.posexplode(text.chunks(F.col("text"), "\n")).alias("ord", "chunk"))


def _rounds(n: int) -> str:
    back = "0.5 + 0.5 * (SELECT coalesce(sum(x), 0) FROM r{j} WHERE node NOT IN (SELECT a FROM o))"
    step = "r{i} AS MATERIALIZED (SELECT node, sum(x) AS x FROM (SELECT b AS node, 0.5 * x * p AS x FROM r{j} JOIN st ON node = a UNION ALL SELECT node, s * (" + back + ") FROM s) GROUP BY node)"
    return ", ".join(["r0 AS MATERIALIZED (SELECT node, s AS x FROM s)", *[step.format(i=i, j=i - 1) for i in range(1, n + 1)]])


@query(f"""WITH {PAIRS}, o AS (SELECT a, sum(w) AS out FROM e GROUP BY a), st AS MATERIALIZED (SELECT e.a, e.b, w / out AS p FROM e JOIN o USING (a)),
s AS MATERIALIZED (SELECT p_partkey - 1 AS node, 1.0::DOUBLE / count(*) OVER () AS s FROM part WHERE p_partkey <= 4), {_rounds(20)} SELECT node, {R6.format('x')} AS score FROM r20""")
def j02_pagerank(spark, sf):
    seeds = t(spark, sf, "part").filter("p_partkey <= 4").select((F.col("p_partkey") - 1).alias("node"), F.lit(1.0).alias("mass"))  # 0 is outside the graph
    return graph.pagerank(graph.undirected(_links(spark, sf)), seeds, tolerance=0.0).select("node", r6(F.col("score")).alias("score"))


@query(f"""WITH RECURSIVE {PAIRS}, g AS MATERIALIZED (SELECT a, b FROM e), cc(node, label) USING KEY (node) AS (SELECT DISTINCT a, a FROM g UNION SELECT u.node, min(v.label) FROM recurring.cc u JOIN g ON g.a = u.node JOIN recurring.cc v ON v.node = g.b WHERE v.label < u.label GROUP BY u.node) SELECT node, label FROM cc""")
def j04_components(spark, sf):
    return graph.components(graph.undirected(_links(spark, sf)))


@query(f"WITH RECURSIVE {PAIRS}, g AS MATERIALIZED (SELECT a, b FROM e), r AS (SELECT min(a) AS node, 0 AS d FROM p UNION SELECT g.b, d + 1 FROM r JOIN g ON r.node = g.a WHERE d < 3) SELECT node, min(d)::INTEGER AS distance FROM r GROUP BY node")
def j08_distances(spark, sf):
    pairs = graph.held(graph.undirected(_links(spark, sf)), "pairs")
    root = pairs.agg(F.min("a")).collect()[0][0]
    return graph.distances(pairs, root, 3)


@query("SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def f06_activity(spark, sf):
    return readmodels.activity(t(spark, sf, "events"), "ts", "event_type")


@query("SELECT l_returnflag, list_sort(list(l_quantity))[least(count(*), floor(count(*) * 0.95)::BIGINT + 1)] AS p95, list_sort(list(l_quantity))[least(count(*), floor(count(*) * 0.5)::BIGINT + 1)] AS p50 FROM lineitem GROUP BY 1")
def g15_percentiles(spark, sf):
    return usage.percentiles(t(spark, sf, "lineitem"), "l_returnflag", "l_quantity", {"p95": 0.95, "p50": 0.5})


@query("""WITH RECURSIVE o AS (SELECT p_partkey::VARCHAR AS page, p_retailprice / 1000 AS value, p_size::DOUBLE AS cost, row_number() OVER (ORDER BY -(p_retailprice / 1000) / greatest(p_size, 0.1), p_size, p_partkey::VARCHAR) AS i FROM part),
r AS (SELECT 0::BIGINT AS i, 120.0::DOUBLE AS rest, NULL::VARCHAR AS page UNION ALL SELECT o.i, CASE WHEN cost <= rest THEN rest - cost ELSE rest END, CASE WHEN cost <= rest THEN o.page END FROM r JOIN o ON o.i = r.i + 1)
SELECT o.page, value, cost FROM r JOIN o USING (page)""")
def g06_fill_budget(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("page"), (F.col("p_retailprice") / 1000).alias("value"), F.col("p_size").cast("double").alias("cost"))
    return cognitive.fill_budget(p, 120.0)


@query("""WITH RECURSIVE f AS (SELECT event_type AS expert, CASE WHEN value > 30 THEN -1.0 ELSE 1.0 END AS loss, row_number() OVER (PARTITION BY event_type ORDER BY ts, CASE WHEN value > 30 THEN -1.0 ELSE 1.0 END) AS i FROM events),
r AS (SELECT DISTINCT event_type AS expert, 0::BIGINT AS i, 1.0::DOUBLE AS w FROM events UNION ALL SELECT r.expert, f.i, least(2.0, greatest(0.5, w * exp(-0.25 * loss))) FROM r JOIN f ON f.expert = r.expert AND f.i = r.i + 1)
SELECT expert, floor(arg_max(w, i) * 1e6 + 0.5) / 1e6 AS weight FROM r GROUP BY expert""")
def l01_expert_weights(spark, sf):
    f = t(spark, sf, "events").select(F.col("event_type").alias("expert"), "ts", F.when(F.col("value") > 30, -1.0).otherwise(1.0).alias("loss"))
    return usage.expert_weights(f).select("expert", r6(F.col("weight")).alias("weight"))


@query("""WITH RECURSIVE a AS (SELECT user_id AS item, event_type AS e, (event_id % 10) / 10.0::DOUBLE AS conf, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT DISTINCT user_id AS item, 0::BIGINT AS i, 1.0::DOUBLE AS days FROM events UNION ALL
SELECT r.item, a.i, round(least(30.0, CASE a.e WHEN 'error' THEN CASE WHEN conf >= 0.7 THEN 0.5 ELSE 1.0 END WHEN 'purchase' THEN days * 2.2 ELSE days * 1.2 END), 2) FROM r JOIN a ON a.item = r.item AND a.i = r.i + 1)
SELECT item, floor(arg_max(days, i) * 1e6 + 0.5) / 1e6 AS days FROM r GROUP BY item""")
def m03_review_interval(spark, sf):
    a = _attempts(spark, sf).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "result", "confidence"))).alias("xs"))
    return a.select("item", r6(cognitive.review_interval(F.col("xs"), F.lit(90.0))).alias("days"))


@query("""WITH u AS (SELECT DISTINCT string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS q FROM pages), x AS (SELECT array_to_string(q[1:i], '/') AS dir, q[i + 1] AS entry, i = len(q) - 1 AS leaf FROM u, LATERAL (SELECT unnest(range(len(q))) AS i))
SELECT dir, coalesce(string_agg(DISTINCT entry, ',' ORDER BY entry) FILTER (WHERE NOT leaf), '') AS subdirectories, coalesce(string_agg(DISTINCT entry, ',' ORDER BY entry) FILTER (WHERE leaf), '') AS pages FROM x GROUP BY dir""")
def a15_directory_index(spark, sf):
    p = t(spark, sf, "pages").select(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))
    return curation.directory_index(p)


@query(r"""WITH x AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS x FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS plain FROM x""")
def a06_strip_html(spark, sf):
    return t(spark, sf, "pages").select("page_id", bundle.strip_html(F.col("html")).alias("plain"))


from . import knowledge  # noqa: E402, F401  its queries are added to those above
