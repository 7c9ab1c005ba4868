"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (h1, h2, n): the 128-bit hash of a line's key and the number of documents counted so far that hold it,
range-partitioned and sorted by the hash. Batches enter one after another. Each new batch is merge-joined with the runs there are:

- its keys that no run knows (a merge-anti-join) become a run of level 0, so each key lives in one run;
- its keys that the runs know with less than ``min_docs`` documents are written as increments;
- its keys that the runs know with ``min_docs`` or more are dropped: they need no more counting.

As soon as a level has ``fanout`` runs they are merged, with the increments so far, into one sorted run of the next level. All runs
are Parquet in the shared folder, so a lost executor costs a reread only; what a compaction replaces is deleted.

Edge cases: null or empty text is one empty line; an empty key (only white space) never counts as a repeated line;
a line repeated in one document counts that document once; rows with equal or null doc_id are separate
documents for counting and share the dropped keys, which are a property of the line alone; a text of any length is split whole; columns
that are named like the new ones are replaced, others kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRIP = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIP)), UPPER, LOWER)


def line_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(0x5EED), key).alias("h2"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The levelled store. ``add`` takes a batch of (h1, h2) rows, one for each document and key."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = []
        self.increments: list[DataFrame] = []
        self.compactions = 0
        self.joined: list[DataFrame] = []  # the merge-anti-joins' plans, as they were run

    def _write(self, counted: DataFrame, name: str) -> DataFrame:
        return materialise(counted.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2"), name)

    @staticmethod
    def _union(runs: list[DataFrame]) -> DataFrame:
        union = runs[0]
        for run in runs[1:]:
            union = union.unionByName(run)
        return union

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        counted = batch.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        if self.runs():
            counted = materialise(counted, "batch")
            known = self._union(self.runs())
            fresh = counted.join(known.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            growing = known.filter(F.col("n") < self.min_docs).select("h1", "h2")
            self.increments.append(materialise(counted.join(growing.hint("merge"), ["h1", "h2"], "left_semi"), "increments"))
            self.joined.append(fresh)
            self._push(0, self._write(fresh, "run0"))
            discard(counted)
        else:
            self._push(0, self._write(counted, "run0"))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old = self.levels[level] + self.increments
            merged = self._write(self._sum(old), f"run{level + 1}")
            self.levels[level], self.increments, self.compactions = [], [], self.compactions + 1
            discard(*old)
            self._push(level + 1, merged)

    def _sum(self, tables: list[DataFrame]) -> DataFrame:
        return self._union(tables).groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def repeated(self) -> DataFrame | None:
        """(h1, h2) of all keys in at least min_docs documents."""
        tables = self.runs() + self.increments
        return self._sum(tables).filter(F.col("n") >= self.min_docs).select("h1", "h2") if tables else None


def _without(lines: Column, gone: Column, min_chars: int) -> Column:
    """The lines whose key is short or not among gone, an array of hashes.

    gone is dealt to about 4 sqrt(n) cells first, so that a line is looked for in one small cell. The cells are bound by
    a lambda of one turn, so they are made once a row whatever the optimiser does.
    """
    cells = F.ceil(F.sqrt(F.size(gone)) * 4).cast("int")
    cell = lambda h: F.pmod(h["h1"], cells).cast("int")
    dealt = F.transform(F.sequence(F.lit(0), cells - 1), lambda c: F.filter(gone, lambda h: cell(h) == c))
    keyed = F.transform(lines, lambda x: F.struct(x.alias("line"), line_key(x).alias("key")))
    hashed = F.transform(keyed, lambda x: F.struct(x["line"].alias("line"), (F.length(x["key"]) < min_chars).alias("short"), line_hash(x["key"]).alias("h")))
    stay = lambda s: F.filter(s["lines"], lambda x: x["short"] | ~F.array_contains(F.element_at(s["cells"], cell(x["h"]) + 1), x["h"]))
    return F.transform(F.array(F.struct(dealt.alias("cells"), hashed.alias("lines"))), lambda s: F.transform(stay(s), lambda x: x["line"]))[0]


def _with_any(hashes: DataFrame, repeated: DataFrame, broadcast_keys: int = 500_000, cells: int = 64) -> DataFrame:
    """The rows of hashes whose key is repeated. Up to ``broadcast_keys`` keys (16 bytes each) go to every task; more are joined, each key
    dealt to ``cells`` cells, so that a line of every document is no single group."""
    if repeated.count() <= broadcast_keys:
        return hashes.join(F.broadcast(repeated), ["h1", "h2"], "left_semi")
    dealt = repeated.select("h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    return hashes.withColumn("cell", F.pmod("k2", F.lit(cells)).cast("int")).join(dealt, ["h1", "h2", "cell"], "left_semi").drop("cell")


def drop_repeated_lines(documents: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2, store: LineRuns | None = None) -> DataFrame:
    """The input's columns with text replaced by kept text, plus n_lines and n_dropped (columns of those names are replaced).

    ``batches`` is how many increments the table enters the run store in; the result doesn't depend on it. Rows are joined with
    what they lose by a 128-bit digest of (doc_id, text), so rows that share a doc_id or have none are told apart.
    """
    spark = documents.sparkSession
    mine = [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(0xD0C), "text", "doc_id").alias("k2")]
    keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= min_chars)
    each = documents.select(*mine, F.explode(F.array_distinct(F.transform(keys, line_hash))).alias("h")).select("k1", "k2", "h.h1", "h.h2")
    hashes = materialise(each, "line_hashes")
    runs = store or LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        runs.add(hashes.filter(F.pmod(F.col("k1"), F.lit(batches)) == b).select("h1", "h2"))
    repeated = materialise(runs.repeated(), "repeated")
    dropped = _with_any(hashes, repeated).groupBy("k1", "k2").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    rows = documents.select(*mine, F.col("text").alias("whole"), F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "text"]).alias("row"))
    joined = rows.join(dropped, ["k1", "k2"], "left").select("row", "gone", lines_of(F.col("whole")).alias("lines"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(_without(F.col("lines"), F.col("gone"), min_chars))
    joined = joined.select("row", kept.alias("kept"), F.size("lines").cast("long").alias("n"))
    own = {"text": F.array_join("kept", "\n"), "n_lines": F.col("n"), "n_dropped": F.col("n") - F.size("kept")}
    names = list(dict.fromkeys([*documents.columns, *own]))
    return joined.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in names])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(documents, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(g.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN g ON k.key = g.key GROUP BY r, doc_id
"""
