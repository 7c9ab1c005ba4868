r"""Audit of how far the sources of a language diverge: shares of terms compared exactly, behind a count-min sketch.

A term is a run of ASCII letters and other code points above 0x7F, A-Z lower-cased. Each language keeps the terms found in at least
``min_docs`` of its documents.

1. Every task adds its documents' distinct (lang, term) to a count-min sketch of ``depth`` rows of ``width`` cells. Cells stop at
   255 (or at ``min_docs``, if that is more), so a stopped cell is beyond ``min_docs`` and sums reach it if and only if the true sums do. The
   sketches of all tasks are summed block by block; only one bit a cell (``depth * width / 8`` bytes, whatever the input) reaches the driver.
2. A second scan drops terms with a cell below ``min_docs``, which can't be frequent enough since a cell never underestimates, and
   counts only the others, by (lang, source, term) before anything is shuffled.
3. Exact document frequencies of the survivors decide what is kept. Shares are exact integers.
4. Two sources differ by a sum over all kept terms. Where at most one of them has the term, the summand depends on that one's count
   alone, so it is summed over the histogram of its counts; only terms that both have are joined, term by term.

Edge cases: null lang, source or text is the empty string; a document without terms still makes its group; a term repeated in a
document counts it once; rows with equal doc_id are separate documents; a language without kept terms has p = q and differences 0; a
very long text is counted whole; other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, materialise, mix, slices, table, text_bytes

FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
BLOCK = 1 << 12
SCALE, PRIOR = 1_000_000_000, 5


def terms_of(batch: pa.RecordBatch, column: int) -> Iterator[list[bytes]]:
    """The terms of each row's text, as UTF-8."""
    raw, offsets = text_bytes(batch.column(column))
    folded = raw.tobytes().translate(FOLD)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield folded[a:b].split()


def cells_of(lang: str, terms: list[bytes], depth: int, width: int) -> np.ndarray:
    """The cells, one a sketch row, of each term of a language: polynomials of the bytes, of all terms at once, then mixed."""
    if not terms:
        return np.zeros((0, depth), np.int64)
    sizes = np.fromiter(map(len, terms), np.int64, len(terms))
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
    h = np.add.reduceat((np.frombuffer(b"".join(terms), np.uint8) + np.uint64(1)) * powers[place], first)
    seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    one = mix(h ^ seed)
    two = mix(one + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    rows = np.arange(depth, dtype=np.uint64)
    return (((one[:, None] + rows * two[:, None]) >> np.uint64(20)) % np.uint64(width) + rows * np.uint64(width)).astype(np.int64)


def _named(documents: DataFrame) -> DataFrame:
    return documents.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def sketch(documents: DataFrame, min_docs: int, depth: int = 3, width: int = 1 << 21, held: int = 400_000) -> np.ndarray:
    """One bool a cell: whether documents may hold a term of that cell min_docs times."""
    limit = max(255, min_docs)
    kind = np.uint8 if limit == 255 else np.uint32

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(depth * width, kind)
        seen: dict[str, Counter] = {}

        def flush() -> None:
            for lang, counts in seen.items():
                at, by = cells_of(lang, list(counts), depth, width), np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), limit)
                for r in range(depth):
                    where, row = np.unique(at[:, r], return_inverse=True)
                    total = np.bincount(row, by).astype(np.int64) + cells[where]
                    cells[where] = np.minimum(total, limit)
            seen.clear()

        for batch in slices(batches, "text", 1 << 20):
            for lang, terms in zip(batch.column(0).to_pylist(), terms_of(batch, 1), strict=True):
                seen.setdefault(lang, Counter()).update(set(terms))
            if sum(map(len, seen.values())) > held:
                flush()
        flush()
        blocks = cells.reshape(-1, BLOCK)
        full = np.flatnonzero(blocks.any(1))
        for part in np.array_split(full, max(1, len(full) * BLOCK * cells.itemsize >> 20)):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([blocks[i].tobytes() for i in part], pa.binary())], names=["block", "cells"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(cells.as_buffer(), kind)
                sums[block] = np.minimum(sums[block] + got if block in sums else got.astype(np.int64), limit)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.packbits(s >= min_docs).tobytes() for s in sums.values()], pa.binary())], names=["block", "bits"])

    parts = map_arrow(_named(documents).select("lang", "text"), add, "block int, cells binary")
    bits = map_arrow(parts.repartition("block"), total, "block int, bits binary")
    may = np.zeros((depth * width // BLOCK, BLOCK), bool)
    for row in bits.collect():  # depth * width bits, whatever the input
        may[row.block] = np.unpackbits(np.frombuffer(row.bits, np.uint8))
    return may.ravel()


class Tally:
    """Occurrences and documents by (group, term), as sorted arrays: keys are a group's number times 2^32 plus a term's."""

    def __init__(self):
        self.keys, self.n, self.docs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, group_of_doc: np.ndarray, doc: np.ndarray, term: np.ndarray) -> None:
        """Term numbers and the document of each, of documents that are whole in this call."""
        seen, n = np.unique(doc << 32 | term, return_counts=True)
        self.parts.append((group_of_doc[seen >> 32] << 32 | (seen & 0xFFFFFFFF), n))
        self.waiting += len(seen)
        if self.waiting > 500_000:
            self.settle()

    def settle(self) -> None:
        if not self.parts:
            return
        keys = np.concatenate([self.keys, *[k for k, _ in self.parts]])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        total = lambda old, new: np.add.reduceat(np.concatenate([old, *new])[order], first) if len(first) else old
        self.n, self.docs = total(self.n, [n for _, n in self.parts]), total(self.docs, [np.ones(len(k), np.int64) for k, _ in self.parts])
        self.keys, self.parts, self.waiting = keys[first], [], 0


def surviving_counts(documents: DataFrame, may: np.ndarray, depth: int = 3, width: int = 1 << 21, held: int = 600_000) -> DataFrame:
    """(lang, source, term, n, docs) of the terms that pass the sketch, exact; also a row of null term a group, for groups without any.

    held: terms known, or sums kept, at most about so many before they are given out.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(np.packbits(may).tobytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(shipped.value, np.uint8)).view(bool)
        number: dict[str, dict[bytes, int]] = {}  # of each term of a language; -1: can't be frequent enough
        names: dict[str, list[bytes]] = {}
        groups: dict[tuple[str, str], int] = {}
        tally = Tally()

        def judge(lang: str, new: list[bytes]) -> None:
            passed = bits[cells_of(lang, new, depth, width)].all(1).tolist()
            of, listed = number[lang], names[lang]
            for term, ok in zip(new, passed, strict=True):
                of[term] = len(listed) if ok else -1
                if ok:
                    listed.append(term)

        def flush() -> Iterator[pa.RecordBatch]:
            tally.settle()
            bounds = np.searchsorted(tally.keys, np.arange(len(groups) + 1) << 32)
            for (lang, source), g in groups.items():
                a, b = bounds[g], bounds[g + 1]
                words = pa.array(names[lang], pa.binary()).take(pa.array(tally.keys[a:b] & 0xFFFFFFFF)).cast(pa.string())
                whole = [pa.concat_arrays([words, pa.nulls(1, pa.string())]), *[pa.array(np.append(x[a:b], 0)) for x in (tally.n, tally.docs)]]
                for i in range(0, b - a + 1, 20_000):
                    part = [x.slice(i, 20_000) for x in whole]
                    yield pa.RecordBatch.from_arrays([*[pa.array([x] * len(part[0]), pa.string()) for x in (lang, source)], *part], names=["lang", "source", "term", "n", "docs"])
            for x in (number, names, groups):
                x.clear()
            tally.__init__()

        for batch in slices(batches, "text", 1 << 20):
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), list(terms_of(batch, 2))
            of_doc = np.array([groups.setdefault(g, len(groups)) for g in zip(langs, sources, strict=True)])
            doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            found = []
            for lang, terms in zip(langs, texts, strict=True):
                of = number.setdefault(lang, {})
                names.setdefault(lang, [])
                ids = list(map(of.get, terms))
                if None in ids:
                    judge(lang, list({t for t, i in zip(terms, ids, strict=True) if i is None}))
                    ids = list(map(of.__getitem__, terms))
                found.append(np.array(ids, np.int64))
            term = np.concatenate(found)
            tally.add(of_doc, doc[term >= 0], term[term >= 0])
            if len(tally.keys) > held or sum(map(len, number.values())) > held:
                yield from flush()
        yield from flush()

    found = map_arrow(_named(documents).select("lang", "source", "text"), count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exact beyond 64 bits."""
    up = (count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", up, (total + terms * PRIOR).cast("decimal(20,0)")) + 1


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language: the sum of |p - q| over all kept terms.

    counts: (lang, source, term, p) where the count is above 0. groups: (lang, source, z, terms, own): z is the share of an absent term,
    terms all kept terms, own those that the source has.
    """
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("z2"), F.col("own").alias("own2"))
    sides = groups.join(other, "lang").filter(F.col("source") != F.col("item"))
    histogram = counts.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    alone = histogram.join(other.select("lang", "item", "z2"), "lang").filter(F.col("source") != F.col("item"))
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * F.abs(F.col("p") - F.col("z2"))).alias("alone"))
    x = counts.join(groups.select("lang", "source", "z"), ["lang", "source"])
    y = x.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"), F.col("z").alias("z2"))
    gain = F.abs(F.col("p") - F.col("p2")) - F.abs(F.col("p") - F.col("z2")) - F.abs(F.col("p2") - F.col("z")) + F.abs(F.col("z") - F.col("z2"))
    both = x.join(y, ["lang", "term"]).filter(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(gain).alias("both"))
    turned = lambda df, *values: df.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), *values)
    key = ["lang", "source", "item"]
    joined = sides.join(alone, key, "left").join(turned(alone, F.col("alone").alias("alone2")), key, "left").join(both.unionByName(turned(both, "both")), key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rest = (F.col("terms") - F.col("own") - F.col("own2")) * F.abs(F.col("z") - F.col("z2"))
    return joined.select(*key, (zero("alone") + zero("alone2") + zero("both") + rest).alias("value"))


def audit_sources(documents: DataFrame, min_docs: int = 30, top_terms: int = 50, depth: int = 3, width: int = 1 << 21) -> DataFrame:
    """(lang, source, part, item, value, rank): differences between the sources of a language, and each source's terms above its language."""
    may = sketch(documents, min_docs, depth, width)
    survivors = materialise(surviving_counts(documents, may, depth, width), "survivors")
    frequent = survivors.filter(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).filter(F.col("docs") >= min_docs).select("lang", "term", "all_n")
    frequent = materialise(frequent, "frequent")
    counts = materialise(survivors.join(frequent, ["lang", "term"]).select("lang", "source", "term", "n", "all_n"), "counts")
    langs = frequent.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("all_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = survivors.filter(F.col("term").isNull()).select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", *[zero(c) for c in ("terms", "all_total", "total", "own")])
    absent = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(0)).cast("long")
    groups = materialise(groups.withColumn("z", absent), "groups")
    shares = counts.join(groups.select("lang", "source", "total", "terms", "all_total"), ["lang", "source"])
    shares = shares.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("all_n"), F.col("all_total"), F.col("terms")).alias("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = _pairs(shares.select("lang", "source", "term", "p"), groups).withColumn("rank", F.row_number().over(order))
    term = shares.filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    term = term.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    out = [df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank") for part, df in (("pair", pair), ("term", term))]
    return out[0].unionByName(out[1])


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS all_n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS terms, sum(all_n) AS all_total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.all_n, v.terms, v.all_total, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * terms)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (all_n + 5)) // (all_total + 5 * terms)::HUGEINT AS q FROM f),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM y)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM z WHERE part = 'pair' OR rank <= 50
"""
