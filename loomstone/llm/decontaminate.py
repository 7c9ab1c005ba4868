"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are lower-cased and runs of white space become one space. A benchmark item of m characters may differ
from a passage by e = floor(``error`` * m) edits, fewer if it is so short that the lemma could not promise a shared
q-gram. A passage within e edits shares at least m - q + 1 - q*e of the item's q-grams, all on diagonals (place in the
text minus place in the item) that differ by e at most. Shared q-grams are counted in diagonal bands of width
2(e + 1) that start every e + 1 diagonals, so each such set of diagonals lies inside one band. Bands that
meet the bound are verified by a semi-global alignment held to the band; the best end is reported.

q-grams are found through a bit table of the items' q-grams and a sorted lookup of those that pass it. The
benchmark is used in blocks of at most ``block_chars`` characters, each broadcast and matched against all
documents, so what is broadcast never grows with the benchmark.

Edge cases: null and empty texts match nothing; very long or repetitive texts are used whole, their pairs of places counted in
chunks of bounded size; an item with fewer than q characters after normalising is found only as
an exact substring between word boundaries; empty items are ignored; equal items are each reported; repeated rows are each
reported under its doc_id, null or not; other columns are not read, and drop_contaminated keeps them; an empty table on either side
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_rows, map_arrow, slices, table

BASE = 0x9E3779B1
BITS = 22


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams, built by doubling; the result has len(codes) - q + 1 entries."""
    if len(codes) < q:
        return np.zeros(0, np.uint32)
    out, width, have = None, codes * np.uint32(0x85EBCA6B) ^ (codes >> np.uint32(3)), 1
    left, taken = q, 0
    while left:
        if left & 1:
            part = width[taken : taken + len(codes) - q + 1]
            out = part if out is None else out * np.uint32(pow(BASE, have, 1 << 32)) + part
            taken += have
        left >>= 1
        if left:
            width = width[: len(width) - have] * np.uint32(pow(BASE, have, 1 << 32)) + width[have:]
            have *= 2
    return out ^ (out >> np.uint32(15))


class Block:
    """The q-gram index of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]], q: int, error: float):
        self.q = q
        kept = [(i, normalise(t)) for i, t in items]
        self.short = [(i, t) for i, t in kept if 0 < len(t) < q]
        kept = [(i, t) for i, t in kept if len(t) >= q]
        self.ids = [i for i, _ in kept]
        self.texts = [t for _, t in kept]
        self.codes = [_codes(t) for t in self.texts]
        self.m = np.array([len(c) for c in self.codes], np.int64)
        self.e = np.minimum((error * self.m).astype(np.int64), np.maximum(0, (self.m - q) // q))
        self.need = np.maximum(1, self.m - q + 1 - q * self.e)
        grams = [gram_hashes(c, q) for c in self.codes]
        self.item = np.repeat(np.arange(len(kept)), [len(g) for g in grams])
        self.place = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0, np.int64)])
        values = np.concatenate(grams or [np.zeros(0, np.uint32)])
        order = np.argsort(values, kind="stable")
        self.item, self.place, values = self.item[order], self.place[order], values[order]
        self.values, self.first = np.unique(values, return_index=True)
        self.count = np.diff(self.first, append=len(values))

    def table(self) -> np.ndarray:
        bits = np.zeros(1 << BITS, bool)
        bits[self.values >> np.uint32(32 - BITS)] = True
        return bits

    def bands(self, doc: np.ndarray, where: np.ndarray, hit: np.ndarray, chunk: int = 1 << 18) -> np.ndarray:
        """Rows (doc, item, lowest diagonal) of the bands that meet the bound. hit: index into values.

        Pairs of places are expanded ``chunk`` at a time and summed by band, so memory follows the bands, not the pairs.
        """
        n = self.count[hit]
        upto = np.cumsum(n)
        lowest = -int(self.m.max()) - 2 if len(self.m) else 0
        width = (int(where.max()) if len(where) else 0) - lowest + 2
        keys, counts, start = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while start < len(hit):
            base = upto[start] - n[start]
            stop = max(start + 1, int(np.searchsorted(upto, base + chunk, side="right")))
            part = n[start:stop]
            entry = np.repeat(self.first[hit[start:stop]], part) + np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
            item = self.item[entry]
            band = np.floor_divide(np.repeat(where[start:stop], part) - self.place[entry], self.e[item] + 1)
            # exact and unique: band - lowest is below width, item below the number of items
            key = (np.repeat(doc[start:stop], part) * len(self.m) + item) * width + (band - lowest)
            key, new = np.unique(np.concatenate([keys, key, key - 1]), return_inverse=True)
            weights = np.concatenate([counts, np.ones(len(new) - len(counts), np.int64)])
            keys, counts, start = key, np.bincount(new, weights, len(key)).astype(np.int64), stop
        pair, band = np.divmod(keys, width)
        found = np.stack([pair // max(1, len(self.m)), pair % max(1, len(self.m)), band + lowest], 1)
        found = found[counts >= self.need[found[:, 1]]]
        found[:, 2] *= self.e[found[:, 1]] + 1
        return found

    def align(self, texts: list[np.ndarray], items: np.ndarray, lows: np.ndarray) -> list[tuple[int, int, int] | None]:
        """(edits, start, end) of the best alignment of each whole item to its text on diagonals low .. low + 2(e + 1), all at once."""
        m, e = self.m[items], self.e[items]
        own = 4 * e + 2  # the band and what e edits can leave it by
        width, deep, n = int(own.max()), int(m.max()), len(items)
        left = lows - e
        big = np.int32(deep + width + 1)
        at = np.arange(width, dtype=np.int32)
        pattern = np.zeros((deep, n, 1), np.uint32)
        padded = np.full((n, deep + width), 0xFFFFFFFF, np.uint32)
        size = np.array([len(t) for t in texts])
        for k, text in enumerate(texts):
            pattern[: m[k], k, 0] = self.codes[items[k]]
            a, b = max(0, left[k]), min(size[k], left[k] + deep + width)
            if b > a:
                padded[k, a - left[k] : b - left[k]] = text[a:b]
        begin = left[:, None] + at
        cost = np.where((begin >= 0) & (begin <= size[:, None]) & (at < own[:, None]), np.int32(0), big)
        up, begin_up = np.full_like(cost, big), np.zeros_like(begin)
        last_cost, last_begin = cost, begin
        for i in range(deep):
            diagonal = cost + (padded[:, i : i + width] != pattern[i])
            up[:, :-1], begin_up[:, :-1] = cost[:, 1:] + 1, begin[:, 1:]
            best = np.minimum(diagonal, up)
            begin = np.where(diagonal <= up, begin, begin_up)
            run = np.minimum.accumulate(best - at, 1) + at
            source = np.maximum.accumulate(np.where(best == run, at, 0), 1)
            begin, cost = np.take_along_axis(begin, source, 1), run
            if (ends := m == i + 1).any():
                last_cost, last_begin = np.where(ends[:, None], cost, last_cost), np.where(ends[:, None], begin, last_begin)
        end = (left + m)[:, None] + at
        last_cost = np.where((end >= 0) & (end <= size[:, None]) & (at < own[:, None]), last_cost, big)
        k = last_cost.argmin(1)
        rows = np.arange(n)
        found = zip(last_cost[rows, k].tolist(), last_begin[rows, k].tolist(), end[rows, k].tolist(), e.tolist(), strict=True)
        return [(c, s, t) if c <= most else None for c, s, t, most in found]


def _match(block: Block, bits: np.ndarray, ids: list, texts: list[str | None]) -> list[tuple]:
    out, q = [], block.q
    norm = [normalise(t) for t in texts]
    for i, t in enumerate(norm):
        for item, s in block.short:
            if (k := f" {t} ".find(f" {s} ")) >= 0:
                out.append((ids[i], item, k, k + len(s), 0))
    sizes = np.array([len(t) + 1 for t in norm], np.int64)
    codes = _codes("\0".join(norm) + "\0")
    begin = np.cumsum(sizes) - sizes
    grams = gram_hashes(codes, q)
    places = np.flatnonzero(bits[grams >> np.uint32(32 - BITS)])
    if not len(places):
        return out
    g = grams[places]
    hit = np.minimum(np.searchsorted(block.values, g), len(block.values) - 1)
    good = block.values[hit] == g
    places, hit = places[good], hit[good]
    doc = np.searchsorted(begin, places, side="right") - 1
    # a band needs so many shared q-grams that a document with fewer in all is out
    enough = np.bincount(doc, minlength=len(norm)) >= (block.need.min() if len(block.need) else 1)
    keep = enough[doc]
    places, hit, doc = places[keep], hit[keep], doc[keep]
    best: dict[tuple[int, int], tuple] = {}
    todo, looked = [], set()
    for d, item, low in block.bands(doc, places - begin[doc], hit).tolist():
        if (d, item) not in looked and (k := norm[d].find(block.texts[item])) >= 0:
            best[(d, item)] = (0, k, k + len(block.texts[item]))  # no edits: nothing can be better
        looked.add((d, item))
        if (d, item) not in best:
            todo.append((d, item, low))
    todo.sort(key=lambda x: block.m[x[1]])
    i = 0
    while i < len(todo):
        # as many at once as keep a row of costs within about a million cells
        part = todo[i : i + 64]
        part = part[: max(1, (1 << 20) // (4 * int(block.e[part[-1][1]]) + 2 + int(block.m[part[-1][1]])))]
        i += len(part)
        texts = [codes[begin[d] : begin[d] + sizes[d] - 1] for d, _, _ in part]
        for (d, item, _), got in zip(part, block.align(texts, np.array([x[1] for x in part]), np.array([x[2] for x in part])), strict=True):
            if got and got < best.get((d, item), (1 << 60,)):
                best[(d, item)] = got
    return out + [(ids[d], block.ids[item], s, t, e) for (d, item), (e, s, t) in best.items()]


SCHEMA = "doc_id long, item_id long, start long, end long, edits long"


def benchmark_blocks(benchmark: DataFrame, q: int, error: float, block_chars: int) -> Iterator[Block]:
    """Indexes of the benchmark's rows, about block_chars characters each; a longer single item makes a larger block."""
    total = benchmark.agg(F.sum(F.char_length("text"))).collect()[0][0] or 0
    blocks = max(1, -(-int(total) // block_chars))
    for b in range(blocks):
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "text").collect()
        index = Block(sorted((r.item_id, r.text) for r in rows if r.item_id is not None and r.text), q, error)
        if index.ids or index.short:
            yield index


def contaminations(documents: DataFrame, benchmark: DataFrame, q: int = 8, error: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, start, end, edits): the best match of each item in each document, places in the normalised text."""
    spark = documents.sparkSession
    found = None
    for index in benchmark_blocks(benchmark, q, error, block_chars):
        shipped = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            block = shipped.value
            bits = block.table()
            for batch in slices(batches, "text"):
                rows = _match(block, bits, batch.column(0).to_pylist(), batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["doc_id", "item_id", "start", "end", "edits"])

        part = map_arrow(documents.select("doc_id", "text"), run, SCHEMA)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if found is None else found


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, q: int = 8, error: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of documents without any contamination, columns as they are."""
    for index in benchmark_blocks(benchmark, q, error, block_chars):
        shipped = documents.sparkSession.sparkContext.broadcast(index)

        def test(shipped=shipped):
            block = shipped.value
            bits = block.table()

            def clean(ids: list, texts: list) -> list[bool]:
                hit = {r[0] for r in _match(block, bits, list(range(len(texts))), texts)}
                return [i not in hit for i in range(len(texts))]

            return clean

        documents = keep_rows(documents, test)
    return documents


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
