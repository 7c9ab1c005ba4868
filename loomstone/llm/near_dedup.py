"""Near-duplicate classes by DartMinHash signatures of word shingles.

A document is the multiset of its five-word shingles (words: runs without ASCII white space; fewer than five words: one
shingle of them all). A shingle of weight w owns the element region [0, w); unit slab s of it receives a
Poisson stream of darts in order of rank, each with a hashed coordinate. A document keeps, for each of the
``hashes`` coordinates, its earliest dart. Darts are thrown up to a rank that yields about K ln K + 3 K darts a document
whatever its size, doubled for documents that still have an empty coordinate. Two documents keep the same
dart at a coordinate with probability equal to their weighted Jaccard similarity.

A band is ``rows`` coordinates; ``bands`` of them are cut from fixed permutations of all coordinates, so each coordinate
serves in equally many. Documents sharing a band are candidates. With 64 bands of 8, a pair of similarity 0.8 misses every
band with probability 8e-6 (were bands independent), one of 0.5 meets with 0.22 and one of 0.3 with 0.004: documents that only
share a long passage seldom meet. Exact copies collapse to one representative first. Within a bucket each round compares some pivots with all
members not yet in the pivot's component, until every bucket is one component or all its pairs were compared. The
number of pivots grows by ``growth`` each round, so rounds are logarithmic in the largest bucket and a bucket of like documents
ends long before its pairs are listed. Candidates are verified by their exact weighted Jaccard similarity.

Buckets still crowded with unlike documents after the first round (they share a long passage, say) are replaced exactly: their
documents meet again under each slab of their prefix, the first n - ceil(threshold n) + 1 slabs in one order of all slabs,
of which two documents of at least the threshold share one. Any order that is the same for all documents is exact. This one puts the
slabs that are frequent in some batch of those documents last, so a passage that many hold is in few prefixes. The
prefix is cut where the slabs are read, so only its entries become rows.
A pair meets at a slab only if what either has from there on could make up the overlap it needs; at the first slab they share it must.

Rows, not ids, are compared: two texts under one doc_id are two documents, and each can be in a class of its own.

Edge cases: a text that is null, empty or white space has no shingle and is a class of its own; texts equal up to
white space are one class; rows with null doc_id get class null and are compared with nothing; a text of any length is hashed in pieces of
bounded size and compared whole; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialise, mix, slices, table, text_bytes
from .graph import components

U = np.uint64
GOLD = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE[IS_SPACE] = 0
LANES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)
POWERS = np.cumprod(np.full(1 << 16, 0xD1342543DE82EF95, np.uint64))
PIECE = 1 << 20


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the n + 1 offsets of the rows' words. A row longer than PIECE bytes is hashed piece by piece."""
    if len(raw) > PIECE and len(offsets) == 2:
        parts, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + PIECE)
            if end < len(raw) and (gaps := np.flatnonzero(IS_SPACE[raw[at:end]])).size:
                end = at + int(gaps[-1]) + 1
            parts.append(word_hashes(raw[at:end], np.array([0, end - at]))[0])
            at = end
        words = np.concatenate(parts)
        return words, np.array([0, len(words)])
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    gap = IS_SPACE[raw]
    before = np.empty(len(raw), bool)
    before[0], before[1:] = True, gap[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < len(raw)]] = True
    starts = np.flatnonzero(~gap & before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.arange(starts[0], len(raw))
    at -= np.repeat(starts, np.diff(starts, append=len(raw)))
    values = BYTE[raw[starts[0] :]] * POWERS[at & 0xFFFF]
    return mix(np.add.reduceat(values, starts - starts[0])), np.searchsorted(starts, offsets)


def slabs(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the unit slabs (shingle, occurrence) of all rows and the n + 1 offsets of the rows' slabs."""
    n = np.diff(offsets)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    start = np.repeat(offsets[:-1], count) + np.arange(out[-1]) - np.repeat(out[:-1], count)
    room = np.repeat(offsets[1:], count)
    grams = np.zeros(len(start), np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for j in range(size):
        grams += np.where(start + j < room, padded[start + j] * LANES[j], U(0))
    grams = mix(grams)
    keys = grams ^ mix(doc.astype(np.uint64) * U(GOLD))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(ranked)), 0)) if len(ranked) else np.zeros(0, np.int64)
    turn = np.empty(len(ranked), np.uint64)
    turn[order] = (np.arange(len(ranked)) - first).astype(np.uint64)
    return mix(grams + turn * U(GOLD)), out


def _gap(slab: np.ndarray, k) -> tuple[np.ndarray, np.ndarray]:
    """The k-th dart of each slab: its hash and the exponential gap in rank before it."""
    h = mix(slab + (np.atleast_1d(np.asarray(k, np.uint64)) + U(1)) * LANES[8])
    return h, -np.log(((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)


def signatures(slab: np.ndarray, offsets: np.ndarray, hashes: int) -> np.ndarray:
    """(rows, hashes) of 32-bit dart ids; rows without slabs are all zero."""
    n = np.diff(offsets)
    best = np.full(len(n) * hashes, np.iinfo(np.uint64).max, np.uint64)
    reach = hashes * (math.log(hashes) + 3) / np.maximum(n, 1)

    def throw(todo: np.ndarray) -> None:
        def land(h, rank, doc):
            spot = doc * hashes + ((h >> U(3)) % U(hashes)).astype(np.int64)
            dart = mix(h + LANES[9]) >> U(32)
            np.minimum.at(best, spot, (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << U(32)) | dart)

        few = todo[n[todo] < 64]
        for size in np.unique(n[few]):
            rows = few[n[few] == size]
            step = max(1, (1 << 20) // int(size * (reach[rows].max() + 8 * math.sqrt(reach[rows].max()) + 12)))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                own = slab[(offsets[part][:, None] + np.arange(size)).ravel()]
                doc = np.repeat(part, size)
                m = int(reach[part].max() + 8 * math.sqrt(reach[part].max()) + 12)
                h, gap = _gap(own[:, None], np.arange(m, dtype=np.uint64))
                rank = np.cumsum(gap, 1)
                hit = rank <= reach[doc][:, None]
                land(h[hit], rank[hit], np.broadcast_to(doc[:, None], hit.shape)[hit])
        many = todo[n[todo] >= 64]
        if len(many):
            index = np.concatenate([np.arange(offsets[d], offsets[d + 1]) for d in many])
            own, doc = slab[index], np.repeat(many, n[many])
            rank, k = np.zeros(len(own)), 0
            while len(own):
                h, gap = _gap(own, k)
                rank = rank + gap
                hit = rank <= reach[doc]
                own, doc, rank, k = own[hit], doc[hit], rank[hit], k + 1
                land(h[hit], rank, doc)

    todo = np.flatnonzero(n > 0)
    while len(todo):
        throw(todo)
        todo = todo[(best.reshape(-1, hashes)[todo] == np.iinfo(np.uint64).max).any(1)]
        reach[todo] *= 2
    return np.where(best == np.iinfo(np.uint64).max, 0, best & U(0xFFFFFFFF)).astype(np.uint32).reshape(-1, hashes)


def band_keys(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """(documents, bands) keys; bands are consecutive groups of ``rows`` coordinates in fixed permutations of them all."""
    rng, each = np.random.default_rng(7), sig.shape[1] // rows
    groups = np.concatenate([rng.permutation(sig.shape[1])[: each * rows].reshape(each, rows) for _ in range(-(-bands // each))])[:bands]
    keys = np.zeros((len(sig), bands), np.uint64)
    for j in range(rows):
        keys = mix(keys + sig[:, groups[:, j]].astype(np.uint64) * LANES[16 + j] + LANES[32])
    return mix(keys + np.arange(bands, dtype=np.uint64) * U(GOLD)).view(np.int64)


def digests(words: np.ndarray, off: np.ndarray) -> list[pa.Array]:
    """Two 64-bit digests of each row's word sequence."""
    place = np.arange(len(words)) - np.repeat(off[:-1], np.diff(off))
    out = []
    for lane in (40, 41):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words * LANES[lane] + place.astype(np.uint64) * U(GOLD)), dtype=np.uint64)])
        out.append(pa.array(mix(c[off[1:]] - c[off[:-1]] + np.diff(off).astype(np.uint64)).view(np.int64)))
    return out


def sketch(documents: DataFrame, hashes: int = 256, rows: int = 8, bands: int = 64, size: int = 5) -> DataFrame:
    """(doc_id, t, d1, d2, n, bands) of (doc_id, t, text): digest of the word sequence, weight, and band keys (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, off = word_hashes(*text_bytes(batch.column(2)))
            slab, at = slabs(words, off, size)
            n = np.diff(at)
            keys = band_keys(signatures(slab, at, hashes), rows, bands)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[n > 0].ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *digests(words, off), pa.array(n.astype(np.int64)), lists], names=["doc_id", "t", "d1", "d2", "n", "bands"])

    return map_arrow(documents.select("doc_id", "t", "text"), run, "doc_id long, t long, d1 long, d2 long, n long, bands array<long>")


def slab_sets(documents: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, d1, d2, slabs): distinct 32-bit hashes of a document's unit slabs, whose set Jaccard is the weighted Jaccard of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, off = word_hashes(*text_bytes(batch.column(1)))
            slab, at = slabs(words, off, size)
            row = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
            each = np.unique((row << U(32)) | (slab >> U(32)))
            ends = np.searchsorted(each, np.arange(len(at), dtype=np.uint64) << U(32)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((each & U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *digests(words, off), lists], names=["doc_id", "d1", "d2", "slabs"])

    return map_arrow(documents.select("doc_id", "text"), run, "doc_id long, d1 long, d2 long, slabs array<int>")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float, broadcast_ids: int, name: str) -> DataFrame:
    """The pairs (a, b) of at least the threshold. Only sets of ids in the pairs are shuffled."""
    pairs = materialise(pairs, f"pairs_{name}")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = F.broadcast(ids) if 2 * pairs.count() <= broadcast_ids else ids
    sets = sets.join(ids, "id", "left_semi")
    a = sets.select(F.col("id").alias("a"), F.col("slabs").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("slabs").alias("sb"))
    x = pairs.join(b, "b").join(a, "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - shared
    found = materialise(x.filter(shared >= F.lit(threshold) * union).select("a", "b"), f"edges_{name}")
    discard(pairs)
    return found


def _merged(labels: DataFrame | None, found: DataFrame, name: str) -> DataFrame:
    """labels (id, label: least id of the component) after adding the found edges; only components are linked anew."""
    if labels is None:
        return materialise(components(found, f"cc_{name}"), f"labels_{name}")
    la, lb = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    links = found.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    linked = materialise(components(links, f"cc_{name}"), f"moved_{name}")
    moved = linked.select(F.col("id").alias("label"), F.col("label").alias("to"))
    old = labels.join(moved, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    new = moved.join(labels, moved["label"] == labels["id"], "left_anti").select(F.col("label").alias("id"), F.col("to").alias("label"))
    out = materialise(old.unionByName(new), f"labels_{name}")
    discard(linked, labels)
    return out


def frequent_slabs(sets: DataFrame, share: int = 64, most: int = 500_000) -> np.ndarray:
    """Slabs that at least two documents and one in ``share`` of some batch hold, at most ``most`` of them, the rarest first.

    Each batch tells only its own frequent slabs, ``share`` times a document's mean number at most, so little is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, times = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            often = times >= max(2, -(-batch.num_rows // share))
            yield pa.RecordBatch.from_arrays([pa.array(found[often], pa.int32()), pa.array(times[often], pa.int64())], names=["s", "f"])

    counts = map_arrow(sets.select("slabs"), run, "s int, f long").groupBy("s").agg(F.sum("f").alias("f")).orderBy(F.desc("f"), "s").limit(most)
    return np.array([r.s for r in counts.toLocalIterator()], np.int32)[::-1]  # 2 MB at most


def prefix_lists(sets: DataFrame, threshold: float, frequent: np.ndarray) -> DataFrame:
    """(id, n, keys): the keys of the slabs of each document's (id, slabs) prefix, in order.

    The order: slabs that are not frequent, by a hash; then the frequent ones as given, the rarest first.
    """
    shipped = sets.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        by = np.argsort(known, kind="stable")
        ranked = known[by]
        for batch in batches:
            sizes, out = [], []
            for row in batch.column(1):
                s = row.values.to_numpy(zero_copy_only=False)
                rank = np.full(len(s), -1)
                if len(ranked):
                    spot = np.minimum(np.searchsorted(ranked, s), len(ranked) - 1)
                    rank = np.where(ranked[spot] == s, by[spot], -1)
                keys = mix(s.view(np.uint32).astype(np.uint64) * LANES[50])
                out.append(keys[np.lexsort((keys, rank))[: len(s) - math.ceil(len(s) * threshold - 1e-9) + 1]].view(np.int64))
                sizes.append(len(s))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out or [np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), lists], names=["id", "n", "keys"])

    return map_arrow(sets.select("id", "slabs"), run, "id long, n long, keys array<long>")


def _open_buckets(lists: DataFrame, labels: DataFrame, done: int, placed: bool, name: str) -> DataFrame:
    """(bk, id, n, at, label, size): the members of buckets of several components and more than ``done`` members.

    lists: (id, n, keys). A document's label is joined before its keys become rows. at: the key's place from 1, 0 if places say nothing.
    """
    x = lists.join(labels, "id", "left").select("id", "n", F.coalesce("label", "id").alias("label"), F.posexplode("keys").alias("at", "bk"))
    each = x.withColumn("at", F.col("at") + 1 if placed else F.lit(0))
    spread = each.groupBy("bk").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("size")).filter((F.col("l0") < F.col("l1")) & (F.col("size") > done)).select("bk", "size")
    return materialise(each.join(spread, "bk"), name)


def _pivot_pairs(tagged: DataFrame, pivots: int, threshold: float) -> DataFrame:
    """(a, b): members of a bucket beside its pivots of other components; in a bucket of at most 2 ``pivots`` members each is a pivot."""
    salt = F.when(F.col("size") <= 2 * pivots, F.col("id")).otherwise(F.pmod(F.xxhash64("id"), F.lit(pivots)))
    chosen = tagged.groupBy("bk", salt.alias("salt")).agg(F.min_by(F.struct("id", "label", "n", "at"), "id").alias("p")).select("bk", F.col("p.id").alias("a"), F.col("p.label").alias("la"), F.col("p.n").alias("na"), F.col("p.at").alias("aa"))
    need = F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("na")) - F.lit(1e-6)
    fits = (F.col("at") == 0) | (1 + F.least(F.col("n") - F.col("at"), F.col("na") - F.col("aa")) >= need)
    met = tagged.join(chosen, "bk").filter((F.col("label") != F.col("la")) & (F.col("id") != F.col("a")) & fits)
    return met.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))


def near_duplicate_classes(documents: DataFrame, threshold: float = 0.8, hashes: int = 256, rows: int = 8, bands: int = 64, size: int = 5, pivots: int = 8, growth: int = 16, broadcast_ids: int = 1_000_000) -> DataFrame:
    """(doc_id, t, key, class_id, exact_id) of every row: t is xxhash64(text), key is the class's own, class_id the least doc_id
    of the class, exact_id that of the exact copies. Classes of rows that share a doc_id can have the same class_id; key tells them apart.

    Only candidates' texts are read a second time. Their ids are broadcast when they are at most ``broadcast_ids``
    (16 MB); beyond that the texts are joined by shuffle.
    """
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    # row numbers are fixed by being written
    sketched = materialise(sketch(own, hashes, rows, bands, size).withColumn("rid", F.monotonically_increasing_id()), "sketch")
    solid = sketched.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    exact = materialise(solid.groupBy("d1", "d2").agg(F.min("rid").alias("id"), F.min("doc_id").alias("rep"), F.min("n").alias("n")), "exact")
    reps = solid.select(F.col("rid").alias("id"), "n", "bands").join(exact.select("id"), "id", "left_semi")
    entries = materialise(reps.select("id", "n", F.explode("bands").alias("bk")), "bands")
    crowd = entries.groupBy("bk").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter(F.col("lo") < F.col("hi")).select("bk", "lo")
    members = materialise(entries.join(crowd, "bk"), "members")
    discard(entries)

    candidates = materialise(exact.join(members.select("id").distinct(), "id", "left_semi").select("id", F.col("rep").alias("doc_id"), "d1", "d2"), "candidates")
    ids = candidates.select("doc_id").distinct()
    texts = own.join(F.broadcast(ids) if candidates.count() <= broadcast_ids else ids, "doc_id", "left_semi")
    sets = materialise(slab_sets(texts, size).join(candidates, ["doc_id", "d1", "d2"]).select("id", "slabs").dropDuplicates(["id"]), "slabs")
    discard(candidates)

    weights = members.select("id", "n").distinct()

    def linked(labels: DataFrame | None, pairs: DataFrame, turn: int) -> DataFrame:
        """labels after the pairs that are near duplicates have been joined."""
        pairs = pairs.select("a", "b").distinct()
        pairs = pairs.join(weights.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(weights.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
        pairs = pairs.filter(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")).select("a", "b")
        found = _verified(pairs, sets, threshold, broadcast_ids, str(turn))
        if labels is None or not found.isEmpty():
            labels = _merged(labels, found, str(turn))
        discard(found)
        return labels

    labels = linked(None, members.filter(F.col("id") != F.col("lo")).select(F.col("lo").alias("a"), F.col("id").alias("b")), 0)
    # buckets of two are done; the others compare each member with each, or are replaced by prefixes if they are crowded
    lists = materialise(members.groupBy("id", "n").agg(F.collect_list("bk").alias("keys")), "band_lists")
    tagged = _open_buckets(lists, labels, 2, False, "open_1")
    discard(lists)
    crowded = F.col("size") > 2 * pivots
    held = materialise(tagged.filter(crowded).select("id").distinct(), "held")
    labels = linked(labels, _pivot_pairs(tagged.filter(~crowded), pivots, threshold), 1)
    discard(tagged)
    if many := held.count():
        theirs = materialise(sets.join(held, "id", "left_semi"), "held_slabs")
        # dealt evenly, so that a task cuts the prefixes of 256 documents however many share a passage
        prefixes = materialise(prefix_lists(theirs.repartition(-(-many // 256)), threshold, frequent_slabs(theirs)), "prefixes")
        discard(theirs)
        turn, done = 2, 1
        while not (tagged := _open_buckets(prefixes, labels, done, True, f"open_{turn}")).isEmpty():
            labels = linked(labels, _pivot_pairs(tagged, pivots, threshold), turn)
            discard(tagged)
            # every pair of a bucket of at most 2 pivots members has been compared
            turn, done, pivots = turn + 1, 2 * pivots, pivots * growth
        discard(prefixes)
    discard(held)
    discard(sets)
    named = labels.join(exact.select("id", "rep"), "id")
    classes = labels.join(named.groupBy("label").agg(F.min("rep").alias("class_id")), "label")
    known = materialise(exact.select("d1", "d2", "id", "rep").join(classes, "id", "left").select("d1", "d2", "rep", F.coalesce("label", "id").alias("key"), F.coalesce("class_id", "rep").alias("class_id")), "classes")
    whole = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    final = sketched.select("doc_id", "t", "rid", F.when(whole, F.col("d1")).alias("d1"), "d2").join(known, ["d1", "d2"], "left")
    return final.select("doc_id", "t", F.coalesce("key", "rid").alias("key"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("exact_id"))


def one_of_each_class(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of documents, columns as they are, that stand for their class: of its least doc_id the text of least hash, once.
    Rows with null doc_id stay."""
    own = documents.withColumn("_t", F.xxhash64("text"))
    stay = classes.filter(F.col("class_id") == F.col("doc_id")).groupBy("key", "doc_id").agg(F.min("t").alias("_t")).select("doc_id", "_t").distinct()
    kept = own.filter(F.col("doc_id").isNotNull()).join(stay, ["doc_id", "_t"], "left_semi").dropDuplicates(["doc_id", "_t"])
    return kept.unionByName(own.filter(F.col("doc_id").isNull())).select(*[F.col(f"`{c}`") for c in documents.columns])


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "exact_id")
