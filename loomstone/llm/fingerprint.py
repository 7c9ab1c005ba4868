"""Document fingerprints by winnowing, in DataFrame expressions only.

A text is cut into tokens where its own characters say so, nowhere by counting: a token ends after white space, a sign, a digit or one of
a few letters, and a character of a script without spaces (Han, kana, Thai and the like) or a symbol is a token by itself. An edit
therefore moves the tokens it touches and no others, in any script and inside any run without spaces. Every character belongs to a token.

The hash of every k = 4 consecutive tokens is a cyclic polynomial, the xor of rotated token hashes, rolled for all places at once by
doubling. Of every w = 8 consecutive hashes the least is selected, rightmost on ties; an entry is a long with 31 bits of hash above the
complement of its place (the token's number), so that a plain minimum is that rule and the place is kept. Minima are doubled in
the same way. Two texts that share k + w - 1 = 11 consecutive tokens (about 40 letters of English) share an entry's hash,
whatever stands before. The fingerprint depends on the text alone: equal texts have equal fingerprints.

Likeness is the Jaccard similarity of the selected hashes, or that of hashes with their places if it is greater (as in
texts that repeat themselves).

Edge cases: null is empty; a text under k tokens is one gram; the likeness of two empty texts is 1; a very long text is used
whole, its arrays of longs in one task's memory (about 40 bytes a code point); rows of equal doc_id follow one another by
hash of text and text, null doc_id comes first, and many such rows are dealt to several buckets by that hash; the next document of
the only one is itself; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

K, W = 4, 8  # powers of two
#: Characters that are tokens: Thai to Tibetan, Burmese, Khmer, Han and kana, symbols and the planes above the first.
ALONE = "\\u0E00-\\u0FFF\\u1000-\\u109F\\u1780-\\u17FF\\u2600-\\u27BF\\u2E80-\\uA4CF\\uF900-\\uFAFF\\x{10000}-\\x{10FFFF}"
#: Characters that end a token: all of ASCII and Latin-1 but letters, general punctuation, and letters that are in every long run but rare in prose.
ENDS = "\\x00-\\x40\\x5B-\\x60\\x7B-\\xBF\\u2000-\\u206FGJKQVXZgjkqvxz"
TOKEN = f"[{ALONE}]|[^{ALONE}{ENDS}]*+[{ENDS}]|[^{ALONE}{ENDS}]++"
PLACES = (1 << 31) - 1


def _rotate(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _rolled(by: int):
    return lambda a, b: _rotate(a, by).bitwiseXOR(b)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the array column ``out`` of entries in order of place. Every step is a column of its own, so that none is computed twice."""
    t, n = F.col(text), F.size("_c")
    ahead = lambda c, by: F.slice(c, F.lit(by + 1), F.greatest(F.size(c), F.lit(0)))
    steps, last = [("_c", F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))), ("_h1", F.transform(F.col("_c"), lambda x: F.xxhash64(x)))], "_h1"
    by = 1
    while by < K:
        steps.append((f"_h{2 * by}", F.zip_with(last, ahead(F.col(last), by), _rolled(by))))
        by, last = 2 * by, f"_h{2 * by}"
    steps.append(("_g", F.when(n >= K, F.slice(F.col(last), F.lit(1), n - (K - 1))).otherwise(F.array(F.xxhash64(t)))))
    steps.append(("_m1", F.transform(F.col("_g"), lambda x, i: x.bitwiseAND(F.lit(PLACES << 32)).bitwiseOR((F.lit(PLACES) - i).cast("long")))))
    by, last = 1, "_m1"
    while by < W:
        steps.append((f"_m{2 * by}", F.zip_with(last, ahead(F.col(last), by), lambda a, b: F.least(a, b))))
        by, last = 2 * by, f"_m{2 * by}"
    steps.append((out, F.array_distinct(F.slice(F.col(last), F.lit(1), F.greatest(F.size("_m1") - (W - 1), F.lit(1))))))
    for name, expression in steps:
        df = df.withColumn(name, expression)
    return df.drop(*[name for name, _ in steps[:-1]])


def fingerprint_string(fp: Column) -> Column:
    """Hex of the entries in order of place: hash and complement of the place, 16 digits each."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def hashes(entries: Column) -> Column:
    return F.array_distinct(F.transform(entries, lambda x: F.shiftright(x, 32)))


def with_likeness(df: DataFrame, one: str, other: str, out: str) -> DataFrame:
    """Adds the likeness of two fingerprint columns."""
    df = df.withColumn("_ha", hashes(F.col(one))).withColumn("_hb", hashes(F.col(other)))

    def jaccard(x: str, y: str, shared: str) -> Column:
        return F.col(shared) / (F.size(x) + F.size(y) - F.col(shared))

    df = df.withColumn("_n", F.size(F.array_intersect(one, other))).withColumn("_hn", F.size(F.array_intersect("_ha", "_hb")))
    return df.withColumn(out, F.greatest(jaccard(one, other, "_n"), jaccard("_ha", "_hb", "_hn"))).drop("_ha", "_hb", "_n", "_hn")


def with_buckets(documents: DataFrame, per_bucket: int = 1_000, segments: int = 100) -> tuple[DataFrame, int]:
    """Adds ord, h (hash of text), seg, bucket and part: ranges of doc_id in ascending order of about per_bucket rows, and ranges
    of h for the rows of one doc_id (or none) that are more, marked by a column cells. Also gives the number of buckets to expect.

    Quantiles cut the ids into segments, each cut evenly once more, so neither dense nor clustered ids fill one bucket.
    """
    ordered = documents.withColumn("ord", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 2))
    cuts = [F.lit((i + 1) / segments) for i in range(segments - 1)]
    found = documents.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.percentile_approx("doc_id", F.array(*cuts), F.lit(10_000)).alias("q")).collect()[0]
    lo, hi = (found.lo, found.hi) if found.lo is not None else (0, 0)
    bounds = sorted({lo, *(found.q or [])})
    parts = max(1, -(-found.n // (segments * per_bucket)))
    width = [max(1, -(-((bounds[i + 1] if i + 1 < len(bounds) else hi + 1) - b) // parts)) for i, b in enumerate(bounds)]
    starts, widths = F.array(*[F.lit(int(b)) for b in bounds]), F.array(*[F.lit(int(w)) for w in width])
    seg = F.greatest(F.size(F.filter(starts, lambda b: b <= F.col("ord"))), F.lit(1))
    ordered = ordered.withColumn("seg", seg)
    sub = F.greatest(F.expr("0L"), F.floor((F.col("ord") - F.element_at(starts, F.col("seg"))) / F.element_at(widths, F.col("seg"))))
    sub = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(sub)
    ordered = ordered.withColumn("bucket", F.col("seg").cast("long") * F.lit(1 << 40) + sub)
    often = materialise(ordered.groupBy("ord").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > per_bucket), "often")
    if often.isEmpty():
        return ordered.withColumn("part", F.lit(0).cast("long")), found.n // per_bucket + 1
    cells = often.select("ord", F.ceil(F.col("many") / per_bucket).alias("cells"))
    ordered = ordered.join(F.broadcast(cells) if cells.count() <= 100_000 else cells, "ord", "left")
    part = F.floor(F.col("h") / F.lit(float(1 << 62)) * F.col("cells")).cast("long")  # h is below 2^62; rises with it
    return ordered.withColumn("part", F.coalesce(part, F.lit(0).cast("long"))), found.n // per_bucket + 1


def in_order():
    return Window.partitionBy("bucket", "part").orderBy("real", "ord", "h", "text")


def with_next_text(documents: DataFrame, task_bytes: int = 24 << 20, per_bucket: int = 1_000) -> DataFrame:
    """(bucket, part, ord, h, real, doc_id, text, copies, next): rows with their successor; real = 1 marks the successor of a bucket's last row.

    Of the rows of a doc_id (or none) that are more than ``per_bucket``, those alike in text are one row here, with their number as copies.
    """
    docs, buckets = with_buckets(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), per_bucket)
    if "cells" in docs.columns:
        own = ["seg", "bucket", "part", "ord", "h", "doc_id", "text"]
        alike = docs.filter(F.col("cells").isNotNull()).groupBy(*own).agg(F.count(F.lit(1)).alias("copies"))
        docs = materialise(docs.filter(F.col("cells").isNull()).select(*own, F.lit(1).cast("long").alias("copies")).unionByName(alike), "alike")
    else:
        docs = docs.withColumn("copies", F.lit(1).cast("long"))
    firsts = materialise(docs.groupBy("seg", "bucket", "part").agg(F.min(F.struct("ord", "h")).alias("x")).select("seg", F.struct("bucket", "part").alias("b"), "x.ord", "x.h"), "firsts")
    ends = sorted((r.seg, r.last.bucket, r.last.part) for r in firsts.groupBy("seg").agg(F.max("b").alias("last")).collect())  # a row a segment
    before = F.lit(None).cast(firsts.schema["b"].dataType)
    for i, (seg, _, _) in enumerate(ends):
        before = F.when(F.col("seg") == seg, F.struct(F.lit(ends[i - 1][1]).cast("long").alias("bucket"), F.lit(ends[i - 1][2]).cast("long").alias("part"))).otherwise(before)
    into = firsts.select("ord", "h", F.coalesce(F.lag("b").over(Window.partitionBy("seg").orderBy("b")), before).alias("into"))
    few = firsts.count() <= 500_000
    heads = docs.select("ord", "h", "doc_id", "text").join(F.broadcast(into) if few else into, ["ord", "h"]).groupBy("into", "ord", "h", "doc_id").agg(F.min("text").alias("text"))
    rows = docs.select("bucket", "part", "ord", "h", F.lit(0).alias("real"), "doc_id", "text", "copies").unionByName(heads.select("into.bucket", "into.part", "ord", "h", F.lit(1).alias("real"), "doc_id", "text", F.lit(1).cast("long").alias("copies")))
    total = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    rows = rows.repartition(int(max(1, min(buckets, -(-total // task_bytes)))), "bucket", "part")
    return rows.withColumn("next", F.lead("text").over(in_order()))


def fingerprints_of_edits(documents: DataFrame, per_bucket: int = 1_000) -> DataFrame:
    """(doc_id, text, next, edited, fp, efp, near_edited, near_next): every text beside its edited one, whose last quarter is the next text's first."""
    rows = with_fingerprint(with_next_text(documents, per_bucket=per_bucket), "text", "fp")
    rows = rows.withColumn("after", F.lead("fp").over(in_order())).filter(F.col("real") == 0)
    # of n copies all but the last have themselves as their next
    last = F.struct(F.lit(1).cast("long").alias("many"), F.col("next").alias("next"), F.col("after").alias("after"))
    others = F.struct((F.col("copies") - 1).alias("many"), F.col("text").alias("next"), F.col("fp").alias("after"))
    turn = F.explode(F.when(F.col("copies") == 1, F.array(last)).otherwise(F.array(others, last)))
    rows = rows.select("doc_id", "text", "fp", turn.alias("turn")).select("doc_id", "text", "fp", "turn.many", "turn.next", "turn.after")
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - quarter), F.substring(F.col("next"), F.lit(1), quarter)))
    rows = with_fingerprint(rows, "edited", "efp")
    rows = with_likeness(with_likeness(rows, "fp", "efp", "near_edited"), "fp", "after", "near_next")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("many")))).drop("_copy", "many")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_of_edits(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint_string(F.col("fp")).alias("fingerprint"),
        fingerprint_string(F.col("efp")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
