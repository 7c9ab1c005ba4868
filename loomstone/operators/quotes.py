"""Known quotations inside texts, by an equi-join on word runs and then a containment test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars


def quotations(texts: DataFrame, quotes: DataFrame, run: int = 4) -> DataFrame:
    """(doc_id, item_id): texts that contain a quote, both reduced to lower-case ASCII letters and digits.

    A quote may begin and end inside a word of the text, so its key is the run of up to ``run`` words after its first one, which the text has
    as whole words. Quotes of one or two words have no such run: each of them is looked for in every text, and those quotes are
    broadcast, a bounded list of names as they are.
    """
    q = quotes.select("item_id", scalars.plain_key(F.col("text")).alias("quote")).filter("quote <> ''").withColumn("ws", F.split("quote", " "))
    q = q.withColumn("width", F.least(F.lit(run), F.size("ws") - 2))
    t = texts.select("doc_id", scalars.plain_key(F.col("text")).alias("body"))
    widths = [r[0] for r in q.filter("width >= 1").select("width").distinct().collect()]  # at most ``run``
    long = q.filter("width >= 1").select("item_id", "quote", "width", F.xxhash64("width", F.array_join(F.slice("ws", F.lit(2), F.col("width")), " ")).alias("key"))
    runs = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice(w, i, F.lit(n)), " ")))
    keys = F.transform(F.array(F.split("body", " ")), lambda w: F.array_distinct(F.concat(*[runs(w, n) for n in widths])))[0] if widths else F.array().cast("array<bigint>")
    hit = t.select("doc_id", F.explode(keys).alias("key")).join(long, "key").select("doc_id", "item_id", "quote")
    found = hit.join(t, "doc_id").filter(F.contains("body", "quote")).select("doc_id", "item_id")
    short = q.filter("width < 1").select("item_id", "quote")
    if short.isEmpty():
        return found.distinct()
    return found.unionByName(t.join(F.broadcast(short), F.contains("body", "quote")).select("doc_id", "item_id")).distinct()
