"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding disguises.

Folding: lower case; compatibility forms (NFKC); look-alike letters of other scripts to Latin; digits to the letters they stand
for; @ $ ! | between letters and before a word likewise. A 1 is read as i and as l. In a text with at most three marked letters those
are also read without their marks; where marks are usual they tell words apart. An entry of the lexicon is a word stem that matches at the start of a word.
A match inside an exception phrase doesn't count. The weights of a document's matches are summed and normalised
by its length; a logistic curve fitted on training rows turns sum and density into a score.

The lexicon is learned: stems whose documents are toxic far more often than others, counted after near copies of training
rows (the same least shingle hash) are taken once. The fit reads at most about ``max_rows`` labelled rows.

Edge cases: null or empty text scores like a text without matches; ties and repeated rows get equal scores, whatever their doc_id,
null too; a very long text is matched whole, in time in proportion to its length; other columns are not read; without
training rows every score is 0.05; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_sample, map_arrow, mix, slices, table

# Look-alikes of Latin letters (Cyrillic, then Greek), and digits and signs read as letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a", "ł": "l", "ø": "o",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
INVISIBLE = {0x200B: None, 0x200C: None, 0x200D: None, 0x2060: None, 0xFEFF: None, 0x00AD: None}
#: Harmless phrases around words that are often insults.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "trash collection", "clown fish", "clown car", "pond scum", "soap scum", "sore loser", "stupid question")

FOLD = {ord(k): v for k, v in (LOOKALIKES | DIGITS).items()} | INVISIBLE
SIGN = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])|(?<![^\s(\[\"'])[@$!|](?=[^\W\d_])")
MARKED = re.compile(r"[\u00c0-\u024f\u1e00-\u1eff]")
ONE = re.compile(r"1(?=[^\W\d_])|(?<=[^\W\d_])1")
WORD = re.compile(r"[^\W\d_]+")


class _Plain(dict):
    """Letters with marks to the letters alone, made as they are asked for."""

    def __missing__(self, code: int) -> int:
        bare = unicodedata.normalize("NFD", chr(code))[0]
        self[code] = ord(bare) if code > 127 and bare.isascii() and bare.isalpha() else code
        return self[code]


PLAIN = _Plain()


def readings(text: str | None) -> list[str]:
    """The folded text, and other readings of one length: a 1 beside a letter as an l; the few marked letters of a text that has at most three as plain."""
    if not text:
        return [""]
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if any(s in text for s in SIGNS):
        text = SIGN.sub(lambda m: SIGNS[m[0]], text)
    out = [text.translate(FOLD)]
    if ONE.search(text):
        out.append(ONE.sub("l", text).translate(FOLD))
    if 0 < len(MARKED.findall(text)) <= 3:
        out.append(text.translate(PLAIN).translate(FOLD))
    return out


def fold(text: str | None) -> str:
    return readings(text)[0]


class ToxicLexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, curve: tuple[float, float, float] | None = None):
        self.weights, self.curve = dict(weights), curve
        self.exceptions = tuple(fold(e) for e in exceptions)
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for phrase in self.exceptions:
                a.add_word(phrase, (len(phrase), None))
            for stem, w in self.weights.items():
                a.add_word(stem, (len(stem), w))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def _matches(self, folded: str) -> tuple[list[tuple[int, int, float]], list[tuple[int, int]]]:
        found, spared = [], []
        for end, (n, w) in self.automaton().iter(folded):
            start = end - n + 1
            if start and folded[start - 1].isalpha():
                continue
            if w is None:
                if end + 1 == len(folded) or not folded[end + 1].isalpha():
                    spared.append((start, end))
            else:
                found.append((start, end, w))
        return found, spared

    def mass(self, text: str | None) -> tuple[float, int]:
        """Sum of the weights of matches outside exceptions, and the number of words."""
        both = readings(text)
        folded = both[0]
        words = len(folded.split())
        if not self.weights or not words:
            return 0.0, words
        found, spared = self._matches(folded)
        for reading in both[1:]:
            other, also = self._matches(reading)
            found, spared = list({*found, *other}), list({*spared, *also})
        if spared:
            # both in order of start; the spans that began so far reach to the greatest of their ends
            found.sort()
            spared.sort()
            kept, reach, k = [], -1, 0
            for f in found:
                while k < len(spared) and spared[k][0] <= f[0]:
                    reach, k = max(reach, spared[k][1]), k + 1
                if f[1] > reach:
                    kept.append(f)
            found = kept
        return sum(f[2] for f in found), words

    @staticmethod
    def features(mass: float, words: int) -> tuple[float, float, float]:
        return 1.0, math.log1p(mass), math.log1p(1000 * mass / (words + 20))

    def score(self, text: str | None) -> float:
        if not self.curve:
            return 0.05
        z = sum(a * b for a, b in zip(self.curve, self.features(*self.mass(text)), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def fit_curve(self, rows: list[tuple[float, int, int]], ridge: float = 0.02, steps: int = 50) -> None:
        """rows: (mass, words, label). Newton steps for the ridge-penalised logistic likelihood."""
        x = np.array([self.features(m, n) for m, n, _ in rows])
        y = np.array([r[2] for r in rows], np.float64)
        b = np.zeros(3)
        pull = np.diag([1e-6, ridge, ridge]) * len(rows) * 0.01
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            g = x.T @ (p - y) + pull @ b
            h = (x * (p * (1 - p))[:, None]).T @ x + pull + 1e-9 * np.eye(3)
            d = np.linalg.solve(h, g)
            b -= d
            if np.abs(d).max() < 1e-6:
                break
        self.curve = tuple(float(v) for v in b)


def choose_stems(terms: list[tuple[str, int, int]], toxic: int, clean: int, min_docs: int = 4, precision: float = 0.8) -> dict[str, float]:
    """terms: (stem, toxic documents, clean documents). Shortest stems that stay precise win over the words they begin."""
    chosen: dict[str, float] = {}
    base = math.log((toxic + 1) / (clean + 1))
    scored = []
    for stem, t, c in terms:
        if t < min_docs or t < precision * (t + c):
            continue
        weight = math.log((t + 0.5) / (c + 0.5)) - base
        if weight > 2:
            scored.append((-t / (1 + 4 * c), len(stem), stem, t, weight))
    for _, _, stem, t, weight in sorted(scored):
        if any(stem.startswith(p) or p.startswith(stem) for p in chosen):
            continue
        chosen[stem] = round(weight, 6)
    return chosen


def _near_key(words: list[str]) -> int:
    """The least hash of the five-word shingles: near copies mostly share it."""
    if not words:
        return 0
    h = np.array([int.from_bytes(w.encode()[:8].ljust(8, b"\0"), "little") + len(w) for w in words], np.uint64)
    h = mix(h)
    k = max(1, len(h) - 4)
    s = np.zeros(k, np.uint64)
    for j in range(min(5, len(h))):
        s += h[j : j + k] * np.uint64(2 * j + 0x9E3779B97F4A7C15)
    return int(mix(s).min().view(np.int64))


def fit_lexicon(documents: DataFrame, labels: DataFrame, max_rows: int = 16_000, min_stem: int = 4, max_stem: int = 16) -> ToxicLexicon:
    """Learns from (doc_id, text) and (doc_id, toxic); the caller passes training rows only."""
    spark = documents.sparkSession
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # of two labels the greater
    n = known.count()
    known = known.filter(in_sample("doc_id", max_rows, n))
    rows = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most about max_rows ids

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            keys, sets = [], []
            for text in batch.column(1).to_pylist():
                found = WORD.findall(fold(text))
                keys.append(_near_key(found))
                sets.append(sorted(set(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.string()))], names=["doc_id", "toxic", "k", "words"])

    kind = labels.schema["toxic"].dataType.simpleString()
    each = map_arrow(rows, words, f"doc_id long, toxic {kind}, k long, words array<string>")
    once = each.groupBy("k").agg(F.min(F.struct("doc_id", "toxic", "words")).alias("r")).select("r.toxic", "r.words")

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for toxic, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[int(toxic == 1)].update({w[:k] for w in ws for k in range(min_stem, min(max_stem, len(w)) + 1)})
                counts[int(toxic == 1)][""] += 1
        terms = list(counts[0].keys() | counts[1].keys())
        for i in range(0, len(terms), 50_000):
            part = terms[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[1][t] for t in part], pa.int64()), pa.array([counts[0][t] for t in part], pa.int64())], names=["stem", "t", "c"])

    terms = map_arrow(once, stems, "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    found = [(r.stem, r.t, r.c) for r in terms.filter((F.col("stem") == "") | ((F.col("t") >= 4) & (F.col("t") >= 4 * F.col("c")))).collect()]  # bounded by the sample
    toxic, clean = next(((t, c) for s, t, c in found if not s), (0, 0))
    lexicon = ToxicLexicon(choose_stems([x for x in found if x[0]], toxic, clean))
    if not toxic or not clean:
        return lexicon
    shipped = spark.sparkContext.broadcast(lexicon)

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shipped.value
        for batch in slices(batches, "text", 1 << 20):
            got = [lex.mass(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), batch.column(2)], names=["mass", "words", "toxic"])

    lexicon.fit_curve([(r.mass, r.words, int(r.toxic == 1)) for r in map_arrow(rows, masses, f"mass double, words long, toxic {kind}").collect()])  # three numbers a sampled row
    return lexicon


def score_toxicity(documents: DataFrame, lexicon: ToxicLexicon, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    shipped = documents.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the fit's sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shipped.value
        for batch in slices(batches, "text", 1 << 20):
            scores = [lex.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = map_arrow(documents.select("doc_id", "text"), run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _held():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = fit_lexicon(documents, table(spark, sf_dir, "labels").filter(~_held()))
    return score_toxicity(documents, lexicon).select("doc_id", _held().alias("held_out"), "score", "predicted")
