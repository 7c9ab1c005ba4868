"""Language identification by known words, backing off to ever shorter character n-grams.

A word seen in training scores its smoothed log frequency in each language. An unseen word is cut into
character n-grams with boundary marks: from each position the longest known n-gram of at most ``max_n``
characters counts, and each step of backing off costs a constant factor.

The text's language is that of the greatest mean posterior over its words, which is the score.

Edge cases: text that is null, empty or has no letter (numerals like ½ or Ⅷ are none) is ``und`` with score 0. Ties go to the
language first in code-point order. Repeated rows get equal results, null doc_id too. A very long text is read whole. Other columns
are kept or not read. With an empty training table all is ``und``; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import count_floor, discard, in_sample, keep_rows, map_arrow, materialise, slices, table

RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased. The pattern's runs may hold numerals that are no digits; those end a word."""
    found = RUN.findall(text.lower())
    if text.isascii() or "".join(found).isalpha():
        return found
    out = []
    for run in found:
        out += [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()
    return out


class LanguageModel:
    """Word and n-gram log frequencies, one row of ``scores`` for each known unit."""

    def __init__(self, languages: list[str], words: dict[str, int], grams: dict[str, int], word_scores: np.ndarray, gram_scores: np.ndarray, max_n: int, cache: int = 200_000):
        self.languages, self.words, self.grams = languages, words, grams
        self.word_scores, self.gram_scores = word_scores, gram_scores
        self.max_n, self.cache_size = max_n, cache
        self.cache: dict[str, np.ndarray] = {}
        self._known: np.ndarray | None = None
        self._backed_off: np.ndarray | None = None

    @classmethod
    def fit(cls, counts: list[tuple[str, str, int]], max_n: int = 4, min_count: int = 2, alpha: float = 0.5) -> LanguageModel:
        """counts: (language, word, occurrences) of the training rows."""
        languages = sorted({c[0] for c in counts})
        at = {lang: i for i, lang in enumerate(languages)}
        n = len(languages)
        words: dict[str, list[int]] = {}
        for lang, word, c in counts:
            words.setdefault(word, [0] * n)[at[lang]] += c
        grams: dict[str, list[int]] = {}
        for word, c in words.items():
            marked = f"^{word[:64]}$"
            for size in range(1, max_n + 1):
                for i in range(len(marked) - size + 1):
                    if g := grams.get(marked[i : i + size]):
                        for k in range(n):
                            g[k] += c[k]
                    else:
                        grams[marked[i : i + size]] = list(c)
        kept = {w: c for w, c in words.items() if sum(c) >= min_count}

        def logs(units: dict[str, list[int]], orders: np.ndarray | None = None) -> np.ndarray:
            x = np.array(list(units.values()), np.float64).reshape(len(units), n)
            if orders is None:
                return np.log(x + alpha) - np.log(x.sum(0) + alpha * max(1, len(x)))
            out = np.empty_like(x)
            for size in np.unique(orders):
                m = orders == size
                out[m] = np.log(x[m] + alpha) - np.log(x[m].sum(0) + alpha * m.sum())
            return out

        sizes = np.array([len(g) for g in grams], np.int64)
        return cls(languages, {w: i for i, w in enumerate(kept)}, {g: i for i, g in enumerate(grams)}, logs(kept), logs(grams, sizes) if grams else np.zeros((0, n)), max_n)

    def unseen(self, word: str) -> np.ndarray:
        """Mean over positions of the longest known n-gram, centred so that languages are comparable."""
        if self._backed_off is None:  # an n-gram's cost of backing off is its length's, so it is charged once
            self._backed_off = self.gram_scores * np.array([0.4 ** (self.max_n - len(g)) for g in self.grams], np.float64).reshape(-1, 1)
        marked, found, get = f"^{word[:64]}$", [], self.grams.get
        last = len(marked)
        for i in range(last - 1):
            for end in range(min(i + self.max_n, last), i, -1):
                k = get(marked[i:end])
                if k is not None:
                    found.append(k)
                    break
        return np.add.reduce(self._backed_off.take(found, 0), 0) / len(found) if found else np.zeros(len(self.languages))

    @staticmethod
    def _softmax(scores: np.ndarray) -> np.ndarray:
        p = np.exp(scores - scores.max(-1, keepdims=True))
        return p / p.sum(-1, keepdims=True)

    def known_posteriors(self) -> np.ndarray:
        if self._known is None:
            self._known = self._softmax(self.word_scores)
        return self._known

    def posteriors(self, words: list[str]) -> np.ndarray:
        """One row for each of distinct words; those that are new are softened together."""
        new = [w for w in words if w not in self.cache]
        if new:
            if len(self.cache) + len(new) > self.cache_size:
                self.cache.clear()
                new = words
            self.cache.update(zip(new, self._softmax(np.array([self.unseen(w) for w in new])), strict=True))
        return np.array([self.cache[w] for w in words])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages:
            return "und", 0.0
        words = words_of(text) if text else []
        if not words:
            return "und", 0.0
        get = self.words.get
        at = np.array([get(w, -1) for w in words])
        known = at[at >= 0]
        share = self.known_posteriors()[known].sum(0) if len(known) else np.zeros(len(self.languages))
        if len(known) < len(words):
            times = Counter(words[i] for i in np.flatnonzero(at < 0).tolist())
            parts = np.array(list(times.values()), np.float64).reshape(-1, 1) * self.posteriors(list(times))
            share = np.add.reduce(np.concatenate([share.reshape(1, -1), parts]), 0)
        share = share / len(words)
        best = int(np.argmax(share))
        return self.languages[best], float(min(1.0, max(0.0, share[best])))


def fit_language_model(documents: DataFrame, max_rows: int = 6_000, max_n: int = 4, min_count: int = 2, max_words: int = 2_000_000) -> LanguageModel:
    """Fits on text and lang of at most about ``max_rows`` distinct rows, drawn by the hash of (doc_id, text); their whole texts are read.

    At most ``max_words`` words and languages reach the driver, the most frequent ones: if there are more, the count that a word needs
    is raised from ``min_count`` to the least power of two that leaves so many.
    """
    labelled = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = labelled.select("lang").count()
    sample = labelled.filter(in_sample(("doc_id", "text"), max_rows, n)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, Counter()).update(words_of(text))
        for lang, c in by.items():
            items = list(c.items())
            for i in range(0, len(items), 20_000):
                part = items[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([w for w, _ in part]), pa.array([k for _, k in part], pa.int64())], names=["lang", "word", "n"])

    counts = map_arrow(sample, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialise(counts.filter(F.col("n") >= min_count), "language_words")
    rows = [(r.lang, r.word, r.n) for r in counts.filter(F.col("n") >= count_floor(counts, "n", max_words)).toLocalIterator()]
    discard(counts)
    return LanguageModel.fit(sorted(rows), max_n, min_count)


def identify_language(documents: DataFrame, model: LanguageModel, id_column: str = "doc_id") -> DataFrame:
    """Adds nothing to the input: returns (id, lang_pred, score) for every row."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in slices(batches, "text", 1 << 20):
            got = [m.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[id_column, "lang_pred", "score"])

    kind = documents.schema[id_column].dataType.simpleString()
    return map_arrow(documents.select(id_column, "text"), predict, f"`{id_column}` {kind}, lang_pred string, score double")


def keep_identified(documents: DataFrame, model: LanguageModel, min_score: float) -> DataFrame:
    """The rows of documents whose language is known with at least min_score, columns as they are."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def test():
        m = shipped.value

        def known(text: str | None) -> bool:
            lang, score = m.predict(text)
            return lang != "und" and score >= min_score

        return lambda ids, texts: [known(t) for t in texts]

    return keep_rows(documents, test)


def held_out(remainder: int, modulus: int = 5):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit_language_model(documents.filter(~held_out(0)).select("doc_id", "text", "lang"))
    found = identify_language(documents, model)
    return found.select("doc_id", held_out(0).alias("held_out"), "lang_pred", "score")
