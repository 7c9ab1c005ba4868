r"""Language-model scores by a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Tokens are runs without white space, A-Z lower-cased, and one end a text. The model's outcomes are the end, the ``words`` most
frequent words and ``classes`` classes of all other words, by a hash of their last three characters. The score of an outcome w behind the
outcomes u, v is ``(A[u] + B[v]) . Q[w] + b[w]``. A word of a class has the class's probability times (c + 0.1) / (n + 0.1 * (v + 1)) with
the word's training count c and the class's n tokens and v words, unseen words sharing one place, so probabilities sum to 1 exactly.

- Counts: every training text is counted; the counts of all words are one distributed table.
- Training: one pass over every training text in ``rounds`` rounds. Each task starts a round from the shared parameters and runs minibatches
  of NCE with noise drawn from the outcomes' frequencies; rows of parameters are then averaged, weighted by how often a task used them, block
  by block in a distributed sum. Only parameters, whose size is fixed by the options, reach the driver.
- Scoring: as contexts add up, the normaliser of every context is one matrix product, ``exp(A Q') exp(B Q' + b)'``, made once a process.
- Words outside the ``frequent`` ones, a bounded dictionary chosen by a histogram of counts, get their counts by a join. None of these words is hot.

Edge cases: null and empty texts are one end; null doc_id belongs to the training side; rows with equal doc_id are separate rows; a text
without a training corpus scores by an untrained model; a very long text is scored whole; other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialise, slices, table, text_bytes
from .language import held_out

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END, TAIL = "\n", 3  # no word holds white space
PRIOR = 0.1
CACHE = 200_000
BLOCK = 64


def tokens_of(batch: pa.RecordBatch, column: int) -> Iterator[list[bytes]]:
    """The words of each row's text, as UTF-8."""
    raw, offsets = text_bytes(batch.column(column))
    folded = raw.tobytes().translate(FOLD)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield folded[a:b].split()


def class_of(word: bytes, classes: int) -> int:
    tail = word[-TAIL:]
    return zlib.crc32(tail if tail.isascii() else word.decode()[-TAIL:].encode()) % classes


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) of all words of the column text and of the end, one a row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(seen.items())
            for i in range(0, len(items), 50_000):
                part = items[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()).cast(pa.string()), pa.array([n for _, n in part], pa.int64())], names=["word", "n"])
            seen.clear()

        for batch in slices(batches, "text", 1 << 20):
            for words in tokens_of(batch, 0):
                seen.update(words)
            seen[END.encode()] += batch.num_rows
            if len(seen) > 2 * CACHE:
                yield from flush()
        yield from flush()

    return map_arrow(texts.select("text"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Frequent words with counts, most frequent first, and totals of all others by class."""

    def __init__(self, frequent: list[tuple[str, int]], ends: int, tokens: int, types: int, per_class: dict[int, tuple[int, int]], words: int, classes: int):
        """per_class: tokens and types of every class over all words, shortlisted ones too, but not the end."""
        frequent = sorted(frequent, key=lambda x: (-x[1], x[0]))
        self.ends, self.tokens, self.types, self.classes = ends, tokens, types, classes
        self.short = [w.encode() for w, _ in frequent[:words]]
        self.frequent = [w.encode() for w, _ in frequent]
        self.counts = np.array([n for _, n in frequent], np.float64)
        totals = np.zeros((classes, 2))
        for k, pair in per_class.items():
            totals[k] = pair
        for w, n in frequent[:words]:
            totals[class_of(w.encode(), classes)] -= (n, 1)
        self.class_log = np.log10(totals[:, 0] + PRIOR * (totals[:, 1] + 1))
        self.outcome_counts = np.concatenate([[ends], self.counts[: len(self.short)], totals[:, 0]])
        self.base_log = math.log10(tokens + PRIOR * (types + 1))

    @property
    def outcomes(self) -> int:
        return 1 + len(self.short) + self.classes

    def index(self) -> tuple[dict[bytes, int], np.ndarray]:
        """Places of the frequent words, from 1, as the end is 0; the outcome of every place, behind them the classes of all other words."""
        short = len(self.short)
        rest = [1 + short + class_of(w, self.classes) for w in self.frequent[short:]]
        return {w: i for i, w in enumerate(self.frequent, 1)}, np.concatenate([np.arange(1 + short), np.array(rest, np.int64), 1 + short + np.arange(self.classes)])


def make_vocabulary(counts: DataFrame, words: int, classes: int, frequent: int) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary and the counts of all words that it doesn't hold."""
    bucket = F.floor(F.log2("n") * 16)
    marked = counts.withColumn("bucket", bucket)
    real = marked.filter(F.col("word") != END)
    room, cut = frequent, math.inf
    for row in sorted(real.groupBy("bucket").agg(F.count(F.lit(1)).alias("types")).collect(), key=lambda r: -r.bucket):  # at most 1,024 buckets
        room -= row.types
        if room < 0:
            break
        cut = row.bucket
    chosen = real.filter(F.col("bucket") >= F.lit(cut)).select("word", "n").toArrow() if cut < math.inf else None
    listed = list(zip(chosen.column(0).to_pylist(), chosen.column(1).to_pylist(), strict=True)) if chosen is not None else []
    kind = F.pmod(F.crc32(F.right("word", F.lit(TAIL)).cast("binary")), F.lit(classes)).alias("class")
    per_class = {r["class"]: (r.n, r.types) for r in real.groupBy(kind).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()}  # one row a class
    ends = sum(r.n for r in counts.filter(F.col("word") == END).collect())
    tokens, types = ends + sum(p[0] for p in per_class.values()), (ends > 0) + sum(p[1] for p in per_class.values())
    return Vocabulary(listed, ends, tokens, types, per_class, words, classes), (real.filter(F.col("bucket") < F.lit(cut)) if cut < math.inf else real).select("word", "n")


class LogBilinear:
    """Parameters, a row an outcome and one for the start of a text: A, B (contexts), Q and b (outcomes)."""

    def __init__(self, state: dict):
        """state: dim, rows and log_noise as plain values, which is what is shipped; a process keeps its tables there too."""
        self.state, self.dim, self.rows, self.log_noise = state, state["dim"], state["rows"], state["log_noise"]
        self.outcomes = len(self.log_noise)

    @classmethod
    def fresh(cls, outcome_counts: np.ndarray, dim: int = 16, seed: int = 11) -> LogBilinear:
        noise = outcome_counts + 0.5
        log_noise = np.log(noise / noise.sum()).astype(np.float32)
        rows = (np.random.default_rng(seed).standard_normal((len(noise) + 1, 3 * dim + 1)) * 0.1).astype(np.float32)
        rows[:-1, -1], rows[-1, 2 * dim :] = log_noise, 0
        return cls({"dim": dim, "rows": rows, "log_noise": log_noise})

    def moved(self, rows: np.ndarray) -> LogBilinear:
        return LogBilinear({"dim": self.dim, "rows": rows, "log_noise": self.log_noise})

    def split(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        d = self.dim
        return rows[:, :d], rows[:, d : 2 * d], rows[:, 2 * d : 3 * d], rows[:, -1]

    def tables(self) -> tuple[np.ndarray, ...]:
        """Natural-log parts: of the token by the last outcome, by the one before it, and of the normaliser by both."""
        if "tables" not in self.state:
            a, b, q, bias = (x.astype(np.float64) for x in self.split(self.rows))
            first, second = a @ q[:-1].T, b @ q[:-1].T + bias[:-1]
            m1, m2 = first.max(1, keepdims=True), second.max(1, keepdims=True)
            norm = np.exp(first - m1) @ np.exp(second - m2).T
            self.state["tables"] = first.astype(np.float32), second.astype(np.float32), (np.log(np.maximum(norm, 1e-300)) + m1 + m2.T).astype(np.float32)
        return self.state["tables"]

    def log10(self, last: np.ndarray, before: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of outcomes behind contexts."""
        first, second, norm = self.tables()
        return (first[last, outcome].astype(np.float64) + second[before, outcome] - norm[last, before]) / math.log(10)


class Trainer:
    """Minibatch NCE from shared parameters; keeps how often each row of A, B and Q was used."""

    def __init__(self, model: LogBilinear, rate: float, noise: int, seed: int, batch: int = 512):
        self.model, self.rate, self.noise, self.batch = model, rate, noise, batch
        self.rows = model.rows.copy()
        self.used = np.zeros((len(self.rows), 3))
        self.squares = np.full((len(self.rows), 3), 10, np.float32)  # so that first steps are no leaps
        self.rng = np.random.default_rng(seed)
        self.cdf = np.cumsum(np.exp(model.log_noise.astype(np.float64)))
        self.offset = model.log_noise + np.float32(math.log(noise))

    def _climb(self, k: int, part: np.ndarray, ids: np.ndarray, gradient: np.ndarray) -> None:
        """Adds gradients, summed by id, to the rows of a part of the parameters, at Adagrad's rate for the row."""
        order = np.argsort(ids.astype(np.int16) if len(part) < 1 << 15 else ids, kind="stable")
        listed = ids[order]
        first = np.flatnonzero(np.concatenate([[True], listed[1:] != listed[:-1]]))
        rows, total = listed[first], np.add.reduceat(gradient[order], first, axis=0)
        self.squares[rows, k] += np.einsum("ij,ij->i", total, total) / total.shape[1]
        part[rows] += (self.rate / np.sqrt(self.squares[rows, k]))[:, None] * total
        self.used[rows, k] += np.diff(np.append(first, len(ids)))

    def step(self, last: np.ndarray, before: np.ndarray, outcome: np.ndarray) -> None:
        a, b, q, bias = self.model.split(self.rows)
        noise = np.minimum(np.searchsorted(self.cdf, self.rng.random(self.noise) * self.cdf[-1]), self.model.outcomes - 1)
        context, target, false = a[last] + b[before], q[outcome], q[noise]
        up = 1 / (1 + np.exp(np.minimum(np.einsum("ij,ij->i", context, target) + bias[outcome] - self.offset[outcome], 60)))
        down = context @ false.T + (bias[noise] - self.offset[noise])
        np.minimum(np.negative(down, out=down), 60, out=down)
        np.reciprocal(np.add(np.exp(down, out=down), 1, out=down), out=down)
        pull = up[:, None] * target - down @ false
        push = np.empty((len(outcome) + len(noise), self.model.dim + 1), np.float32)  # of Q and b
        push[: len(outcome), :-1], push[: len(outcome), -1] = up[:, None] * context, up
        push[len(outcome) :, :-1], push[len(outcome) :, -1] = -(down.T @ context), -down.sum(0)
        self._climb(0, a, last, pull)
        self._climb(1, b, before, pull)
        self._climb(2, self.rows[:, 2 * self.model.dim :], np.concatenate([outcome, noise]), push)

    def feed(self, last: np.ndarray, before: np.ndarray, outcome: np.ndarray) -> None:
        """Trains on tokens in a shuffled order."""
        order = self.rng.permutation(len(outcome))
        for i in range(0, len(order), self.batch):
            at = order[i : i + self.batch]
            self.step(last[at], before[at], outcome[at])


def contexts(outcome: np.ndarray, ends: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The outcome before each, and the one before that, within texts that stop behind ``ends``."""
    heads = np.concatenate([[0], ends[:-1]])
    last, before = np.roll(outcome, 1), np.roll(outcome, 2)
    last[heads] = start
    before[heads] = start
    second = heads[ends - heads > 1] + 1
    before[second] = start
    return last, before


def places_of(batch: pa.RecordBatch, column: int, known: dict[bytes, int], classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """The places of a batch's tokens, texts on end; where each text ends; where the words are that aren't known, and those words."""
    texts = list(tokens_of(batch, column))
    ends = np.cumsum([len(t) + 1 for t in texts])
    words = list(itertools.chain.from_iterable(texts))
    found = np.fromiter(map(known.get, words, itertools.repeat(-1)), np.int64, len(words))
    rare = np.flatnonzero(found < 0)
    listed = [words[i] for i in rare.tolist()]
    found[rare] = np.fromiter((class_of(w, classes) for w in listed), np.int64, len(listed)) + len(known) + 1
    inner = np.ones(len(words) + len(texts), bool)
    inner[ends - 1] = False
    places = np.zeros(len(inner), np.int64)
    places[inner] = found
    return places, ends, np.flatnonzero(inner)[rare], listed


def train_model(texts: DataFrame, vocabulary: Vocabulary, dim: int = 16, noise: int = 64, rounds: int = 4, rate: float = 0.2, trainer_tokens: int = 16_000_000, buffer: int = 1 << 17) -> LogBilinear:
    """One pass over the column text. A round has a task for each core, or more, so that a task's share of all rounds is about ``trainer_tokens``."""
    spark = texts.sparkSession
    sc = spark.sparkContext
    model = LogBilinear.fresh(vocabulary.outcome_counts, dim)
    cores = max(1, sc.defaultParallelism)
    tasks = cores * math.ceil(max(1, vocabulary.tokens) / (trainer_tokens * cores))
    words = sc.broadcast(vocabulary.index())
    classes, width = vocabulary.classes, 3 * dim + 1
    turn = F.pmod(F.xxhash64("text", F.lit(0x11)), F.lit(rounds))
    for r in range(rounds):
        shared = sc.broadcast(model.state)

        def train(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            trainer, (known, outcome) = Trainer(LogBilinear(shared.value), rate / (1 + r), noise, part * rounds + r), words.value
            start, held, size = trainer.model.outcomes, [], 0

            def flush() -> None:
                nonlocal held, size
                if held:
                    trainer.feed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0

            for batch in slices(batches, "text", 1 << 20):
                places, ends, _, _ = places_of(batch, 0, known, classes)
                ids = outcome[places]
                held.append((*contexts(ids, ends, start), ids))
                size += len(ids)
                if size >= buffer:
                    flush()
            flush()
            if trainer.used.any():
                for k in range(0, len(trainer.rows), BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), *[pa.array([x[k : k + BLOCK].astype(t).tobytes()], pa.binary()) for x, t in ((trainer.rows, np.float32), (trainer.used, np.float64))]], names=["block", "part", "rows", "used"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for block, rows, used in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    w = np.frombuffer(used.as_buffer(), np.float64).reshape(-1, 3)
                    by = np.repeat(w[:, [0, 1, 2, 2]], [dim, dim, dim, 1], axis=1)
                    x = np.frombuffer(rows.as_buffer(), np.float32).reshape(-1, width) * by
                    sums[block] = [s + y for s, y in zip(sums[block], (x, by), strict=True)] if block in sums else [x, by]
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *[pa.array([s[k].tobytes() for s in sums.values()], pa.binary()) for k in (0, 1)]], names=["block", "rows", "used"])

        share = texts.select("text").filter(turn == r).coalesce(tasks)
        parts = map_arrow(share, train, "block int, part int, rows binary, used binary")
        means = map_arrow(parts.repartition("block").sortWithinPartitions("block", "part"), average, "block int, rows binary, used binary")
        rows = model.rows.copy()
        for row in means.collect():  # the parameters
            total, used = (np.frombuffer(x, np.float64).reshape(-1, width) for x in (row.rows, row.used))
            old = model.rows[row.block : row.block + BLOCK]
            rows[row.block : row.block + BLOCK] = np.where(used > 0, total / np.maximum(used, 1), old)
        model = model.moved(rows)
        shared.unpersist()
    return model


def score_texts(documents: DataFrame, vocabulary: Vocabulary, rare: DataFrame, model: LogBilinear) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row. rare: the counts of the words that the vocabulary doesn't hold."""
    sc = documents.sparkSession.sparkContext
    short, classes = len(vocabulary.short), vocabulary.classes
    places, outcome = vocabulary.index()
    # by place: the outcome, log10(c + 0.1) where it is known here, and the log10 of what a word is within its outcome
    frequency = np.concatenate([[math.log10(vocabulary.ends + PRIOR)], np.log10(vocabulary.counts + PRIOR), np.zeros(classes)])
    inside = np.where(outcome > short, frequency - vocabulary.class_log[np.maximum(outcome - 1 - short, 0)], 0.0)
    shipped = sc.broadcast((model.state, places, outcome, frequency, inside))
    ends_known, base_log = int(vocabulary.ends > 0), vocabulary.base_log

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, known, outcome, frequency, inside = shipped.value
        model, part, row = LogBilinear(state), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", 1 << 19):
            places, ends, rare_at, rare_words = places_of(batch, 1, known, classes)
            n, ids = np.diff(ends, prepend=0), outcome[places]
            doc = np.repeat(np.arange(len(n)), n)
            total = lambda x, doc=doc, n=n: np.bincount(doc, x, len(n))
            values = model.log10(*contexts(ids, ends, model.outcomes), ids) + inside[places]
            cuts = np.searchsorted(rare_at, np.concatenate([[0], ends])).astype(np.int32)
            rare_list = pa.ListArray.from_arrays(pa.array(cuts), pa.array(rare_words, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pa.array((part << 40) + row + np.arange(len(n))), batch.column(0), pa.array(n), pa.array((n - np.diff(cuts) - (1 - ends_known)).astype(np.int64)), pa.array(total(frequency[places]) - n * base_log), pa.array(total(values)), rare_list],
                names=["_row", "doc_id", "n_tokens", "n_known", "base_score", "score", "_rare"],
            )
            row += len(n)

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = materialise(map_arrow(documents.select("doc_id", "text"), score, f"_row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, _rare array<string>"), "scored")
    each = scored.select("_row", F.explode("_rare").alias("word")).join(rare, "word")
    found = each.groupBy("_row").agg(F.count(F.lit(1)).alias("_known"), F.sum(F.log10(F.col("n") + PRIOR)).alias("_log"))
    whole = scored.select("_row", "doc_id", "n_tokens", "n_known", "base_score", "score", F.size("_rare").alias("_size")).join(found, "_row", "left")
    more = F.coalesce("_known", F.lit(0))
    rest = F.coalesce("_log", F.lit(0.0)) + (F.col("_size") - more) * math.log10(PRIOR)
    return whole.select("doc_id", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + rest).alias("base_score"), (F.col("score") + rest).alias("score"))


def score_documents(documents: DataFrame, training: DataFrame, words: int = 1024, classes: int = 512, frequent: int = 1 << 17, **options) -> DataFrame:
    """Learns from the column text of training and scores documents; ``options`` go to ``train_model``."""
    counts = materialise(count_words(training), "word_counts")
    vocabulary, rare = make_vocabulary(counts, words, classes, frequent)
    return score_texts(documents, vocabulary, rare, train_model(training, vocabulary, **options))


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(documents, documents.filter(~held_out(0, 10)))
    return scored.select("doc_id", held_out(0, 10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
