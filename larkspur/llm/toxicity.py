"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.llm.shared import read_table, rows_in_chunks, through_arrow

#: 2 ** BITS hashed features, so at most that many weights are collected and broadcast; L1 leaves a few hundred.
BITS = 22
#: Bound on the labelled rows that the model is fitted on, chosen by a hash of id and text: so many at most.
TRAIN_ROWS = 6_000
#: Steps of learning, and passes over the sample at most: passes are repeated until so many steps are made.
STEPS, MOST_PASSES = 18_000, 20
THRESHOLD = 0.7
PAIR_VALUE = 0.4
ALPHA, BETA, L2 = 1.0, 1.0, 0.02
#: L1 at TRAIN_ROWS rows; it follows the square root of the rows (half of it at least), as the noise in a coordinate's gradient sum does.
L1 = 3.0
#: Words that a Python worker remembers.
_WORDS_KEPT = 100_000
_PUNCTUATION = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„’…"


class _Vocabulary(dict):
    """Numbers of words; hashes of a word (lower case, no punctuation at its ends) and of its first letters by number."""

    def __init__(self) -> None:
        super().__init__()
        self.table, self.filled = np.empty((1024, 3), np.uint64), 0
        self.new: list[tuple[int, int, int]] = []

    def __missing__(self, raw: str) -> int:
        word = raw.lower().strip(_PUNCTUATION)
        self[raw] = n = self.filled + len(self.new)
        self.new.append(tuple(xxhash.xxh3_64_intdigest(x) for x in (word, "4" + word[:4], "5" + word[:5])))
        return n

    def of(self, words: list[str]) -> np.ndarray:
        if self.filled > _WORDS_KEPT:
            self.clear()
            self.filled = 0
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            n = self.filled + len(self.new)
            if n > len(self.table):  # doubled, as copies for every text would cost more than the texts
                self.table = np.concatenate([self.table[: self.filled], np.empty((2 * n - self.filled, 3), np.uint64)])
            self.table[self.filled : n] = self.new
            self.filled, self.new = n, []
        return self.table[ids]


@lru_cache(maxsize=1)
def _vocabulary() -> _Vocabulary:
    return _Vocabulary()


_CACHE = ("toxicity", _vocabulary.cache_clear)

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Indexes, with repeats: words and their first 4 and 5 letters in the lower half, word pairs and pairs with one or two words between in the upper half."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64)
    table = _vocabulary().of(words)
    h = table[:, 0]
    with np.errstate(over="ignore"):
        pairs = np.concatenate([h[:-1] * _A + h[1:] * _B, h[:-2] * _B + h[2:] * _C, h[:-3] * _C + h[3:] * _A]) * _A
        single = np.concatenate([h, table[:, 1], table[:, 2]]) * _A
    shift, half = np.uint64(65 - bits), np.int64(1 << bits - 1)
    return np.concatenate([(single >> shift).astype(np.int64), (pairs >> shift).astype(np.int64) + half])


def values(at: np.ndarray, bits: int = BITS) -> np.ndarray:
    """What a present feature counts: pairs less than single words, so that L1 drops pairs that add nothing."""
    return np.where(at < 1 << bits - 1, 1.0, PAIR_VALUE)


class Ftrl:
    """Follow the regularised leader, proximal, with a learning rate for each coordinate and L1 and L2 penalties."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias, without L1
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = x * (sigmoid(w @ x) - label)
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0))))


def learnable(doc_id: Column | str) -> Column:
    """Rows that labels may be learnt from; the others are held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, rows: int = TRAIN_ROWS, steps: int = STEPS, l1: float = L1) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, weights) that are not zero, the bias at 2 ** bits. Null labels and ids are left out; without labels all weights are zero.

    FTRL is sequential, so one task works through at most `rows` labelled documents in a fixed order, until it has made
    `steps` steps or MOST_PASSES passes; only sparse weights leave the task. Documents are chosen by a hash of id and
    text and equal ones are learnt from once, so that repeated ids and rows neither crowd the sample nor leave it empty.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learnable("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = docs.select("doc_id").join(known, "doc_id").count()
    if not total:
        return np.array([1 << bits]), np.zeros(1)
    turn = F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(1 << 30))
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(learnable("doc_id")).withColumn("turn", turn)
    lesson = some.where(F.col("turn") < int((1 << 30) * min(1.0, 1.2 * rows / total))).join(known, "doc_id").dropDuplicates(["doc_id", "text"])
    lesson = lesson.select("turn", "doc_id", "toxic", "text").orderBy("turn", "doc_id", "text").limit(rows)  # at most `rows`, in one task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rest = Ftrl(1 << bits, l1=l1), []
        for batch in rows_in_chunks(batches, 3):
            for label, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                rest.append((np.unique(features(text, bits)).astype(np.int32), label))
        model.l1 = l1 * max(0.5, (len(rest) / TRAIN_ROWS) ** 0.5)
        for _ in range(min(MOST_PASSES, -(-steps // max(1, len(rest))))):
            for at, label in rest:
                model.learn(at, values(at, bits), label)
        for low in range(0, len(model.z), 1 << 18):
            at = np.arange(low, min(low + (1 << 18), len(model.z)))
            w = model.weights(at)
            yield pa.RecordBatch.from_arrays([pa.array(at[w != 0].astype(np.int32)), pa.array(w[w != 0])], ["i", "w"])

    # at most 2 ** bits weights, by the size of the model
    found = through_arrow(lesson.sortWithinPartitions("turn", "doc_id", "text"), run, "i int, w double", *_CACHE).toPandas()
    return found.i.to_numpy().astype(np.int64), found.w.to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS, text_at: int = 1) -> DataFrame:
    """Appends `score` to all columns of `docs`; `text_at` is the position of its text column. A null text counts as empty."""
    index, value = model
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.float32)
        inner = index < 1 << bits
        table[index[inner]] = value[inner] * values(index[inner], bits)
        active = table != 0
        bias = float(value[~inner].sum())
        for batch in rows_in_chunks(batches, text_at):
            out = []
            for text in batch.column(text_at).to_pylist():
                at = features(text or "", bits)
                at = np.unique(at[active[at]])
                out.append(sigmoid(bias + table[at].sum(dtype=np.float64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*names, "score"])

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema) + ", score double"
    return through_arrow(docs, run, schema, *_CACHE)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bits: int = BITS, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text, ...).

    Scores depend on the text alone, on all of it however long it is; a score equal to the threshold counts as toxic.
    Null and empty texts get the bias's score; a null doc_id is not held out; repeated rows are scored each; of several
    labels of one id the highest counts; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    model = train(docs, labels, bits, rows)
    scored = score(docs.select("doc_id", "text"), model, bits)
    return scored.select("doc_id", F.coalesce(~learnable("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score below the threshold, with their columns; rows are treated as by `score_toxicity`."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = [c.lower() for c in names].index("text")
    scored = score(plain, train(docs, labels), text_at=at).where(F.col("score") < threshold)
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
