"""Weak-label quality classifier: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer.

Labellers vote good, bad or nothing on each text. Votes are counted by pattern over all documents (at most
3 ** labellers patterns, so the counts fit the driver at any size), and EM over the counts estimates how often each
labeller gives each vote on good and on bad texts, and how many are good. The patterns' posteriors label a bounded
sample, on which a linear model over hashed word shapes is trained; it scores every text, also where labellers say
nothing. No labels of people are used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm.shared import read_table, rows_in_chunks, through_arrow
from larkspur.llm.toxicity import Ftrl, sigmoid

BITS = 16
#: Documents that the scorer is trained on, at most: a bound at any size of the input.
TRAIN_ROWS, EPOCHS = 6_000, 4
KEEP_FROM = 0.5
EM_STEPS, EM_STILL = 200, 1e-7

#: Frequent short words of English, German, French and Spanish.
STOP = frozenset("the of and to in is that it was for on are as with at this der die und in den von zu das mit sich des auf für ist im le la les de et des un une du en que est pour dans el los las que y se por con una es al".split())
_SYMBOL = re.compile(r"[#$%&*|@^~<>{}\\]")


def _facts(text: str, words: list[str]) -> dict[str, float]:
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    return {
        "n": n,
        "symbol": sum(map(bool, map(_SYMBOL.search, words))) / n,
        "repeat": sum(map(str.__eq__, words, words[1:])) / n,
        "different": len(set(words)) / n,
        "stop": sum(map(STOP.__contains__, map(str.lower, words))) / n,
        "length": (len(text) - text.count(" ")) / n,
        "ended": sum(x.rstrip()[-1] in '.!?"»”' for x in lines) / max(1, len(lines)),
        "upper": sum(map(str.isupper, words)) / n,
    }


def _vote(value: float, bad: bool, good: bool) -> int:
    return 0 if bad else 1 if good else -1


#: Labellers: name and vote (1 good, 0 bad, -1 nothing) from a text's facts.
LABELLERS = {
    "symbols": lambda f: _vote(f["n"], f["symbol"] > 0.1, f["symbol"] < 0.02),
    "stutter": lambda f: _vote(f["n"], f["repeat"] > 0.1, f["n"] >= 20 and f["repeat"] < 0.04),
    "variety": lambda f: _vote(f["n"], f["n"] >= 30 and f["different"] < 0.25 * min(1.0, 400 / f["n"]), 30 <= f["n"] and f["different"] > 0.45 * min(1.0, 200 / f["n"]) ** 0.5),
    "stop words": lambda f: _vote(f["n"], f["n"] >= 15 and f["stop"] < 0.08, f["n"] >= 15 and f["stop"] > 0.15),
    "word length": lambda f: _vote(f["n"], f["length"] > 14 or f["length"] < 2.5, 3.5 < f["length"] < 9),
    "line ends": lambda f: _vote(f["n"], f["ended"] < 0.3, f["ended"] > 0.7),
    "capitals": lambda f: _vote(f["n"], f["n"] >= 10 and f["upper"] > 0.4, f["upper"] < 0.15),
}


def votes(text: str | None) -> list[int]:
    """A vote of each labeller; texts without words are bad by all."""
    words = text.split() if text else []
    if not words:
        return [0] * len(LABELLERS)
    f = _facts(text, words)
    return [vote(f) for vote in LABELLERS.values()]


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, values) of word shapes, pairs of them, first letters of words and repetitions: roots of shares."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    ids = np.fromiter(map(_shapes.__getitem__, words), np.uint64, len(words))
    again = np.fromiter(map(str.__eq__, words, words[1:]), bool, len(words) - 1)
    with np.errstate(over="ignore"):
        pairs = (ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        all_ids = np.concatenate([ids, pairs, np.full(int(again.sum()), 0x5DEECE66D1234567, np.uint64)])
    at, n = np.unique((all_ids >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    return at, np.sqrt(n / len(words))


class _Classes(dict):
    """What stands for a character in a shape, by code point: a for lower case, A for capitals, 9 for digits, else itself."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = shown = "a" if c.islower() else "A" if c.isupper() else "9" if c.isdecimal() else c
        return shown


_classes, _run = _Classes(), re.compile(r"(.)\1{2,}")


class _Shapes(dict):
    """Hashes of words' shapes: letters a, capitals A, digits 9, runs cut at three; frequent words stand for themselves."""

    def __missing__(self, word: str) -> int:
        if word.lower().strip(".,;:!?\"'") in STOP:
            shape = "=stop"
        else:
            shape = _run.sub(r"\1\1\1", word.translate(_classes))
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(shape)
        return h


_shapes = _Shapes()
_CACHE = ("quality", _shapes.clear)


def voted(docs: DataFrame) -> DataFrame:
    """row columns doc_id, votes (a string of g, b and -, one letter a labeller)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in_chunks(batches, 1):
            out = ["".join("bg-"[v] for v in votes(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "votes"])

    return through_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, votes string", *_CACHE)


def estimate(patterns: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over pattern counts: (posterior of good by pattern, rates by labeller, class and vote, share of good).

    Votes are independent given the class; estimates are smoothed; it starts from the share of good votes, so that
    good is the class that most labellers call good.
    """
    v = np.array([["bg-".index(c) for c in p] for p in patterns])
    shown = np.eye(3)[v][:, :, :2]  # patterns, labellers, votes bad and good; saying nothing tells nothing
    good, cast = (v == 1).sum(axis=1), (v != 2).sum(axis=1)
    post = np.clip(np.where(cast > 0, good / np.maximum(1, cast), 0.5), 0.02, 0.98)
    for _ in range(EM_STEPS):
        mass = np.stack([counts * (1 - post), counts * post])
        acc = np.einsum("cp,plv->lcv", mass, shown) + 0.5
        acc /= acc.sum(axis=2, keepdims=True)
        prior = (mass[1].sum() + 1) / (counts.sum() + 2)
        log = np.einsum("plv,lcv->pc", shown, np.log(acc)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        moved, post = np.abs(new - post).max(), new
        if moved < EM_STILL:
            break
    return post, acc, float(prior)


def train(docs: DataFrame, posterior: dict[str, float], total: int, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, weights) of a logistic model fitted to the posteriors on at most `rows` different texts, by one task in a fixed order.

    Texts are chosen by their hash and equal ones count once, so that copies neither crowd the sample nor leave it empty.
    """
    lesson = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("turn", F.pmod(F.xxhash64("text", F.lit(4)), F.lit(1 << 30)))
    lesson = lesson.where(F.col("turn") < int((1 << 30) * min(1.0, 1.2 * rows / max(1, total)))).dropDuplicates(["text"])
    lesson = lesson.select("turn", "text").orderBy("turn", "text").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(1 << BITS, alpha=0.5, l1=0.3, l2=0.05), []
        for batch in rows_in_chunks(batches, 1):
            seen += [(*features(t), posterior["".join("bg-"[v] for v in votes(t))]) for t in batch.column(1).to_pylist()]
        for _ in range(EPOCHS):
            for at, x, p in seen:
                model.learn(at, x, p)
        w = model.weights(np.arange(len(model.z)))
        keep = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int32)), pa.array(w[keep])], ["i", "w"])

    found = through_arrow(lesson.sortWithinPartitions("turn", "text"), run, "i int, w double", *_CACHE).toPandas()  # at most 2 ** BITS weights
    return found.i.to_numpy().astype(np.int64), found.w.to_numpy()


def score_quality(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, votes, posterior, score, kept for every row of `docs` (doc_id, text, ...).

    score is the linear model's, posterior the labellers'; kept is whether their mean is `keep_from` or more, so that
    neither alone drops a text. Both depend on the whole text alone, however long it is, so equal texts tie in all
    columns. Null and empty texts are bad by all labellers; repeated rows and null ids are scored each; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    counts = voted(docs).groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3 ** labellers rows
    schema = "doc_id long, votes string, posterior double, score double"
    if not counts:
        return spark.createDataFrame([], f"{schema}, kept boolean")
    post, _, _ = estimate([r.votes for r in counts], np.array([r.n for r in counts], dtype=float))
    posterior = {r.votes: float(p) for r, p in zip(counts, post, strict=True)}
    index, value = train(docs, posterior, sum(r.n for r in counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << BITS) + 1)
        table[index] = value
        for batch in rows_in_chunks(batches, 1):
            out = []
            for text in batch.column(1).to_pylist():
                at, x = features(text)
                v = "".join("bg-"[k] for k in votes(text))
                out.append((v, posterior[v], sigmoid(table[-1] + float(table[at] @ x))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.float64(), pa.float64()), strict=True))], ["doc_id", "votes", "posterior", "score"])

    scored = through_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema, *_CACHE)
    return scored.withColumn("kept", (F.col("posterior") + F.col("score")) / 2 >= keep_from)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"))


QUERIES = {"op4_quality": op4_quality}
ORACLES: dict[str, str] = {}
