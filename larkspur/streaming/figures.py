"""The diagnostics of replies, kept up over a stream: partial sums of each batch, merged when they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from larkspur.operators import diagnostics
from larkspur.streaming.batches import Batches

_OPENINGS = "variant string, word string, n long, m long, greet long, len long, low int, high int, missing long"
_WORDS = "variant string, word string, n long"
_FIRST = "variant string, seq long, rating int, review string, response string"


class ReplyFigures:
    """A folder of partial sums: by variant and opening word, by variant and word, and each variant's first rows.

    Sums of batches are of the size of their vocabularies, not of their rows; `compact` merges them. The figures read
    are those of all replies together, whatever batches they came in. A batch that is tried again is written anew.
    """

    def __init__(self, spark: SparkSession, path: str, checkpoint: str = "") -> None:
        self.parts = {name: Batches(spark, f"{path.rstrip('/')}/{name}", checkpoint) for name in ("openings", "words", "first")}

    def add(self, replies: DataFrame, number: int) -> None:
        """Batch `number` of replies (variant, seq, rating, review, response)."""
        held = replies.persist()  # read three times; what is lost with an executor is made again
        try:
            self.parts["openings"].write(_as(diagnostics.by_opening(held), _OPENINGS), number)
            self.parts["words"].write(diagnostics.word_counts(held), number)
            self.parts["first"].write(_as(_first(held), _FIRST), number)
        finally:
            held.unpersist()

    def compact(self) -> None:
        self.parts["openings"].merge(_OPENINGS, diagnostics.merged)
        self.parts["words"].merge(_WORDS, _word_sums)
        self.parts["first"].merge(_FIRST, lambda rows: _as(_first(rows), _FIRST))

    def _openings(self) -> DataFrame:
        return diagnostics.merged(self.parts["openings"].read(_OPENINGS))

    def summary(self) -> DataFrame:
        return diagnostics.summary_of(self._openings())

    def opening_words(self, top: int = diagnostics.TOP_OPENINGS) -> DataFrame:
        return diagnostics.opening_words_of(self._openings(), top)

    def top_words(self, top: int = diagnostics.TOP_WORDS) -> DataFrame:
        return diagnostics.top_words_of(self.parts["words"].read(_WORDS), self._openings(), top)

    def samples(self) -> DataFrame:
        return diagnostics.samples(self.parts["first"].read(_FIRST))

    def report_lines(self) -> DataFrame:
        first = self.parts["first"].read(_FIRST).groupBy("variant").agg(F.min("seq").alias("first_seq"))
        return diagnostics.lines_of(self.summary(), self.opening_words(), self.top_words(), self.samples(), first)


def _as(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(*[F.col(name).cast(kind).alias(name) for name, kind in (x.split() for x in schema.split(", "))])


def _first(rows: DataFrame, most: int = diagnostics.SAMPLES) -> DataFrame:
    """The first rows of each variant by seq: those of several inputs hold the first of all."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("variant").orderBy("seq"))).where(F.col("_n") <= most).drop("_n")


def _word_sums(counts: DataFrame) -> DataFrame:
    return counts.groupBy("variant", "word").agg(F.sum("n").alias("n"))


def stream_figures(replies: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the figures in folder `path` up with a stream of replies (variant, seq, rating, review, response)."""
    figures = ReplyFigures(replies.sparkSession, path, checkpoint)
    return replies.writeStream.foreachBatch(lambda batch, number: figures.add(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
