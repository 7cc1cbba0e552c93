"""Reply requests over a stream: the same projection as in batch, as it keeps no state; one read feeds both sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from larkspur.operators.validation import checked, with_defaults
from larkspur.plans.review_prompt import requests
from larkspur.streaming.batches import Batches


def _records(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """Records that arrive as JSON lines in folder `path`; what is no such record is in _corrupt_record."""
    reader = spark.readStream.schema(f"{schema}, _corrupt_record string")
    return (reader.option("maxFilesPerTrigger", files) if files else reader).json(path)


def _judged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return checked(with_defaults(_records(spark, path, schema)))


def _written(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_requests(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, model: str | None = None) -> StreamingQuery:
    """Requests for the valid reviews that arrive as JSON lines in folder `path`, as Parquet in folder `out`."""
    good = _judged(spark, path, schema).where("reject_reason is null").drop("reject_reason")
    return _written(request_rows(good, model), out, checkpoint)


def stream_rejects(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """The records that `stream_requests` leaves out, with reject_reason and, if they are no records, their text in _corrupt_record.

    A query of its own with its own checkpoint, so that each sink gets every record of its kind exactly once.
    """
    return _written(_judged(spark, path, schema).where("reject_reason is not null"), out, checkpoint)


def stream_both(spark: SparkSession, path: str, schema: str, good: str, bad: str, checkpoint: str, model: str | None = None, files: int | None = None) -> StreamingQuery:
    """Requests in folder `good` and rejected records in folder `bad` by one query that reads and parses each record once.

    Batches of `files` files (all that are there without it). A batch is judged, held, and written to both folders under
    its own name, see `Batches`: if the run ends between the two sinks, the restart writes that batch anew in both, so
    accepted and rejected rows add up to the records read. Read them by `read_both`.
    """
    sinks = [Batches(spark, where, checkpoint) for where in (good, bad)]

    def sink(batch: DataFrame, number: int) -> None:
        judged = checked(with_defaults(batch)).persist()  # what is lost with an executor is parsed again
        try:
            sinks[0].write(request_rows(judged.where("reject_reason is null").drop("reject_reason"), model), number)
            sinks[1].write(judged.where("reject_reason is not null"), number)
        finally:
            judged.unpersist()

    return _records(spark, path, schema, files).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_both(spark: SparkSession, good: str, bad: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(requests, rejected records) of the batches that are whole, of whatever streams; None before the first."""
    paths = [Batches(spark, where, "").paths() for where in (good, bad)]
    return tuple(spark.read.parquet(*p) if p else None for p in paths)


def request_rows(rows: DataFrame, model: str | None = None) -> DataFrame:
    return requests(rows, model) if model else requests(rows)
