"""A ledger of replies: what has been answered is committed task by task and never asked for again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.operators.joins import join_side
from larkspur.operators.responder import Responder, respond
from larkspur.sources.shared import drop_path, scratch_path

#: Requests of a batch: what a crash of all tasks can cost at most.
BATCH = 1000
_ENTRY = "digest string, response string, status string, error string, asked_at timestamp"


def request_digest(requests: DataFrame, keys: tuple[str, ...]) -> Column:
    """What makes a request the same request: names, values and absences of its fields. Null without a prompt."""
    fields = F.struct(*[F.col(f"`{c}`") for c in keys])
    return F.when(F.col("prompt").isNotNull(), F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256))


class Ledger:
    """A folder with a Parquet folder for each batch; what a finished task of one has written counts, whatever becomes of the batch.

    Tasks commit their files one by one, each by a rename of a whole file, so a run that is killed leaves no half of one,
    and loses the replies of the tasks under way alone.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _found(self, pattern: str) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where)
        return sorted(x.getPath().toString() for x in found or [])

    def entries(self) -> DataFrame:
        """digest, response, status, error, asked_at: for each request its latest entry, one that went well before one that failed."""
        # a task's files lie beside the folder of those that are not committed
        folders = sorted({p.rsplit("/", 1)[0] for p in self._found("batch-*/part-*")})
        rows = self.spark.read.schema(_ENTRY).parquet(*folders) if folders else self.spark.createDataFrame([], _ENTRY)
        entry = F.struct((F.col("status") == "ok").alias("well"), "asked_at", "response", "status", "error")
        return rows.groupBy("digest").agg(F.max(entry).alias("e")).select("digest", "e.response", "e.status", "e.error", "e.asked_at")

    def add(self, rows: DataFrame) -> None:
        rows = rows.select("digest", "response", "status", "error", F.current_timestamp().alias("asked_at"))
        rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.path}/batch-{uuid.uuid4().hex}")

    def compact(self) -> None:
        """One folder of the latest entries in place of all: for ledgers of very many batches. It may be killed at any time, but not run beside `respond_once`."""
        old = self._found("batch-*")
        self.entries().select(*[x.split()[0] for x in _ENTRY.split(", ")]).write.parquet(f"{self.path}/batch-{uuid.uuid4().hex}")
        for path in old:
            drop_path(self.spark, path)


def respond_once(
    requests: DataFrame, make: Callable[[], Responder], ledger: Ledger, keys: tuple[str, ...] | None = None, tasks: int = 8, pause: float = 0.0, spacing: float = 0.0, batch: int = BATCH, retry: tuple[str, ...] = ("http", "network", "other"),
) -> DataFrame:
    """`requests` with response, status and error, each different request asked for once, whatever happens to the run.

    Requests are the same if they agree in `keys`, without which that is all columns but review_id, seq and variant. What
    the ledger has is left out, and so is what failed but for the statuses of `retry`; the rest is asked for in batches of
    about `batch` requests, dealt by digest to `tasks` tasks. What a task has asked is committed when it ends: a run that
    is started again asks for what is missing, and a crash costs the calls of the tasks under way, at most those of one
    batch. The result is read from the ledger, so reading it again asks nobody. A row without a prompt fails as no_prompt.
    """
    keys = keys or tuple(c for c in requests.columns if c not in ("review_id", "seq", "variant", "variant_ord"))
    spark = requests.sparkSession
    named = requests.withColumn("_digest", request_digest(requests, keys))
    settled = ledger.entries().where(~F.col("status").isin(*retry)).select(F.col("digest").alias("_digest"))
    # one row for each different request
    todo = named.where("_digest IS NOT NULL").groupBy("_digest").agg(F.any_value(F.struct(*[F.col(f"`{c}`") for c in keys])).alias("r")).join(settled, "_digest", "left_anti")
    path = scratch_path(spark, "requests")
    todo.select(F.col("_digest").alias("digest"), "r.*").write.parquet(path)
    waiting = spark.read.parquet(path)
    parts = -(-waiting.count() // batch)
    if parts > 1:  # a folder for each batch, so that each is read alone
        dealt = scratch_path(spark, "batches")
        waiting.withColumn("_part", F.pmod(F.xxhash64("digest"), F.lit(parts))).repartition("_part").write.partitionBy("_part").parquet(dealt)
        drop_path(spark, path)
        path, waiting = dealt, spark.read.parquet(dealt)
    for k in range(parts):
        some = waiting.where(F.col("_part") == k).drop("_part") if parts > 1 else waiting
        ledger.add(respond(some, make, tasks, pause, spacing))
    drop_path(spark, path)
    known = ledger.entries().select(F.col("digest").alias("_digest"), "response", "status", "error")
    out = join_side(named, known, "_digest")
    missing = F.col("_digest").isNull()
    said = "the row has no prompt"
    return out.select(
        *[F.col(f"`{c}`") for c in requests.columns], F.when(missing, f"ERROR: {said}").otherwise(F.col("response")).alias("response"),
        F.when(missing, "no_prompt").otherwise(F.col("status")).alias("status"), F.when(missing, said).otherwise(F.col("error")).alias("error"),
    )
