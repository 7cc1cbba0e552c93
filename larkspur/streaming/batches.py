"""Folders written batch by batch by a stream, each batch exactly once however often it is tried."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from larkspur.sources.shared import drop_path


class Batches:
    """A Parquet folder with a folder for each batch of a stream, and one for all batches up to a number once they are merged.

    A batch's folder is named by the stream's checkpoint and the batch's number and written anew if the batch is tried
    again, so a restart neither loses nor doubles rows. One is read once Spark's writer has marked it as done.
    """

    def __init__(self, spark: SparkSession, path: str, checkpoint: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.stream = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def write(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{self.stream}-{number}")

    def _done(self) -> list[tuple[str, bool, int, str]]:
        """(stream, merged, number, path) of the folders that are whole."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/_SUCCESS")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where)
        paths = [x.getPath().getParent().toString() for x in found or []]
        named = [(re.search(r"/([0-9a-f]{16})-(upto-)?(\d+)$", p), p) for p in paths]
        return [(m[1], bool(m[2]), int(m[3]), p) for m, p in named if m]

    def paths(self) -> list[str]:
        """Folders to read: of each stream the latest merged one, and the batches after it."""
        done = self._done()
        upto: dict[str, int] = {}
        for stream, merged, number, _ in done:
            if merged:
                upto[stream] = max(number, upto.get(stream, -1))
        return sorted(p for stream, merged, number, p in done if number == upto.get(stream, -1) and merged or not merged and number > upto.get(stream, -1))

    def read(self, schema: str) -> DataFrame:
        paths = self.paths()
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, schema: str, combine) -> None:
        """All finished batches of this stream in one folder, by `combine`; it may be killed at any time. Not while the stream runs."""
        mine = [x for x in self._done() if x[0] == self.stream]
        if not mine:
            return
        last = max(number for _, _, number, _ in mine)
        keep = f"{self.path}/{self.stream}-upto-{last}"
        if any(merged and number == last for _, merged, number, _ in mine):
            return
        wanted = set(self.paths())
        combine(self.spark.read.schema(schema).parquet(*[p for *_, p in mine if p in wanted])).write.mode("overwrite").parquet(keep)
        for *_, p in mine:  # what the merged folder stands for is not read any more, so these can go in any order
            drop_path(self.spark, p)
