"""Folders that the driver and all executors see, for what is written on the way."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_owned: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all tasks run in the driver's own process, a folder of our own.

    On a cluster a folder of one machine would lose or hide what others wrote, so an unset one is an error there.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="larkspur-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def scratch_path(spark: SparkSession, name: str, end: str = "") -> str:
    """A new path in the shared folder; what is left there goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/larkspur-{name}-{uuid.uuid4().hex}{end}"
    _owned.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a table in the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _owned[:] = [x for x in _owned if x[1] != path]


@atexit.register
def _sweep() -> None:
    for spark, path in list(_owned):
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
