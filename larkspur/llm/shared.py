"""Shared-folder tables, Arrow helpers and connected components for the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.sources.shared import drop_path, scratch_path

#: Bytes of an Arrow batch to or from a Python stage, about; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20

class Table:
    """A DataFrame written to the shared folder: lineage ends here, and a lost executor loses no part of it."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_counted(rows: DataFrame, side: DataFrame, key: str, n: str, most: int = 1000) -> DataFrame:
    """`rows` with the columns of `side`, which has one row for each `key` and in `n` how many of `rows` have it.

    Keys with more than 1 in `most` of all rows, of which there are fewer than `most`, are broadcast; the others are
    shuffled, so that no task holds more than that share for one key. Rows without a match are kept. Both are read twice.
    """
    total = side.agg(F.sum(n)).first()[0] or 0
    heavy = F.broadcast(side.where(F.col(n) > total / most).drop(n))
    rest = rows.join(heavy.select(key), key, "left_anti").join(side.where(F.col(n) <= total / most).drop(n), key, "left")
    return rows.join(heavy, key).unionByName(rest)


def rows_in_chunks(batches: Iterable[pa.RecordBatch], text: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `most` bytes of column `text`, or one row: bounded memory with very long texts."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = n if batch.column(text).nbytes <= most else max(1, int(n * most / batch.column(text).nbytes))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def arrow_schema(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> Table:
    """Smallest node reachable from each node that has an edge: a table (node, component_id), both long.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond"),
    each two shuffles with map-side minima and no per-node lists, so a hub with very many edges is never gathered
    in one task. Each round's edges are written to the shared folder. Self-edges and nulls are ignored; an empty
    input gives no rows.
    """

    def held(rows: DataFrame) -> tuple[Table, tuple]:
        """The edges in the shared folder, with their number and a hash of all."""
        table = Table(rows, "edges")
        return table, tuple(table.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, done = held(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct())
    for _ in range(most_rounds):
        # Large star: every neighbour larger than u hangs on the smallest of u and its neighbours.
        both = now.df.union(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # every stored edge has u > v: seen from v, u is the larger neighbour
        large = now.df.join(low.select(F.col("u").alias("v"), "m"), "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()
        step = Table(large, "edges")
        # Small star: the smaller neighbours of u, and u itself, hang on the smallest of them.
        small = step.df.groupBy("u").agg(F.min("v").alias("m"))
        nxt = step.df.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old = now
        now, seen = held(nxt)
        step.drop()
        old.drop()
        if seen == done:
            break
        done = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    heads = now.df.select("v").distinct()
    out = Table(now.df.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(heads.select(F.col("v").alias("node"), F.col("v").alias("component_id"))), "components")
    now.drop()
    return out


_caches: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Memory that is free in this process goes back to the machine, where the allocators can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def use_cache(name: str, clear: Callable[[], None]) -> None:
    """Called where a Python worker starts to use an operator's word cache: those of other operators go.

    Workers are used again by later stages, so that caches, kept for speed within a stage, would add up otherwise.
    """
    stale = [k for k in _caches if k != name]
    for k in stale:
        _caches.pop(k)()
    if stale:
        gc.collect()
        give_back()
    _caches[name] = clear


def through_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, cache: str = "none", clear: Callable[[], None] = lambda: None) -> DataFrame:
    """`df.mapInArrow(run, schema)` in bounded memory: batches are cut by bytes, not by rows alone, whatever the texts' lengths.

    The worker keeps the word cache named `cache` from one task to the next and drops those of other operators, and what
    a task has freed goes back to the machine when it ends.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_cache(cache, clear)
        yield from run(batches)
        give_back()

    return df.mapInArrow(bounded, schema)
