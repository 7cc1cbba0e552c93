"""CSV files whose cells may hold line ends, read in many tasks a file: an index of blocks tells where records begin.

Whether a line begins inside a quoted cell depends on all lines before it. But a block of lines only ever turns one state
(outside or inside quotes) into another, so a first pass gives for each block what it turns each state into, and how many
records begin in it then; putting these together in order of the blocks gives each block its true state and the number
of its first record. The second pass cuts the lines into records; only records that cross a block's end are put together
by a shuffle. A block is what Spark reads as one split of a file; its row in the index is all that reaches the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Cells are taken as they are: with their white space; quotes in them are doubled.
CELLS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def inside_after(line: str, inside: bool) -> bool:
    """Whether the line's end is in a quoted cell. A cell is quoted if its first character is a quote; others hold quotes as they are."""
    at = 0
    while True:
        if not inside and not line.startswith('"', at):
            at = line.find(",", at) + 1
            if not at:
                return False
            continue
        if not inside:
            at += 1
        at = line.find('"', at)
        while at >= 0 and line.startswith('"', at + 1):
            at = line.find('"', at + 2)
        if at < 0:
            return True
        inside, at = False, line.find(",", at + 1) + 1
        if not at:
            return False


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield (file, block), line


class Index:
    """By (file, block): whether it begins inside a cell, the number of the record begun last before it, that of its first header or 0, and that of its first row.

    Rows are numbered from 0 over the files in order of their names; the first record of each file, or of the first one
    alone, is a header, and headers are numbered from -1 down.
    """

    def __init__(self, lines: DataFrame, each_file: bool = True) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks: dict[tuple[str, int], list] = {}
            for key, line in _by_block(batches):
                ways = blocks.setdefault(key, [[False, 0], [True, 0]])  # by the state that the block begins in
                for way in ways:
                    way[1] += not way[0] and line not in ("", "\r")
                    if '"' in line:  # else the state stays
                        way[0] = inside_after(line, way[0])
            if blocks:
                out = [(*key, *outside, *inside) for key, (outside, inside) in blocks.items()]
                kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["file", "block", "after_out", "n_out", "after_in", "n_in"])

        found = lines.mapInArrow(run, "file string, block long, after_out boolean, n_out long, after_in boolean, n_in long").collect()
        self.blocks: dict[tuple[str, int], tuple[bool, int, int, int]] = {}
        self.files: dict[str, list[int]] = {}  # first row and rows of each file, in order
        number, last, inside, file, heads = 0, 0, False, None, 0
        for r in sorted(found, key=lambda r: (r.file, r.block)):
            if r.file != file:
                # a cell does not cross files
                file, inside, self.files[r.file], waiting = r.file, False, [number, 0], each_file or not heads
            n, head = r.n_in if inside else r.n_out, 0
            if n and waiting:
                waiting, heads = False, heads + 1
                head = -heads
            self.blocks[r.file, r.block] = inside, last, head, number
            rows = n - (head < 0)
            number, self.files[file][1] = number + rows, self.files[file][1] + rows
            last = number - 1 if rows else head if n else last
            inside = r.after_in if inside else r.after_out


def records(spark: SparkSession, path: str, each_file: bool = True) -> tuple[DataFrame, Index]:
    """(number, record) of every record of the files, numbered as `Index` says, and the index.

    Empty lines between records are none. The files must not change, nor the session's split size, between this call and
    reading: a block that the index does not know is an error. Unless the session says how many splits a read has at
    least, it is told the present parallelism, as the splits would otherwise change with executors that come and go.
    """
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    lines = _lines(spark, path)
    index = Index(lines, each_file)
    known = spark.sparkContext.broadcast(index.blocks)  # a row a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, here, held, cut, inside = 0, None, [], False, False
        mine = head = number = 0

        def close(open_end: bool) -> None:
            nonlocal size, held
            if held:
                text = "\n".join(held)
                out.append((mine, here[1], cut or open_end, text))
                size += len(text) + 32
            held = []

        for key, line in _by_block(batches):
            if key != here:
                if here is not None:
                    close(inside)
                if key not in known.value:
                    raise ValueError(f"{key[0]} is split in other blocks than those that were indexed")
                here = key
                inside, mine, head, number = known.value[key]
                cut = inside  # the first lines belong to a record of an earlier block
            if not inside:
                close(False)
                cut = False
                if line in ("", "\r"):
                    continue
                if head:
                    mine, head = head, 0
                else:
                    mine, number = number, number + 1
            held.append(line)
            if '"' in line:
                inside = inside_after(line, inside)
            if size > 4 << 20:
                yield _pieces(out)
                out, size = [], 0
        if here is not None:
            close(inside)
        if out:
            yield _pieces(out)

    pieces = lines.mapInArrow(run, "number long, block long, part boolean, record string")
    whole = pieces.where("NOT part").select("number", "record")
    crossing = pieces.where("part").groupBy("number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda x: x["record"]), "\n").alias("record"))
    return whole.unionByName(crossing).select("number", F.regexp_replace("record", "\r\\z", "").alias("record")), index


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["number", "block", "part", "record"])


def cells(record: Column, names: list[str], **options: str) -> Column:
    """The record's cells as a struct of texts."""
    return F.from_csv(record, F.lit(_ddl(names)), CELLS | {"mode": "PERMISSIVE", "lineSep": "\x00", "maxCharsPerColumn": "-1"} | options)


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)


def read_cells(spark: SparkSession, path: str, each_file: bool = True, **options: str) -> DataFrame:
    """The files' cells as texts under their header's names, and `number`, the row's place from 0 over all files.

    Each file has a header, the same in all, or with `each_file` unset the first file alone; without any there are no
    columns but `number`. A column without a name is called _c and its place; repeated names, and one
    called number, get their places behind them.
    """
    rows, _ = records(spark, path, each_file)
    found = [r[0] for r in rows.where("number < 0").select("record").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"the files of {path} have different headers")
    if not found:
        return spark.createDataFrame([], "number long")
    most = found[0].count(",") + 1  # cells at most
    head = list(spark.createDataFrame([(found[0],)], "record string").select(cells(F.col("record"), [f"c{i}" for i in range(most)]).alias("c")).first().c)
    width = max((i + 1 for i, n in enumerate(head) if n is not None), default=1)
    many = Counter(["number", *(n.lower() for n in head[:width] if n is not None)])
    names = [f"_c{i}" if n is None else f"{n}{i}" if many[n.lower()] > 1 else n for i, n in enumerate(head[:width])]
    return rows.where("number >= 0").select(cells(F.col("record"), names, **options).alias("c"), "number").select("c.*", "number")
