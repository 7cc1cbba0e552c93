"""Readers and writers: JSON records, review sheets, result tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from larkspur.sources.records import Index, read_cells, records
from larkspur.sources.workbook import first_sheet

# Fields of the four JSON records, of the review sheet and of the result table.
BUSINESS = "business_name string"
REVIEW = "reviewer_name string, rating int, review string, ai_response_length_type string"
KEYWORDS = "approved_keywords array<string>"
SUPPORT = "signature string, contact_number string, support_email string, website_url string"
SHEET = "ReviewId long, ReviewerName string, Rating int, Review string"
RESULT = "variant string, review_id long, reviewer_name string, rating int, review string, response string"
# End of fixed values.

#: Cells are written as they are: with their white space, empty ones apart from absent ones.
WRITTEN = {"header": "true", "quote": '"', "escape": '"', "emptyValue": '""', "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a file, over any number of lines; values of another type leave the record in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line: splits within files, for large inputs."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path)


def read_optional(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """The record at the path; without a path one row of nulls."""
    if path:
        return read_json(spark, path, schema)
    return spark.range(1).select(*[F.lit(None).cast(x.strip().split(" ", 1)[1]).alias(x.strip().split(" ", 1)[0]) for x in schema.split(", ")])


def numbered_as_read(rows: DataFrame, name: str, *place: str) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... over the rows as they come, in order of the columns `place` first, which it drops.

    Within a partition rows come in order; counts by place and partition give each its first number, so that no task
    sees more than one partition. The window runs over a row for each partition and place.
    """
    mark = "_" * (1 + max((len(c) for c in rows.columns), default=0))  # no column of the caller's begins so
    at, part, n, first, base = (mark + c for c in ("at", "part", "n", "first", "base"))
    x = rows.withColumns({at: F.monotonically_increasing_id(), part: F.spark_partition_id()})
    by = [*place, part]
    starts = x.groupBy(*by).agg(F.count("*").alias(n), F.min(at).alias(first))
    before = F.sum(n).over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select(*[F.col(c).alias(f"{mark}_{c}") for c in by], first, F.coalesce(before, F.lit(0)).alias(base))
    same = [F.col(c).eqNullSafe(F.col(f"{mark}_{c}")) for c in by]
    out = x.join(starts, same).withColumn(name, F.col(base) + F.col(at) - F.col(first))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c not in place], name)


def _with_place(rows: DataFrame) -> DataFrame:
    """Adds _file and _block, where each row of files stands: for `numbered_as_read`, as partitions follow the files' sizes."""
    return rows.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")})


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """review_id, reviewer_name, rating, review from CSV, Parquet or an Excel workbook's first sheet.

    review_id is the sheet's ReviewId, or without that column the row's number from 0 in order of the files. The cells of
    CSV files have the declared types, so names stay as they are written and what is no number is null; one large file is
    the work of many tasks, whatever line ends its cells hold. A workbook is read whole by one task, as it is one file of
    bounded rows by its format.
    """
    if path.endswith(".xlsx"):
        return sheet_columns(read_workbook(spark, path))
    if path.endswith(".csv"):
        rows = read_cells(spark, path)
        number = lambda c: F.col(c).try_cast("double")
        named = rows if "ReviewId" in rows.columns else rows.withColumnRenamed("number", "ReviewId")
        return sheet_columns(named.withColumns({"Rating": number("Rating").try_cast("int"), "ReviewId": F.coalesce(F.col("ReviewId").try_cast("long"), number("ReviewId").try_cast("long"))}))
    rows = spark.read.parquet(path)
    if "ReviewId" in rows.columns:
        return sheet_columns(rows)
    return sheet_columns(numbered_as_read(_with_place(rows), "ReviewId", "_file", "_block"))


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """ReviewId, ReviewerName, Rating and Review of the first sheets of the workbooks at a path, see `first_sheets`."""
    return first_sheets(spark.read.format("binaryFile").load(path).select(F.col("path").alias("book"), "content")).drop("book")


def first_sheets(books: DataFrame) -> DataFrame:
    """book, ReviewId, ReviewerName, Rating and Review of first sheets by their head lines; `books` has book and content.

    Cells that are absent are null; without a ReviewId column a workbook's rows are numbered from 0. A workbook is the
    work of one task, as its format bounds its rows; many workbooks are that of many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = first_sheet(content)
                head = {str(x): i for i, x in enumerate(next(rows, []))}
                missing = [c for c in ("ReviewerName", "Rating", "Review") if c not in head]
                if missing:
                    raise ValueError(f"the workbook's first sheet has no column {missing[0]}")
                out: list[tuple] = []
                for n, row in enumerate(rows):
                    cell = {c: row[i] if i < len(row) else None for c, i in head.items()}
                    number = cell.get("ReviewId") if "ReviewId" in head else n
                    name = cell["ReviewerName"]
                    out.append((
                        book,
                        None if number is None else int(float(number)),
                        None if name is None else str(int(name)) if isinstance(name, float) and name.is_integer() else str(name),
                        None if cell["Rating"] is None else int(float(cell["Rating"])),
                        None if cell["Review"] is None else str(cell["Review"]),
                    ))
                    if len(out) == 4096:
                        yield _sheet_batch(out)
                        out = []
                if out:
                    yield _sheet_batch(out)

    return books.select("book", "content").mapInArrow(run, f"book string, {SHEET}")


def _sheet_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["book", *(x.split()[0] for x in SHEET.split(", "))])


def sheet_columns(rows: DataFrame) -> DataFrame:
    """A sheet's columns under the engine's names; ratings are cut to whole numbers, names are text."""
    cols = [F.col("ReviewId").cast("long").alias("review_id")] if "ReviewId" in rows.columns else []
    return rows.select(*cols, F.col("ReviewerName").cast("string").alias("reviewer_name"), F.col("Rating").cast("int").alias("rating"), F.col("Review").alias("review"))


def write_result(rows: DataFrame, path: str, parts: int | None = None) -> None:
    """The six result columns as CSV in order of (variant_ord, seq): one part or, for large results, several, whose names follow that order.

    The header stands in the first part alone, so that the parts one behind the other are one CSV file. Rows are dealt
    by ranges of their order, and each part is written by a task of its own. `_manifest`, which readers pass over, tells
    each part's first row and number of rows.
    """
    cols, spark = [x.split()[0] for x in RESULT.split(", ")], rows.sparkSession
    by = [c for c in ("variant_ord", "seq") if c in rows.columns]
    line = F.to_csv(F.struct(*cols), {k: v for k, v in WRITTEN.items() if k != "header"})
    body = rows.select(F.lit(1).alias("_body"), *by, line.alias("value"))
    kinds = dict(rows.dtypes)
    head = spark.range(1).select(F.lit(0).alias("_body"), *[F.lit(None).cast(kinds[c]).alias(c) for c in by], F.lit(",".join(cols)).alias("value"))
    order = ["_body", *by]
    all_rows = body.unionByName(head)
    dealt = all_rows.repartitionByRange(parts, *order) if parts else all_rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)
    listed = [(file.rsplit("/", 1)[-1], first, n) for file, (first, n) in result_index(spark, path).files.items()]  # a row a part
    spark.createDataFrame(listed, "part string, first_row long, rows long").coalesce(1).write.json(f"{path.rstrip('/')}/_manifest")


def result_index(spark: SparkSession, path: str) -> Index:
    return records(spark, path, each_file=False)[1]


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """The six columns and seq, the rows' order in the files. Empty cells are nulls; quotes and line ends in cells are kept."""
    rows = read_cells(spark, path, each_file=False, emptyValue="", nullValue="")
    kinds = [x.split() for x in RESULT.split(", ")]
    return rows.select(*[F.col(c).try_cast(kind).alias(c) for c, kind in kinds], F.col("number").alias("seq"))


def credential(given: str | None, variable: str) -> str:
    """The key given, else the environment's; an error if there is neither. It stays on the driver until a responder is made."""
    import os

    key = given or os.environ.get(variable)
    if not key:
        raise ValueError(f"{variable} is not set and no key was given")
    return key
