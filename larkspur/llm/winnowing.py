"""Document fingerprints by winnowing, and how they change when half a document is replaced by its neighbour's text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm.shared import partitions_of, read_table, rows_in_chunks, through_arrow

#: Code points in a k-gram, and k-grams in a window: any passage of GRAM + SPAN - 1 code points that two texts share
#: leaves one equal hash in both fingerprints; no passage shorter than GRAM does. Short texts have shorter windows.
GRAM = 20
SPAN = 100
_POS = 24
_SEGMENT = 1 << (_POS - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(points: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit rolling polynomial hash of every `gram` code points; two runs of m give one of 2 m."""
    unit = (points.astype(np.uint64) + np.uint64(1)) * _MIX
    power, run, size, out, have, shift = _BASE, unit, 1, None, 0, gram
    with np.errstate(over="ignore"):
        while shift:
            if shift & 1:
                if out is None:
                    out, have = run, size
                else:
                    n = len(points) - have - size + 1
                    out, have = out[:n] * power + run[have : have + n], have + size
            shift >>= 1
            if shift:
                n = len(points) - 2 * size + 1
                run, size, power = run[:n] * power + run[size : size + n], 2 * size, power * power
        out = out ^ out >> np.uint64(29)
        out = out * _MIX
        return out ^ out >> np.uint64(32)


def _window_minima(keys: np.ndarray, span: int) -> np.ndarray:
    low, size = keys, 1
    while 2 * size <= span:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    return low if size == span else np.minimum(low[: len(keys) - span + 1], low[span - size :])


def span_for(grams: int, gram: int) -> int:
    """The window for a text of `grams` k-grams: SPAN, an eighth of a short text, and no more k-grams than half of the text holds.

    Of two windows the longer one's minima are minima of the shorter one, so texts of different windows still meet.
    """
    return max(1, min(SPAN, grams // 8, (grams - gram + 1) // 2))


def winnow(text: str, gram: int = GRAM, span: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes as uint32, positions): in every window of `span` k-grams the smallest, of equal ones the rightmost.

    Without `span` it is that of `span_for`. Texts of fewer than `span` k-grams are one window; texts shorter than a k-gram are one k-gram; an empty text has
    no fingerprint. Very long texts are worked off in overlapping segments with the same result.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    gram = min(gram, len(points))
    span = span or span_for(len(points) - gram + 1, gram)
    kept_hash, kept_pos, at = [], [], 0
    step, mask = _SEGMENT, np.uint64((1 << _POS) - 1)
    while True:
        part = points[at : at + step + span + gram - 2]
        hashes = gram_hashes(part, gram)
        keys = hashes & ~mask | (mask - np.arange(len(hashes), dtype=np.uint64))
        best = _window_minima(keys, min(span, len(keys)))
        chosen = best[np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))]
        pos = (mask - (chosen & mask)).astype(np.int64)
        kept_hash.append((hashes[pos] >> np.uint64(32)).astype(np.uint32))
        kept_pos.append(pos + at)
        if at + step + span + gram - 2 >= len(points):
            break
        at += step
    pos, first = np.unique(np.concatenate(kept_pos), return_index=True)
    return np.concatenate(kept_hash)[first], pos


def as_string(hashes: np.ndarray, positions: np.ndarray) -> str:
    """16 hexadecimal digits for each chosen k-gram: 8 of its hash, 8 of its position."""
    return np.column_stack([hashes.astype(">u4"), positions.astype(">u4")]).astype(">u4").tobytes().hex()


def likeness(a: set, b: set) -> float:
    """Twice the shared hashes over all hashes of both; two empty fingerprints are alike."""
    return 2.0 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_following(docs: DataFrame) -> DataFrame:
    """Rows (bucket, guest, doc_id, text) sorted so that each row's next row in its bucket is the next document.

    Buckets are ranges of doc_id; the first document of each range is also a guest at the end of the range before
    (of the first: of the last), so only that one row crosses a border and no task sees more than its ranges.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("at"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * partitions_of(spark)
    # one smallest id for each range: as many numbers as there are ranges
    firsts = np.array(sorted(r[1] for r in rows.select("at").repartitionByRange(n, "at").groupBy(F.spark_partition_id()).agg(F.min("at")).collect()), dtype=np.int64)

    @F.pandas_udf("long")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(firsts, ids.to_numpy(), side="right") - 1)

    @F.pandas_udf("boolean")
    def is_first(ids: pd.Series) -> pd.Series:
        return pd.Series(np.isin(ids.to_numpy(), firsts))

    dealt = rows.withColumn("bucket", bucket_of("at")).withColumn("head", is_first("at"))
    own = F.struct("bucket", F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("bucket") - 1, F.lit(max(1, len(firsts)))).alias("bucket"), F.lit(True).alias("guest"))
    dealt = dealt.withColumn("p", F.explode(F.when(F.col("head"), F.array(own, before)).otherwise(F.array(own))))
    dealt = dealt.select("p.bucket", "p.guest", "at", "doc_id", "text")
    return dealt.repartition(partitions_of(spark), "bucket").sortWithinPartitions("bucket", "guest", "at", "text").drop("at")


def fingerprint_documents(docs: DataFrame, gram: int = GRAM, span: int | None = None) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text is
    an empty one; the next document is the next by (doc_id, text), null ids first, after the last comes the first; a
    single document follows itself. An empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bucket = None  # the row that waits for its next one
        out: list[tuple] = []
        size = 0
        for batch in rows_in_chunks(batches, 3, 8 << 20):
            for here, guest, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != bucket:
                    bucket, held = here, None
                if guest and held is None:
                    continue
                hashes, pos = winnow(text, gram, span)
                mine = set(hashes.tolist())
                if held is not None:
                    was, old, shown, had = held
                    new = edited(old, text)
                    new_hashes, new_pos = winnow(new, gram, span)
                    changed = as_string(new_hashes, new_pos)
                    out.append((was, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), shown, changed, likeness(had, set(new_hashes.tolist())), likeness(had, mine)))
                    size += len(shown) + len(changed) + 150
                held = None if guest else (doc, text, as_string(hashes, pos), mine)
                if size > 4 << 20:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    return through_arrow(with_following(docs), run, _OUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op8_winnowing": op8_winnowing}
ORACLES: dict[str, str] = {}
