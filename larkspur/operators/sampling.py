"""Repeatable samples of any size: the rows of the smallest hashes, numbered, without one list or one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

#: log2 of the ranges of hashes that a sample is numbered in, about: counts of so many, and some more, reach the driver.
RANGE_BITS = 14


def seeded_hash(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def bottom_k(rows: DataFrame, size: int, seed: int, key: str) -> DataFrame:
    """The `size` rows of the smallest hash of seed and key, numbered from 0 in `seq` by (hash, key); fewer rows are an error.

    Hashes are cut into ranges by their leading bits, as many bits as let the sample lie in about 2 ** RANGE_BITS of them
    whatever share of the rows it is. One aggregation counts the rows of each range at the lower end: the counts add up
    to the sample's last range and to the number that each range begins with, so a window over each range alone numbers
    its rows, and rows above the last range are never shuffled. Keys are ids: rows of one key fall into one range.
    """
    total = rows.count()
    if total < size:
        raise ValueError(f"fewer than {size} rows to sample from")
    if not size:
        return rows.withColumn("seq", F.lit(0)).where(F.lit(False))
    # 60 bits of the hash; a range is its leading bits
    number = F.conv(F.substring(seeded_hash(seed, key), 1, 15), 16, 10).cast("long")
    bits = min(60, max(0, RANGE_BITS + math.floor(math.log2(total / size))))
    bucket = F.coalesce(F.shiftright(number, 60 - bits), F.lit(0))
    upto = min(1 << bits, math.ceil(size / total * (1 << bits) * 1.1) + 8)
    while True:
        counts = dict(rows.select(bucket.alias("b")).where(F.col("b") < upto).groupBy("b").count().collect())
        if sum(counts.values()) >= size or upto == 1 << bits:
            break
        upto = min(1 << bits, 2 * upto)
    starts, before = [], 0
    for b in sorted(counts):
        if before >= size:
            break
        starts.append((b, before))
        before += counts[b]
    first = F.broadcast(rows.sparkSession.createDataFrame(starts, "_bucket long, _first long"))
    chosen = rows.withColumn("_hash", seeded_hash(seed, key)).withColumn("_bucket", bucket).where(F.col("_bucket") <= starts[-1][0]).join(first, "_bucket")
    at = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", key)) - 1 + F.col("_first")
    return chosen.withColumn("seq", at).where(F.col("seq") < size).drop("_bucket", "_hash", "_first")
