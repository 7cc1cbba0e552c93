"""Joins to side tables of one row a key: keys must be unique, and keys of very many rows are spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Keys with more than one in so many of all rows are heavy, so there are fewer heavy keys than that; tasks for each.
HEAVY_SHARE, SALTS = 1000, 64


def unique(side: DataFrame, key: str, name: str) -> DataFrame:
    """`side`, a row for each key that is not null; the job fails with the table's `name` and the key where one is repeated.

    Equal rows of one key are a repetition too. Each key's rows are counted where they are combined, before any join.
    """
    others = [c for c in side.columns if c != key]
    held = F.any_value(F.struct(*[F.col(f"`{c}`") for c in others])) if others else F.lit(None)
    by_key = side.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"), held.alias("_side"))
    fault = F.raise_error(F.concat(F.lit(f"repeated {key} in {name}: "), F.col(key).cast("string")))
    # the check is part of the key, which every reader of the table needs
    checked = F.when(F.col("_rows") == 1, F.col(key)).otherwise(fault).alias(key)
    return by_key.select(checked, *[F.col("_side")[c].alias(c) for c in others])


def join_side(rows: DataFrame, side: DataFrame, key: str, how: str = "left", heavy_share: int = HEAVY_SHARE, salts: int = SALTS) -> DataFrame:
    """`rows` with the columns of `side` (one row a key), `how` being left or inner.

    Heavy keys, of which there are fewer than `heavy_share` by their definition, are told to every task by a broadcast.
    Their rows get one of `salts` numbers by the partition that they come from, and the side's row of such a key stands
    once for each number; so a key of a third of all rows is the work of many tasks. Counting reads the key column alone.
    """
    if how not in ("left", "inner"):
        raise ValueError("a side table is joined left or inner")
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    whole = F.broadcast(counts.agg(F.sum("_n").alias("_whole")))  # one row
    heavy = F.broadcast(counts.crossJoin(whole).where(F.col("_n") * heavy_share > F.col("_whole")).select(key, F.lit(True).alias("_heavy")))
    # rows without a key meet nothing: spread by partition as well
    spread = F.when(F.col("_heavy") | F.col(key).isNull(), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(0)
    salted = rows.join(heavy, key, "left").withColumn("_salt", spread).drop("_heavy")
    copies = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    sides = side.join(heavy, key, "left").withColumn("_salt", F.explode(copies)).drop("_heavy")
    return salted.join(sides, [key, "_salt"], how).drop("_salt")
