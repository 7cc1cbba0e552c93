from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from larkspur.operators import sampling
from larkspur.operators.sampling import bottom_k
from larkspur.plans import experiment


def plain(ids, size, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))[:size]


@pytest.mark.parametrize("total,size,bits", [(1, 1, 14), (50, 50, 14), (5000, 1, 14), (5000, 7, 14), (5000, 4999, 14), (5000, 2500, 3), (5000, 40, 0), (3000, 2000, 30)])
def test_equals_plain(spark, monkeypatch, total, size, bits):
    monkeypatch.setattr(sampling, "RANGE_BITS", bits)
    rows = spark.range(total).select((F.col("id") * 7 - 300).alias("review_id"), F.lit("x").alias("review")).repartition(5)
    got = bottom_k(rows, size, 7, "review_id")
    assert got.columns == ["review_id", "review", "seq"]
    assert [r.review_id for r in sorted(got.collect(), key=lambda r: r.seq)] == plain([i * 7 - 300 for i in range(total)], size, 7)
    assert sorted(r.seq for r in got.collect()) == list(range(size))


def test_equals_the_list(spark, monkeypatch):
    rows = spark.range(4000).withColumnRenamed("id", "review_id")
    listed = {(r.review_id, r.seq) for r in experiment.seeded_sample(rows, 500, 3).collect()}
    monkeypatch.setattr(experiment, "LISTED", 10)
    assert {(r.review_id, r.seq) for r in experiment.seeded_sample(rows, 500, 3).collect()} == listed


def test_edges(spark):
    rows = spark.range(5).withColumnRenamed("id", "review_id")
    assert bottom_k(rows, 0, 1, "review_id").columns == ["review_id", "seq"] and bottom_k(rows, 0, 1, "review_id").count() == 0
    with pytest.raises(ValueError, match="fewer than 6"):
        bottom_k(rows, 6, 1, "review_id")
    repeated = spark.range(100).select(F.lit(4).alias("review_id"))
    assert sorted(r.seq for r in bottom_k(repeated, 30, 1, "review_id").collect()) == list(range(30))


def test_a_large_sample_is_no_one_task(spark):
    rows = spark.range(0, 400_000, 1, 8).withColumnRenamed("id", "review_id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = bottom_k(rows, 200_000, 1, "review_id")
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 200_000 and max(sizes) < 100_000
    assert got.select(F.countDistinct("seq"), F.min("seq"), F.max("seq")).first()[:] == (200_000, 0, 199_999)
