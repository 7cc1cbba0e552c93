from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspur.operators.diagnostics import phrase_shares
from larkspur.operators.joins import join_side, unique
from larkspur.operators.validation import assemble


def tables(spark, businesses):
    reviews = spark.createDataFrame([(i, None if i == 7 else i % 3, f"R{i}", 3) for i in range(12)], "review_id int, business_id int, reviewer_name string, rating int")
    return reviews, spark.createDataFrame(businesses, "business_id int, business_name string")


def test_repeated_keys_fail_with_their_name(spark):
    reviews, businesses = tables(spark, [(0, "A"), (1, "B"), (1, "B")])
    with pytest.raises(Exception, match="repeated business_id in businesses: 1"):
        assemble(reviews, businesses).collect()
    reviews, businesses = tables(spark, [(0, "A"), (1, "B"), (None, "x"), (None, "y")])
    assert sorted(r.review_id for r in assemble(reviews, businesses).collect()) == [0, 1, 3, 4, 6, 9, 10]
    words = spark.createDataFrame([(0, ["a"]), (0, ["b"])], "business_id int, approved_keywords array<string>")
    with pytest.raises(Exception, match="repeated business_id in keywords: 0"):
        assemble(reviews, businesses, words).select("review_id").collect()
    with pytest.raises(Exception, match="repeated business_id in businesses: 1"):
        unique(tables(spark, [(1, "A"), (1, "A")])[1].select("business_id"), "business_id", "businesses").collect()


def test_heavy_keys_are_joined_whole(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 0).when(F.col("id") % 9 > 0, F.col("id")).alias("k")).repartition(7)
    side = spark.createDataFrame([(i, f"s{i}") for i in range(0, 3000, 2)], "k long, name string")
    for how in ("left", "inner"):
        want = sorted(map(str, rows.join(side, "k", how).select("id", "k", "name").collect()))
        for share, salts in ((1000, 64), (10, 5), (1, 2)):
            assert sorted(map(str, join_side(rows, side, "k", how, share, salts).select("id", "k", "name").collect())) == want
    assert join_side(rows.limit(0), side, "k").count() == 0 and join_side(rows, side.limit(0), "k").count() == 3000


def test_heavy_key_is_work_of_many_tasks(spark):
    rows = spark.range(0, 4000, 1, 16).select("id", F.lit(5).alias("k"))
    side = spark.createDataFrame([(5, "a")], "k int, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = join_side(rows, side, "k").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in sizes) == 4000 and len(sizes) > 1


def test_phrase_shares(spark):
    said = [("A", "It MEANS a lot to us, means a lot to us"), ("A", "Hope"), ("A", "ERROR: means a lot to us"), ("A", None), ("B", "ERROR"), ("C", "xx hope xx")]
    replies = spark.createDataFrame(said, "variant string, response string")
    phrases = spark.createDataFrame([(x,) for x in ("means a lot to us", "hope", "hope", "nan", "ans a", "", None, "never")], "phrase string")
    got = {(r.variant, r.phrase): (r.n, r.share) for r in phrase_shares(replies, phrases).collect()}
    assert got == {("A", "means a lot to us"): (1, 1 / 3), ("A", "hope"): (1, 1 / 3), ("A", "nan"): (1, 1 / 3), ("A", "ans a"): (1, 1 / 3), ("A", "never"): (0, 0.0)} | {("C", p): (int(p == "hope"), float(p == "hope")) for p in ("means a lot to us", "hope", "nan", "ans a", "never")}
