from __future__ import annotations

import os

import duckdb
import pytest

from larkspur import queries
from larkspur.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, db, name):
    df, sql = QUERIES[name](spark, sf), db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    cols = sorted(df.columns)
    mine = sorted(repr([r[c] for c in cols]) for r in df.collect())
    theirs = sorted(repr([dict(zip(sql.columns, r, strict=True))[c] for c in cols]) for r in sql.fetchall())
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2


def test_stream_files_are_written_where_their_rows_are(spark, tmp_path):
    """More splits give more files, in two batches all the same: no shuffle into three."""
    for splits, least in ((1, 3), (8, 8)):
        path = str(tmp_path / f"s{splits}")
        queries._pieces(spark.range(1000, numPartitions=splits), 3).parquet(path)
        rows = spark.read.parquet(path)
        n = len(rows.inputFiles())
        assert rows.count() == 1000 and n >= least and n / 2 <= queries._two_thirds(rows) < n


def test_sheet_is_dealt_to_more_ranges_as_it_grows(spark, tmp_path, monkeypatch):
    """Ranges follow the session's partitions; with four at any size a task's share would grow with the table."""
    spark.range(2000).selectExpr("id AS doc_id", "repeat(md5(cast(id AS string)), 20) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    files = []
    monkeypatch.setattr(queries.tables, "read_sheet", lambda s, path, real=queries.tables.read_sheet: files.append(len(s.read.text(path).inputFiles())) or real(s, path))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ids = [r.review_id for r in queries.QUERIES["sheet_ids"](spark, str(tmp_path)).select("review_id").collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted(ids) == list(range(2000)) and files[0] > 8
