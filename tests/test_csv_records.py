from __future__ import annotations

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from larkspur.sources import records, tables


@pytest.fixture
def small_splits(spark):
    for key, value in (("maxPartitionBytes", "256"), ("openCostInBytes", "8")):
        spark.conf.set(f"spark.sql.files.{key}", value)
    yield spark
    for key in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{key}")


def some_rows(seed, n):
    rng = random.Random(seed)
    text = lambda most: "".join(rng.choice('ab,"\n\r ü') for _ in range(rng.randrange(most)))
    return [[str(i), rng.choice(["007", "1e3", "Ann", "a,b", '"', " x "]), rng.choice(["1", "4.7", "five", ""]), text(60) if rng.random() < 0.95 else "\n\"q\",\n" * 120] for i in range(n)]


def write(path, head, rows, end="\r\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerows([head, *rows])


HEAD = ["ReviewId", "ReviewerName", "Rating", "Review"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_in_many_tasks(small_splits, tmp_path, end):
    rows = some_rows(1, 250)
    write(tmp_path / "x.csv", HEAD, rows, end)
    got = records.read_cells(small_splits, str(tmp_path / "x.csv"))
    assert got.columns == [*HEAD, "number"] and small_splits.read.text(str(tmp_path / "x.csv")).rdd.getNumPartitions() > 20
    assert [[c or "" for c in r[:4]] for r in sorted(got.collect(), key=lambda r: r.number)] == rows
    assert sorted(r.number for r in got.collect()) == list(range(250))


def test_several_files_and_empty_ones(small_splits, tmp_path):
    rows = some_rows(2, 90)
    (tmp_path / "x.csv").mkdir()
    for name, low, high in (("a", 0, 5), ("b", 5, 5), ("c", 5, 70), ("d", 70, 90)):
        write(tmp_path / "x.csv" / f"{name}.csv", HEAD, rows[low:high], "\n")
    (tmp_path / "x.csv" / "e.csv").write_text("\n\n")
    got = records.read_cells(small_splits, str(tmp_path / "x.csv"))
    assert [[c or "" for c in r[:4]] for r in sorted(got.collect(), key=lambda r: r.number)] == rows
    write(tmp_path / "x.csv" / "f.csv", HEAD[::-1], [], "\n")
    with pytest.raises(ValueError, match="different headers"):
        records.read_cells(small_splits, str(tmp_path / "x.csv"))
    (tmp_path / "none.csv").write_text("")
    assert records.read_cells(small_splits, str(tmp_path / "none.csv")).columns == ["number"]


def test_odd_headers(small_splits, tmp_path):
    (tmp_path / "x.csv").write_text('a,,"b, c",A,number\n1,2,3,4,5\n6\n')
    got = records.read_cells(small_splits, str(tmp_path / "x.csv"))
    assert got.columns == ["a0", "_c1", "b, c", "A3", "number4", "number"]
    assert sorted(tuple(r) for r in got.collect()) == [("1", "2", "3", "4", "5", 0), ("6", None, None, None, None, 1)]


def test_lines_step_as_a_csv_reader_does():
    cases = {'a,b': False, '"a': True, '"a"': False, '"a""': True, '"a"",b': True, 'a"b,c': False, ',"x': True, '"a","b': True, '"",""': False, "": False}
    for line, after in cases.items():
        assert records.inside_after(line, False) == after, line
    for line, after in {"x": True, 'x"': False, 'x""': True, 'x"",y': True, 'x","': True, 'x",y': False, '"': False, '""': True}.items():
        assert records.inside_after(line, True) == after, line


def test_names_and_ratings_of_a_sheet(small_splits, tmp_path):
    write(tmp_path / "s.csv", HEAD, [["12", "007", "4.7", "ok"], ["13.0", "1e3", "five", 'say ""hi""'], ["", "true", "", ""]])
    got = [tuple(r) for r in tables.read_sheet(small_splits, str(tmp_path / "s.csv")).orderBy(F.col("review_id").asc_nulls_last()).collect()]
    assert got == [(12, "007", 4, "ok"), (13, "1e3", None, 'say ""hi""'), (None, "true", None, None)]


def test_result_in_ordered_parts(small_splits, tmp_path):
    rng = random.Random(3)
    rows = [(v, i, "AB"[v], 1000 - i, f'N"{i}', rng.randrange(1, 6), rng.choice([None, "x", "a,\nb"]), rng.choice(["ok", "two\nlines", 'q"', "ERROR: z"])) for v in (0, 1) for i in range(150)]
    df = small_splits.createDataFrame(rows, "variant_ord int, seq int, variant string, review_id long, reviewer_name string, rating int, review string, response string").repartition(5)
    tables.write_result(df, str(tmp_path / "out"), parts=6)
    files = sorted(p for p in (tmp_path / "out").glob("part-*"))
    assert len(files) > 3
    whole = "".join(p.read_text(encoding="utf-8") for p in files)
    assert whole.count("variant,review_id") == 1 and whole.startswith("variant,review_id,reviewer_name,rating,review,response\n")
    parsed = list(csv.reader(whole.splitlines(keepends=True)))[1:]
    assert [r[0] + r[1] for r in parsed] == [r[2] + str(r[3]) for r in rows]
    back = [tuple(r) for r in tables.read_result(small_splits, str(tmp_path / "out")).orderBy("seq").collect()]
    assert back == [(*r[2:], k) for k, r in enumerate(rows)]
    manifest = sorted((json.loads(x) for p in (tmp_path / "out" / "_manifest").glob("part-*") for x in p.read_text().splitlines()), key=lambda m: m["part"])
    assert [m["part"] for m in manifest] == [p.name for p in files] and sum(m["rows"] for m in manifest) == 300
    assert all(a["first_row"] + a["rows"] == b["first_row"] for a, b in zip(manifest, manifest[1:], strict=False))
    tables.write_result(df.limit(0), str(tmp_path / "none"))
    assert tables.read_result(small_splits, str(tmp_path / "none")).count() == 0


def test_other_splits_are_an_error(small_splits, tmp_path):
    write(tmp_path / "x.csv", HEAD, some_rows(5, 100))
    rows, _ = records.records(small_splits, str(tmp_path / "x.csv"))
    assert rows.count() == 101
    small_splits.conf.set("spark.sql.files.maxPartitionBytes", "100")
    with pytest.raises(Exception, match="other blocks"):
        rows.count()
