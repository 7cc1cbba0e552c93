"""Faults of records, sheets and samples that must not pass silently."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from larkspur.functions.keywords import match_keywords, top_matching_keywords
from larkspur.operators import responder
from larkspur.operators.validation import checked, zip_single
from larkspur.plans import experiment
from larkspur.sources import shared, tables, workbook
from larkspur.streaming.requests import stream_rejects


def test_absent_required_columns_are_rejected(spark):
    rows = checked(spark.createDataFrame([(4,)], "rating int")).collect()
    assert [r.reject_reason for r in rows] == ["missing business_name"]
    rows = checked(spark.createDataFrame([("B", "R")], "business_name string, reviewer_name string")).collect()
    assert [r.reject_reason for r in rows] == ["missing rating"]


def test_unknown_tone(spark):
    rows = spark.createDataFrame([("B", "R", 4, t) for t in ("Friendly", "Grumpy", None)], "business_name string, reviewer_name string, rating int, tone string")
    assert [r.reject_reason for r in checked(rows).collect()] == [None, "unknown tone", "unknown tone"]
    with pytest.raises(ValueError, match="unknown tone"):
        experiment.builder_columns(rows, F.lit("B"), tone="Grumpy")


def test_rows_without_a_prompt_fail(spark):
    def never():
        return lambda request: "called for " + request["prompt"]

    rows = responder.respond(spark.createDataFrame([(1, None), (2, "p")], "review_id int, prompt string"), never, tasks=1).collect()
    assert {r.review_id: (r.status, r.response) for r in rows} == {1: ("no_prompt", "ERROR: the row has no prompt"), 2: ("ok", "called for p")}


@pytest.mark.parametrize("n", [0, 2])
def test_small_sample_is_an_error_whatever_is_read(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "review_id").withColumn("x", F.lit(1))
    with pytest.raises(Exception, match="fewer than 30"):
        experiment.seeded_sample(rows).select("review_id").collect()


def test_rows_are_numbered_as_they_come(spark, tmp_path):
    rows = spark.createDataFrame([(f"N{i % 3}", i) for i in range(50)], "reviewer_name string, i int").repartitionByRange(5, "i").sortWithinPartitions("i")
    got = experiment.with_review_ids(rows).collect()
    assert sorted((r.review_id, r.i) for r in got) == [(i, i) for i in range(50)]
    assert experiment.with_review_ids(rows.withColumnRenamed("i", "review_id")).columns == ["reviewer_name", "review_id"]
    (tmp_path / "s.csv").mkdir()
    for part, low, high in (("a", 0, 3), ("b", 3, 40), ("c", 40, 41)):  # files of unlike size are read in another order
        (tmp_path / "s.csv" / f"{part}.csv").write_text("ReviewerName,Rating,Review\n" + "".join(f'Ann,3,"line\n{i}"\n' for i in range(low, high)))
    got = tables.read_sheet(spark, str(tmp_path / "s.csv")).collect()
    assert sorted((r.review_id, r.review) for r in got) == [(i, f"line\n{i}") for i in range(41)]


def test_numbering_leaves_the_callers_columns_alone(spark):
    rows = spark.range(0, 20, 1, 4).select(F.col("id").alias("_at"), (F.col("id") * 2).alias("_part"), F.lit("x").alias("__n"))
    got = tables.numbered_as_read(rows, "number")
    assert got.columns == ["_at", "_part", "__n", "number"] and all(r._at == r.number and r._part == 2 * r.number for r in got.collect())


def test_workbook(spark, tmp_path):
    rows = [["Other", "ReviewerName", "Rating", "Review"], [None, "Ann", 4.7, " a & <b>\n"], [True, 12, 2, None], ["x", None, 1]]
    (tmp_path / "w.xlsx").write_bytes(workbook.written(rows))
    assert list(workbook.first_sheet((tmp_path / "w.xlsx").read_bytes()))[1:3] == [[None, "Ann", 4.7, " a & <b>\n"], [True, 12.0, 2.0, None]]
    got = [tuple(r) for r in tables.read_sheet(spark, str(tmp_path / "w.xlsx")).collect()]
    assert got == [(0, "Ann", 4, " a & <b>\n"), (1, "12", 2, None), (2, None, 1, None)]
    (tmp_path / "bad.xlsx").write_bytes(workbook.written([["Rating"], [1]]))
    with pytest.raises(Exception, match="no column ReviewerName"):
        tables.read_sheet(spark, str(tmp_path / "bad.xlsx")).collect()
    (tmp_path / "ids.xlsx").write_bytes(workbook.written([["ReviewId", "ReviewerName", "Rating", "Review"], [7, "A", 1, "x"]]))
    assert [r.review_id for r in tables.read_sheet(spark, str(tmp_path / "ids.xlsx")).collect()] == [7]


def test_workbook_with_shared_strings():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(workbook.written([["x"]]))) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            if not name.endswith("sheet1.xml"):
                new.writestr(name, old.read(name))
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        new.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>one</t></si><si><r><t>t</t></r><r><t>wo_x000A_</t></r><rPh><t>no</t></rPh></si></sst>")
        new.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row><c t="e"><v>#REF!</v></c><c t="b"><v>0</v></c><c t="str"><v>f</v></c></row></sheetData></worksheet>')
    rows = list(workbook.first_sheet(out.getvalue()))
    assert rows[0] == ["one", *[None] * 26, "two\n"] and rows[1] == [None, False, "f"]


def test_cells_keep_their_white_space(spark, tmp_path):
    rows = [(0, 0, "A", 1, " x\t", 5, " r ", "\n two \n")]
    df = spark.createDataFrame(rows, "variant_ord int, seq int, variant string, review_id long, reviewer_name string, rating int, review string, response string")
    tables.write_result(df, str(tmp_path / "out"))
    assert [tuple(r)[:6] for r in tables.read_result(spark, str(tmp_path / "out")).collect()] == [rows[0][2:]]


def test_stream_rejects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"review_id": i, "business_name": "B", "reviewer_name": "R", "rating": i}) for i in (0, 3)] + ["no record", json.dumps({"review_id": 9, "business_name": "B", "rating": 1})]
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    schema = "review_id long, business_name string, reviewer_name string, rating int"
    stream_rejects(spark, str(tmp_path / "in"), schema, str(tmp_path / "bad"), str(tmp_path / "ckpt")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert sorted((r.reject_reason, r._corrupt_record) for r in rows if r.review_id is None) == [("corrupt record", "no record")]
    assert sorted((r.review_id, r.reject_reason) for r in rows if r.review_id is not None) == [(0, "rating out of range"), (9, "missing reviewer_name")]


def test_equal_ids_keep_their_own_keywords(spark):
    reviews = spark.createDataFrame([(1, "red apple"), (1, "green pear"), (1, "red apple"), (2, None)], "review_id int, review string")
    words = spark.createDataFrame([(0, "pear"), (1, "apple"), (2, "red apple"), (3, "!!"), (4, " ")], "ord int, keyword string")
    got = [(r.review_id, r.keywords) for r in match_keywords(reviews, words).collect()]
    assert sorted(got) == [(1, ["pear"]), (1, ["red apple", "apple"]), (1, ["red apple", "apple"]), (2, [])]


def test_keyword_forms_agree_on_odd_letters(spark):
    words = ["İx", "ß", "ẞ", "ΐx", "ΟΔΟΣ", "k", "ſ", "!", "a!", "!a", " a", "a  b", "²", "é", "é", "ŉ", "\U00010400"]
    texts = [w for w in words] + [w.upper() for w in words] + [w.lower() for w in words] + [f"a{w}b" for w in words] + [f"a {w} b" for w in words] + ["x!a!", "K s ı", "a!b"]
    reviews = spark.createDataFrame(list(enumerate(texts)), "review_id int, review string")
    vocabulary = spark.createDataFrame(list(enumerate(words)), "ord int, keyword string")
    got = {r.review_id: r.keywords for r in match_keywords(reviews, vocabulary, most=20).collect()}
    listed = reviews.select("review_id", top_matching_keywords(F.col("review"), F.array(*map(F.lit, words)), F.lit(20)).alias("k"))
    assert got == {r.review_id: r.k for r in listed.collect()}


def test_one_row_inputs(spark):
    review, business = spark.createDataFrame([("R", 4)], "reviewer_name string, rating int"), spark.createDataFrame([("B",), ("C",)], "business_name string")
    assert zip_single(review, business.limit(1)).first().business_name == "B"
    assert zip_single(review, business.where("false")).first().business_name is None
    with pytest.raises(Exception, match="one row is expected"):
        zip_single(review, business).collect()


def test_shared_folder_is_an_error_on_a_cluster_without_one(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_bodies_of_other_shapes():
    for body in ({}, [], None, {"choices": []}, {"choices": {}}, {"choices": [{"message": None}]}, {"choices": [{"message": {"content": 5}}]}):
        with pytest.raises(responder.ReplyError) as e:
            responder.first_choice(body)
        assert e.value.status == "bad_shape"
    for body in ({}, [], {"content": "x"}, {"content": [{"type": "text", "text": None}]}):
        with pytest.raises(responder.ReplyError):
            responder.joined_blocks(body)
    assert responder.joined_blocks({"content": [{"type": "text"}, 3, {"type": "text", "text": "a"}]}) == "a"
