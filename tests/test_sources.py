from __future__ import annotations

import json

import pytest

from larkspur import cli
from larkspur.sources import tables
from larkspur.streaming.requests import stream_requests


def test_json_records(spark, tmp_path):
    for name, text in (("ok", '{"reviewer_name": "A",\n "rating": 5, "other": 1}'), ("half", '{"reviewer_name": "A", "rating": 2.5}'), ("word", '{"reviewer_name": "A", "rating": "5"}')):
        (tmp_path / f"{name}.json").write_text(text)
    got = {n: tables.read_json(spark, str(tmp_path / f"{n}.json"), tables.REVIEW).first() for n in ("ok", "half", "word")}
    assert got["ok"].rating == 5 and got["ok"].review is None and got["ok"]._corrupt_record is None
    assert got["half"]._corrupt_record and got["word"]._corrupt_record
    empty = tables.read_optional(spark, None, tables.SUPPORT).first()
    assert empty.signature is None and len(empty) == 4


def test_result_round_trip(spark, tmp_path):
    rows = [(0, 0, "A", 1, "x", 5, 'a "quoted", b\nline', "one\ntwo"), (0, 1, "A", 2, "y", 4, None, "ERROR: t, u"), (1, 0, "B", 1, "x", 5, "", "")]
    df = spark.createDataFrame(rows, "variant_ord int, seq int, variant string, review_id long, reviewer_name string, rating int, review string, response string")
    tables.write_result(df, str(tmp_path / "out"))
    back = [tuple(r)[:6] for r in tables.read_result(spark, str(tmp_path / "out")).orderBy("seq").collect()]
    assert back[0] == rows[0][2:] and back[1] == rows[1][2:] and (back[2][4] or "") == "" and len(back) == 3


def test_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text('ReviewerName,Rating,Review\nAnn,4.7,"a\nb"\nBob,2,\n')
    rows = tables.read_sheet(spark, str(tmp_path / "s.csv")).collect()
    assert sorted(tuple(r) for r in rows) == [(0, "Ann", 4, "a\nb"), (1, "Bob", 2, None)]  # numbered, as it has no ids


def test_credential(monkeypatch):
    monkeypatch.delenv("NO_SUCH_KEY", raising=False)
    assert tables.credential("k", "NO_SUCH_KEY") == "k"
    with pytest.raises(ValueError, match="NO_SUCH_KEY"):
        tables.credential(None, "NO_SUCH_KEY")


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"review_id": i, "business_name": "B", "reviewer_name": "R", "rating": i, "review": "good"}) for i in range(7)))
    schema = "review_id long, business_name string, reviewer_name string, rating int, review string, ai_response_length_type string"
    q = stream_requests(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.review_id for r in rows) == [1, 2, 3, 4, 5] and all("Business Name: B" in r.prompt for r in rows)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "b.json").write_text('{"business_name": "Gem House"}')
    (tmp_path / "r.json").write_text('{"reviewer_name": "Ann", "rating": 5, "review": "lovely"}')
    (tmp_path / "bad.json").write_text('{"reviewer_name": "Ann", "rating": 9}')
    args = ["reply", "--business", str(tmp_path / "b.json"), "--review"]
    assert cli.main([*args, str(tmp_path / "r.json"), "--dry-run"]) == 0
    out = capsys.readouterr().out
    assert "max_tokens: 110" in out and "Review Text: lovely" in out
    assert cli.main([*args, str(tmp_path / "r.json")]) == 0 and "next visit" in capsys.readouterr().out
    assert cli.main([*args, str(tmp_path / "bad.json")]) == 1 and "ERROR:" in capsys.readouterr().err
    (tmp_path / "s.csv").write_text("ReviewId,ReviewerName,Rating,Review\n" + "".join(f"{i},N{i},{i % 5 + 1},fine {i}\n" for i in range(32)))
    assert cli.main(["experiment", str(tmp_path / "s.csv"), str(tmp_path / "new" / "res"), "--business-name", "Gem House"]) == 0
    assert cli.main(["report", str(tmp_path / "new" / "res")]) == 0
    assert "== A_no_grounding: 30 rows, 0 failed ==" in capsys.readouterr().out
