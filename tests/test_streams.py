from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import diagnostics
from larkspur.streaming import batches
from larkspur.streaming.figures import ReplyFigures, stream_figures
from larkspur.streaming.requests import read_both, stream_both

SCHEMA = "review_id long, business_name string, reviewer_name string, rating int, review string"
REPLY = "variant string, seq long, rating int, review string, response string"


def some_replies(seed, n=240):
    rng, words = random.Random(seed), ["Hi", "thanks", "there,", "wonderful", "evening", "Hello", "thank", "you!", "visit", "again"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))
    return [(rng.choice("AABC"), i, rng.randrange(1, 6), "r" * rng.randrange(0, 150), rng.choice([None, "ERROR: x", "", text(), text(), text()])) for i in range(n)] + [("D", 9000 + i, 1, None, "ERROR") for i in range(7)]


def rows(df):
    return sorted(map(str, df.collect()))


def same(figures, replies):
    assert rows(figures.summary()) == rows(diagnostics.summary(replies))
    assert rows(figures.opening_words()) == rows(diagnostics.opening_words(replies))
    assert rows(figures.top_words()) == rows(diagnostics.top_words(replies))
    assert rows(figures.samples().select("variant", "n", "seq", "review")) == rows(diagnostics.samples(replies).select("variant", "n", "seq", "review"))
    assert rows(figures.report_lines()) == rows(diagnostics.report_lines(replies))


@pytest.mark.parametrize("seed", [1, 2])
def test_figures_equal_batch_for_any_split(spark, tmp_path, seed):
    data = some_replies(seed)
    replies = spark.createDataFrame(data, REPLY)
    rng, figures = random.Random(seed), ReplyFigures(spark, f"file://{tmp_path}/f", "c")
    cuts = sorted(rng.sample(range(len(data)), 3))
    shuffled = rng.sample(data, len(data))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(data)], strict=True)):
        part = spark.createDataFrame(shuffled[a:b], REPLY)
        figures.add(part, k)
        if k == 1:
            figures.add(part, k)  # tried again
            figures.compact()
    same(figures, replies)
    figures.compact()
    figures.compact()
    assert all(len(p.paths()) == 1 for p in figures.parts.values())
    same(figures, replies)


def test_stream_of_replies(spark, tmp_path):
    data = some_replies(3, 90)
    for k in range(3):
        spark.createDataFrame(data[k::3], REPLY).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(REPLY).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    stream_figures(stream, f"file://{tmp_path}/f", f"{tmp_path}/ckpt").awaitTermination(120)
    figures = ReplyFigures(spark, f"file://{tmp_path}/f", f"{tmp_path}/ckpt")
    assert len(figures.parts["words"].paths()) == 3
    same(figures, spark.createDataFrame(data, REPLY))
    assert ReplyFigures(spark, f"file://{tmp_path}/none").summary().count() == 0


def test_both_sinks_add_up_after_a_crash(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for k in range(4):
        lines = [json.dumps({"review_id": 10 * k + i, "business_name": "B", "reviewer_name": "R", "rating": i, "review": "good"}) for i in range(8)] + [f"no record {k}"]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(lines))
    good, bad, ckpt = f"file://{tmp_path}/good", f"file://{tmp_path}/bad", f"{tmp_path}/ckpt"
    write, calls = batches.Batches.write, []

    def crash(self, df, number):
        calls.append(number)
        if len(calls) == 4:  # between the two sinks of the second batch
            raise RuntimeError("lost")
        write(self, df, number)

    monkeypatch.setattr(batches.Batches, "write", crash)
    with pytest.raises(Exception, match="lost"):
        stream_both(spark, str(tmp_path / "in"), SCHEMA, good, bad, ckpt, files=1).awaitTermination(120)
    assert calls == [0, 0, 1, 1]
    stream_both(spark, str(tmp_path / "in"), SCHEMA, good, bad, ckpt, files=1).awaitTermination(120)
    assert calls[4:] == [1, 1, 2, 2, 3, 3]
    requests, rejects = read_both(spark, good, bad)
    assert sorted(r.review_id for r in requests.collect()) == [10 * k + i for k in range(4) for i in range(1, 6)]
    assert sorted(r.review_id for r in rejects.where("review_id IS NOT NULL").collect()) == sorted(10 * k + i for k in range(4) for i in (0, 6, 7))
    assert sorted(r._corrupt_record for r in rejects.where(F.col("review_id").isNull()).collect()) == [f"no record {k}" for k in range(4)]
    assert read_both(spark, *[f"file://{tmp_path}/none"] * 2) == (None, None)
