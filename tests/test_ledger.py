from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from larkspur.operators import responder
from larkspur.operators.ledger import Ledger, respond_once

KEYS = ("prompt",)


def calls_in(folder):
    """What a responder was asked, one file for each call."""
    return sorted((folder / f).read_text() for f in os.listdir(folder))


def recorder(folder, crash_at=None, fail=()):
    """Notes every call in a file of its own; from call `crash_at` on the task dies, as a lost machine's would."""

    def make():
        def answer(request):
            if crash_at is not None and len(os.listdir(folder)) >= crash_at:
                os._exit(1)
            with open(f"{folder}/{time.time_ns()}-{os.getpid()}", "w") as f:
                f.write(request["prompt"])
            if request["prompt"] in fail:
                raise responder.ReplyError("network", "gone")
            return "re " + request["prompt"]

        return answer

    return make


def test_a_killed_run_goes_on_where_it_was(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    requests = spark.createDataFrame([(i, f"p{i % 40}") for i in range(200)] + [(999, None)], "review_id int, prompt string")
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    with pytest.raises(Exception):  # noqa: B017, PT011  the workers die
        respond_once(requests, recorder(tmp_path / "calls", crash_at=22), ledger, KEYS, tasks=1, batch=8).count()
    done = {r.digest for r in ledger.entries().collect()}
    assert 0 < len(done) < 40
    before = calls_in(tmp_path / "calls")
    got = respond_once(requests, recorder(tmp_path / "calls"), Ledger(spark, f"file://{tmp_path}/ledger"), KEYS, tasks=2, batch=8)
    assert {(r.review_id, r.response, r.status) for r in got.collect()} == {(i, f"re p{i % 40}", "ok") for i in range(200)} | {(999, "ERROR: the row has no prompt", "no_prompt")}
    asked = calls_in(tmp_path / "calls")
    repeated = {p for p in asked if asked.count(p) > 1}
    # only calls of the batch that was under way are made again
    assert set(asked) == {f"p{i}" for i in range(40)} and len(repeated) <= 22 - len(done) and repeated <= set(before)
    assert got.count() == 201 and calls_in(tmp_path / "calls") == asked  # reading again asks nobody


def test_what_failed_is_tried_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    requests = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "review_id int, prompt string")
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    first = {r.review_id: r.status for r in respond_once(requests, recorder(tmp_path / "calls", fail=("p2", "p4")), ledger, KEYS).collect()}
    assert [i for i, s in first.items() if s == "network"] == [2, 4] or sorted(i for i, s in first.items() if s == "network") == [2, 4]
    again = {r.review_id: (r.status, r.response) for r in respond_once(requests, recorder(tmp_path / "calls"), ledger, KEYS).collect()}
    assert again == {i: ("ok", f"re p{i}") for i in range(6)}
    assert calls_in(tmp_path / "calls") == sorted([f"p{i}" for i in range(6)] + ["p2", "p4"])
    ledger.compact()
    assert len(ledger._found("batch-*")) == 1 and respond_once(requests, recorder(tmp_path / "none"), ledger, KEYS).where("status = 'ok'").count() == 6


def test_same_requests_are_asked_once_and_fields_tell_them_apart(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    rows = [(1, "p", 0.5), (2, "p", 0.5), (3, "p", None), (4, "p", 0.8)]
    requests = spark.createDataFrame(rows, "review_id int, prompt string, temperature double")
    got = respond_once(requests, recorder(tmp_path / "calls"), Ledger(spark, f"file://{tmp_path}/ledger"))
    assert got.columns == [*requests.columns, "response", "status", "error"] and {r.response for r in got.collect()} == {"re p"}
    assert len(calls_in(tmp_path / "calls")) == 3
    none = respond_once(requests.limit(0), recorder(tmp_path / "calls"), Ledger(spark, f"file://{tmp_path}/other"))
    assert none.count() == 0


def test_finished_tasks_of_a_failed_batch_count(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    requests = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "review_id int, prompt string")
    make = recorder(str(tmp_path / "calls"))

    def dies_late():
        answer = make()

        def one(request):
            if request["prompt"] == "p13":
                time.sleep(6)  # the other tasks are through by then
                os._exit(1)
            return answer(request)

        return one

    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    with pytest.raises(Exception):  # noqa: B017, PT011  the worker dies
        respond_once(requests, dies_late, ledger, KEYS, tasks=4).count()
    kept = {r.response for r in ledger.entries().collect()}
    assert 20 <= len(kept) < 40
    got = {r.review_id: r.response for r in respond_once(requests, recorder(tmp_path / "calls"), ledger, KEYS, tasks=4).collect()}
    assert got == {i: f"re p{i}" for i in range(40)}
    asked = calls_in(tmp_path / "calls")
    assert not {f"re {p}" for p in asked if asked.count(p) > 1} & kept


def test_what_is_not_committed_does_not_count(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.entries().count() == 0
    ledger.add(spark.createDataFrame([("d", "r", "ok", None)], "digest string, response string, status string, error string"))
    left = tmp_path / "ledger" / "batch-half" / "_temporary" / "0" / "task_1"
    left.mkdir(parents=True)
    (left / "part-0.parquet").write_text("torn")
    assert [r.digest for r in ledger.entries().collect()] == ["d"]


@pytest.mark.parametrize("spacing", [0.02])
def test_one_rate_for_all_tasks(spark, spacing):
    requests = spark.range(64).select(F.col("id").cast("int").alias("review_id"), F.lit("p").alias("prompt"))
    told = responder.respond(requests, lambda: lambda request: repr(time.time()), tasks=8, spacing=spacing)
    at = sorted(float(r.response) for r in told.collect())
    assert len(at) == 64 and min(b - a for a, b in zip(at, at[1:], strict=False)) >= 0.9 * spacing
    assert at[-1] - at[0] >= 63 * spacing


def test_turns_hold_whatever_calls_take():
    now, began = 0.0, []

    def sleep(seconds):
        nonlocal now
        now += seconds + 0.0001

    tasks = [responder.Turns(0.9, 4, k, lambda: now, sleep) for k in range(4)]
    for length in (0.0, 0.3, 2.7, 11.0, 0.95):
        for t in tasks:
            began.append(t.wait())
            now += length
    began.sort()
    assert all(b - a >= 0.9 - 1e-9 for a, b in zip(began, began[1:], strict=False))


def test_local_responders_answer_where_rows_lie(spark):
    rows = spark.range(100, numPartitions=3).selectExpr("cast(id AS string) AS prompt")
    assert responder.respond(rows, responder.Offline).rdd.getNumPartitions() == 3
    assert responder.respond(rows, responder.Offline, tasks=5, pause=0.001).rdd.getNumPartitions() == 5
    assert responder.respond(rows, lambda: responder.Offline()).rdd.getNumPartitions() == 8


def test_a_rate_has_no_more_tasks_than_cores(spark):
    """Else a second wave of tasks waits for the first one to end, and both leave the other's slots unused."""
    cores, spacing = spark.sparkContext.defaultParallelism, 0.018
    rows = spark.range(20 * cores).selectExpr("cast(id AS string) AS prompt")
    said = responder.respond(rows, lambda: lambda request: repr(time.time()), tasks=2 * cores, spacing=spacing)
    assert said.rdd.getNumPartitions() == cores
    at = sorted(float(r.response) for r in said.collect())
    assert len(at) == 20 * cores and min(b - a for a, b in zip(at, at[1:])) > 0.5 * spacing
