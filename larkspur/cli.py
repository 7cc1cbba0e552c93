"""Command line: a reply (or, with --dry-run, its request) for one review; the experiment; its report."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from larkspur.operators import diagnostics
from larkspur.operators.ledger import Ledger
from larkspur.operators.responder import Offline, blocks_provider, choices_provider, generate_replies
from larkspur.operators.validation import strict, zip_single
from larkspur.plans import experiment
from larkspur.plans.review_prompt import MODEL, dry_run_text, requests
from larkspur.sources import tables

#: Environment variable that holds a provider's key.
KEY_VARIABLE = "LARKSPUR_KEY"


def session() -> SparkSession:
    return SparkSession.builder.appName("larkspur").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="larkspur")
    to = p.add_subparsers(dest="command", required=True)
    reply = to.add_parser("reply", help="answer one review")
    for name, needed in (("business", True), ("review", True), ("keywords", False), ("support", False)):
        reply.add_argument(f"--{name}", required=needed, help="JSON file")
    reply.add_argument("--model", default=MODEL)
    reply.add_argument("--url", help="provider's address; offline replies without one")
    reply.add_argument("--dry-run", action="store_true", help="print the request and call nobody")
    run = to.add_parser("experiment", help="two variants over a sample of reviews")
    run.add_argument("sheet")
    run.add_argument("out")
    run.add_argument("--business-name", required=True)
    run.add_argument("--url")
    run.add_argument("--key-header", default="x-api-key")
    run.add_argument("--model", default=MODEL)
    run.add_argument("--sample", type=int, default=experiment.SAMPLE_SIZE)
    run.add_argument("--pause", type=float, default=0.3, help="seconds between any two calls")
    run.add_argument("--tasks", type=int, default=1, help="calls at one time")
    run.add_argument("--ledger", help="folder of committed replies: a run that is started again asks for the rest alone")
    show = to.add_parser("report", help="diagnostics of an experiment's result")
    show.add_argument("result")
    return p


def _reply(spark: SparkSession, a: argparse.Namespace) -> str:
    rows = zip_single(
        tables.read_json(spark, a.review, tables.REVIEW),
        tables.read_json(spark, a.business, tables.BUSINESS).drop("_corrupt_record"),
        tables.read_optional(spark, a.keywords, tables.KEYWORDS).drop("_corrupt_record"),
        tables.read_optional(spark, a.support, tables.SUPPORT).drop("_corrupt_record"),
    )
    rows = strict(rows).selectExpr("0L AS review_id", "*")
    if a.dry_run:
        return requests(rows, a.model).select(dry_run_text()).first()[0]
    make = _provider(a)
    r = generate_replies(rows, make, a.model, tasks=1).first()
    if r.status != "ok":
        raise RuntimeError(r.error)
    return r.response


def _provider(a: argparse.Namespace):
    if not a.url:
        return Offline
    key = tables.credential(None, KEY_VARIABLE)
    if a.command == "reply":
        return lambda url=a.url, key=key: choices_provider(url, key)
    return lambda url=a.url, key=key, head=a.key_header, model=a.model: blocks_provider(url, key, head, model)


def _experiment(spark: SparkSession, a: argparse.Namespace) -> str:
    rows = experiment.run(tables.read_sheet(spark, a.sheet), a.business_name, _provider(a), size=a.sample, tasks=a.tasks, spacing=a.pause if a.url else 0.0, ledger=Ledger(spark, a.ledger) if a.ledger else None, model=a.model)
    tables.write_result(rows, a.out)  # the writer makes the folders above, on any file system
    return f"Saved to {a.out}"


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    try:
        spark = session()
        if a.command == "reply":
            print(_reply(spark, a))
        elif a.command == "experiment":
            print(_experiment(spark, a))
        else:
            print(diagnostics.report(tables.read_result(spark, a.result)))
    except Exception as e:  # noqa: BLE001  any failure is one line and a code
        print(f"ERROR: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
