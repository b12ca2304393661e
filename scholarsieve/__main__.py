"""Command line: preview rules for one abstract, or run a day offline from a fixture.

    python -m scholarsieve config --config my.toml --abstract "..." [--title "..."] [--category cs.CV]
    python -m scholarsieve simulate --fixture papers.json --state /shared/state [--config my.toml]
                           [--promote ID | --resend ID | --retry STAGE ID] [--delivery confirmed]
"""
from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from scholarsieve import config as settings
from scholarsieve.operators import rules
from scholarsieve.plans.daily import DailyRun, FixtureAnalysis, MockDelivery
from scholarsieve.sources.fixtures import Fixture
from scholarsieve.sources.sinks import Conflict, Store


def preview(spark: SparkSession, config: dict, args) -> dict:
    ruleset = rules.RuleSet.of(config["rules"])
    row = [("2601.00001v1", "2601.00001", args.title, args.abstract, args.category or list(ruleset.categories))]
    paper = spark.createDataFrame(row, "version_id string, base_id string, title string, abstract string, categories array<string>")
    found = rules.explain(paper, ruleset).first().asDict(recursive=True)
    traced = rules.trace(paper, ruleset).first()
    return {"routes": found["routes"], "matched_groups": found["matched_groups"], "excluded_by": found["excluded_by"],
            "modules": settings.modules(config), "rule_trace": traced["rule_trace"].asDict(recursive=True) if traced else None}


def simulate(spark: SparkSession, config: dict, args) -> dict:
    fixture = Fixture(spark, args.fixture)
    run = DailyRun(Store(spark, args.state), config, FixtureAnalysis(fixture), MockDelivery(args.delivery))
    if args.promote:
        run.promote(args.promote)
    if args.resend:
        run.resend(args.resend)
    if args.retry:
        run.retry(args.retry[0], args.retry[1:])
    return run.run(fixture.papers())


def main(argv=None) -> int:
    parser = argparse.ArgumentParser(prog="scholarsieve")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("config")
    one.add_argument("--abstract", required=True)
    one.add_argument("--title", default="untitled")
    one.add_argument("--category", action="append")
    day = commands.add_parser("simulate")
    day.add_argument("--fixture", required=True)
    day.add_argument("--state", required=True)
    day.add_argument("--delivery", default="confirmed", choices=("confirmed", "queued", "failed", "unknown"))
    choice = day.add_mutually_exclusive_group()
    choice.add_argument("--promote", action="append")
    choice.add_argument("--resend", action="append")
    choice.add_argument("--retry", nargs="+", metavar=("STAGE", "ID"))
    for command in (one, day):
        command.add_argument("--config")
    args = parser.parse_args(argv)
    try:
        config = settings.load(args.config)
        spark = SparkSession.builder.appName("scholarsieve").getOrCreate()
        report = (preview if args.command == "config" else simulate)(spark, config, args)
    except (ValueError, OSError, Conflict) as exc:
        print(json.dumps({"error": str(exc)}, ensure_ascii=False))
        return 2
    print(json.dumps(report, ensure_ascii=False, default=str))
    return 1 if report.get("errors") else 0


if __name__ == "__main__":
    sys.exit(main())
