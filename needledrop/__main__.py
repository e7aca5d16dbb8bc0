"""``python -m needledrop INPUT.csv OUTPUT_FOLDER``: audits a play log and writes findings, actions and a report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from needledrop.plans.index import Index
from needledrop.plans.report import Audit
from needledrop.plans.storage import scratch, written
from needledrop.rules import Rules
from needledrop.sinks.render import head, write_markdown, write_report_json
from needledrop.sinks.tables import write_csv, write_json
from needledrop.sources.plays import read_csv


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--minimum-confidence", default="medium", choices=("low", "medium", "high"))
    p.add_argument("--canonical", default="score", choices=("score", "recent", "frequent"))
    given = p.parse_args(args)
    spark = SparkSession.builder.appName("needledrop").getOrCreate()
    with scratch(spark):
        plays, warnings = read_csv(spark, given.input)
        audit = Audit(Index(written(plays, "plays")), Rules().override(minimum_confidence=given.minimum_confidence, canonical=given.canonical))
        write_json(audit.findings, f"{given.output}/findings")
        write_csv(audit.findings, f"{given.output}/actions")
        write_markdown(audit, f"{given.output}/report")
        write_report_json(audit, f"{given.output}/json")
        print(head(audit), *(f"Warning: {w}" for w in warnings), sep="\n")


if __name__ == "__main__":
    main()
