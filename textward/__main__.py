"""Command line: python -m textward scan PATH... [--format text|json|sarif] [--fail-on LEVEL] [--strictness NAME].

Exit code 0: nothing reaches the level; 1: something does; 2: usage or read error."""

from __future__ import annotations

import argparse
import sys

from .functions.risk import LEVELS, THRESHOLDS


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textward")
    scan = parser.add_subparsers(dest="command", required=True).add_parser("scan")
    scan.add_argument("paths", nargs="+")
    scan.add_argument("--format", choices=["text", "json", "sarif"], default="text")
    scan.add_argument("--fail-on", choices=LEVELS, default="high")
    scan.add_argument("--strictness", choices=sorted(THRESHOLDS), default="balanced")
    scan.add_argument("--include", action="append")
    try:
        args = parser.parse_args(argv)
    except SystemExit as stop:
        return int(stop.code or 0)

    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    from .engine import Config, ThreatEngine
    from .sources import files

    spark = SparkSession.builder.appName("textward").getOrCreate()
    try:
        texts = files.read_texts(spark, args.paths, args.include)
        scanned = ThreatEngine(spark, Config(strictness=args.strictness)).scan(texts).cache()
        totals = files.report_totals(scanned, args.fail_on).first()
        if args.format == "text":
            for row in files.report_lines(scanned, args.fail_on).orderBy("file").toLocalIterator():
                print(row.line)
            print(f"{totals.files} files, {totals.blocked} blocked, {totals.clean} clean")
        else:
            report = files.report_json(scanned) if args.format == "json" else files.sarif(scanned)
            for row in report.toLocalIterator():
                print(row.value)
        return totals.exit_code
    except PySparkException as error:
        print(error, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
