"""Command line: the report of one program on standard output."""

from __future__ import annotations

import argparse
import os
import sys


def should_color(choice: str) -> bool:
    if choice != "auto":
        return choice == "always"
    return sys.stdout.isatty() and "NO_COLOR" not in os.environ


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codefacts", description="Whole-program findings for a TypeScript program.")
    parser.add_argument("path", nargs="?", default=".", help="a tsconfig.json or the folder with one")
    parser.add_argument("--production", action="store_true", help="tests are not roots of reachability")
    parser.add_argument("--include-exported", action="store_true", help="exported functions may be in single-use chains")
    parser.add_argument("--color", choices=("auto", "always", "never"), default="auto")
    own = parser.parse_args(arguments)

    from pyspark.sql import SparkSession

    from codefacts.api import analyze
    from codefacts.plans.facts import Options
    from codefacts.sources.program import ProgramError, load

    try:
        load(own.path)
    except (ProgramError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        sys.stdout.write(analyze(spark, own.path, Options(own.production, own.include_exported), should_color(own.color)))
    except Exception as e:  # the report is all or nothing
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
