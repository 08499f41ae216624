"""``python -m tidemark validate PATH`` checks snapshots against the contract; ``-`` reads one from standard input.

Exit code 0: all sound; 1: violations, one per line; 2: nothing to read.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from .operators.contract import violations
from .sources.snapshots import read_documents


def validate(spark: SparkSession, path: str, out=sys.stdout, given=sys.stdin) -> int:
    if path == "-":
        documents = spark.createDataFrame([("-", given.read())], "path string, text string")
    else:
        try:
            documents = read_documents(spark, path)
        except AnalysisException:
            print(f"nothing to read at {path}", file=out)
            return 2
    found = False
    for row in violations(documents).orderBy("path", "place", "violation").toLocalIterator():
        place = "" if row.place is None else f"stocks[{row.place}] "
        print(f"{row.path}: {place}{row.violation}", file=out)
        found = True
    return int(found)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("validate", help="check snapshots against the contract").add_argument("path")
    options = parser.parse_args(argv)
    return validate(SparkSession.builder.appName("tidemark").getOrCreate(), options.path)


if __name__ == "__main__":
    sys.exit(main())
