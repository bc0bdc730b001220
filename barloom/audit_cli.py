"""python -m barloom.audit_cli --file PATH [--expected-rows N]: verify a prediction file; exit 1 if it fails."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from barloom.operators.learners import audit_predictions
from barloom.sources import read_table


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--file", required=True)
    parser.add_argument("--expected-rows", type=int)
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("audit").getOrCreate()
    rows = read_table(spark, args.file).withColumn("ordinal", F.monotonically_increasing_id())  # of files as they lie
    row = audit_predictions(rows, args.expected_rows, order="ordinal").first().asDict()
    print(json.dumps(row))
    return 0 if row["passed"] else 1


if __name__ == "__main__":
    sys.exit(main())
