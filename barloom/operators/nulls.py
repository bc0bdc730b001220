"""Structure of missing values: where in a period they stand, on which days, and in what runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions import BLOCK, carried, in_order, own_rows, with_halo


def first_of_period(rows: DataFrame, period: str, by: Sequence[str] = ()) -> DataFrame:
    """rows with first_of_period: no earlier row has their value of column `period`."""
    return rows.withColumn("first_of_period", F.col("timestamp") == F.min("timestamp").over(Window.partitionBy(*by, period)))


def null_contingency(rows: DataFrame, column: str, period: str, other: str) -> DataFrame:
    """Rows by first_of_period and missing (null in column), with those that miss `other` too, and their dates."""
    marked = first_of_period(rows, period).withColumn("missing", F.col(column).isNull())
    return marked.groupBy("first_of_period", "missing").agg(F.count(F.lit(1)).alias("bars"), F.count_if(F.col(other).isNull()).alias("completed_missing"), F.count_distinct(F.to_date("timestamp")).alias("dates"))


def null_weekdays(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.weekday("timestamp").alias("weekday")).agg(F.count(F.lit(1)).alias("bars"), F.count_if(F.col(column).isNull()).alias("missing_bars"))


def null_run_lengths(rows: DataFrame, column: str, step_seconds: int) -> DataFrame:
    """(length, runs): runs of rows that miss the column, each `step_seconds` after the one before. Runs are numbered in
    blocks of the series; a block's number of runs is carried on to the next."""
    missing = rows.where(F.col(column).isNull()).select("timestamp")
    spread = with_halo(missing, 1)
    before = F.lag("timestamp").over(in_order([BLOCK]))
    spread = spread.withColumn("_before", before).withColumn("_new", F.coalesce(F.expr(f"timestampdiff(SECOND, _before, timestamp) <> {step_seconds}"), F.lit(True)).cast("long"))
    own = own_rows(spread, keep_block=True)
    run = F.sum("_new").over(in_order([BLOCK])) + F.coalesce("_carry", F.lit(0))
    runs = carried(own, F.sum("_new"), F.sum).withColumn("run", run).groupBy("run").agg(F.count(F.lit(1)).alias("length"))
    return runs.groupBy("length").agg(F.count(F.lit(1)).alias("runs"))
